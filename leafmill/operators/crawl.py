"""Following links level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.links import page_links
from leafmill.functions.urls import domain_for_url
from leafmill.operators.verdicts import with_verdict
from leafmill.session import cut_lineage, discard
from leafmill.sources.rules import Rule


def crawl(seeds: DataFrame, links_of: Callable[[DataFrame], DataFrame], depth: int, same_domain: bool = True) -> DataFrame:
    """(url, level) of all pages within ``depth`` links of the seeds (url), each at its least level.

    ``links_of`` gives (url, link) for a frontier (url). With ``same_domain`` only
    links into the seeds' domains count. Each level anti-joins what was seen and is
    checkpointed, so the plan does not grow; the loop ends when a level is empty.
    """
    start = seeds.select("url").where("url is not null").distinct()
    allowed = cut_lineage(start.select(domain_for_url(F.col("url")).alias("domain")).distinct()) if same_domain else None
    seen = frontier = cut_lineage(start.withColumn("level", F.lit(0)))
    for level in range(1, depth + 1):
        found = links_of(frontier.select("url")).select(F.col("link").alias("url")).where("url is not null").distinct()
        if allowed is not None:
            found = found.withColumn("domain", domain_for_url(F.col("url"))).join(allowed, "domain", "left_semi").drop("domain")
        frontier = cut_lineage(found.join(seen, "url", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            discard(frontier)
            break
        seen = seen.unionByName(frontier)
    if allowed is not None:
        discard(allowed)
    return seen


def saved_page_links(pages: DataFrame, raw_pages: DataFrame, rules: list[Rule] = ()) -> Callable[[DataFrame], DataFrame]:
    """Links of a frontier's saved HTML pages, after the rules; pages not saved and PDFs have none."""
    html = pages.where((F.col("content_type") == "html") & F.col("fetched_at").isNotNull()).select("url", "slug").join(raw_pages.select("slug", "html"), "slug")

    def links_of(frontier: DataFrame) -> DataFrame:
        rows = html.join(frontier, "url", "left_semi").select("url", F.explode(page_links("html", "url")).alias("raw"))
        return with_verdict(rows, "raw", rules).where("target is not null").select("url", F.col("target").alias("link"))

    return links_of
