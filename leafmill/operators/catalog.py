"""The catalog of pages, links and sources: states, summaries, listings and mutations.

Mutations are functions from tables to tables; ``sources.warehouse`` commits
their results as snapshots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A page's state follows from its times and failure alone.
STATES = ("pending", "fetch_failed", "awaiting_parse", "parse_rejected", "parsed")


def state(fetched_at: str = "fetched_at", parsed_at: str = "parsed_at", fail_reason: str = "fail_reason") -> Column:
    fetched, parsed, failed = (F.col(c).isNotNull() for c in (fetched_at, parsed_at, fail_reason))
    return (
        F.when(parsed, "parsed")
        .when(fetched & failed, "parse_rejected")
        .when(fetched, "awaiting_parse")
        .when(failed, "fetch_failed")
        .otherwise("pending")
    )


def needs_fetch(refetch: bool = False) -> Column:
    return F.lit(True) if refetch else F.col("fetched_at").isNull() & F.col("fail_reason").isNull()


def unparsed() -> Column:
    return F.col("fetched_at").isNotNull() & F.col("parsed_at").isNull() & F.col("fail_reason").isNull()


def _counters() -> list[Column]:
    now = state()
    return [F.count("*").alias("total"), *(F.count_if(now == s).alias(s) for s in STATES)]


def status_counts(pages: DataFrame) -> DataFrame:
    """One row of counters, zeros for an empty table: one scan, no shuffle but of the sums."""
    return pages.agg(*_counters())


def status_by(pages: DataFrame, key: str = "domain") -> DataFrame:
    return pages.groupBy(key).agg(*_counters())


def fail_summary(pages: DataFrame) -> DataFrame:
    """(domain, fail_reason, n), the most frequent first."""
    rows = pages.where(F.col("fail_reason").isNotNull()).groupBy("domain", "fail_reason").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "domain", "fail_reason")


def duplicate_slugs(pages: DataFrame) -> DataFrame:
    """(slug, n) of slugs that several pages have: a violated invariant."""
    return pages.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "slug")


def list_fetched(pages: DataFrame, links: DataFrame | None = None, limit: int | None = None, newest: bool = True, domain: str | None = None, source: str | None = None) -> DataFrame:
    """Fetched pages by time of fetching, ties by url; of one domain, or linked by one source, if given."""
    rows = pages.where(F.col("fetched_at").isNotNull())
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    if source is not None:
        rows = rows.join(links.where(F.col("source_name") == source), "url", "left_semi")
    rows = rows.orderBy(F.desc("fetched_at") if newest else F.asc("fetched_at"), "url")
    return rows.limit(limit) if limit else rows


def lookup(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The pages of some urls."""
    return pages.join(urls.select("url"), "url", "left_semi")


def failures_for(pages: DataFrame, urls: DataFrame) -> DataFrame:
    return lookup(pages.where(F.col("fail_reason").isNotNull()), urls)


def run_failures(pages: DataFrame, urls: DataFrame, most: int = 10) -> DataFrame:
    """(domain, fail_reason, n) of the failures among the ``urls`` of one run, the most frequent first."""
    rows = failures_for(pages, urls).groupBy("domain", "fail_reason").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "domain", "fail_reason").limit(most)


def candidates(urls: DataFrame, pages: DataFrame, refetch: bool = False) -> DataFrame:
    """(url, original_url) of the urls to fetch: new ones and pending ones, or all with ``refetch``.

    A stored page keeps its original_url.
    """
    old = pages.select("url", F.col("original_url").alias("_original"), "fetched_at", "fail_reason", F.lit(True).alias("_known"))
    both = urls.select("url", "original_url").join(old, "url", "left")
    return both.where(F.col("_known").isNull() | needs_fetch(refetch)).select("url", F.coalesce("_original", "original_url").alias("original_url"))


PRUNE_MODES = {
    "failed": lambda pages, links: pages.where(F.col("fail_reason").isNotNull()),
    "missing": lambda pages, links: pages.where(F.col("fail_reason").isNotNull()).join(links, "url", "left_anti"),
    "all": lambda pages, links: pages,
}


def prune_victims(pages: DataFrame, links: DataFrame, mode: str) -> DataFrame:
    """The pages that pruning removes: failed ones, failed ones that nothing links, or all."""
    if mode not in PRUNE_MODES:
        raise ValueError(f"unknown prune mode {mode!r}: one of {', '.join(sorted(PRUNE_MODES))}")
    return PRUNE_MODES[mode](pages, links)


def without(pages: DataFrame, links: DataFrame, victims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and links without the victims."""
    gone = victims.select("url")
    return pages.join(gone, "url", "left_anti"), links.join(gone, "url", "left_anti")


def exclusive_pages(pages: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """Pages that only ``source`` links: a link of another source, or of none, keeps a page."""
    own = links.where(F.col("source_name") == source)
    other = links.where(~F.col("source_name").eqNullSafe(source))
    return pages.join(own, "url", "left_semi").join(other, "url", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str | list[str] = "url", keep: tuple[str, ...] = ("added_at",)) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of equal key; columns ``keep`` stay as they were.

    ``new`` must have one row for each key.
    """
    keys = [key] if isinstance(key, str) else key
    a = old.withColumn("_old", F.lit(True)).alias("a")
    b = new.withColumn("_new", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")

    def value(c: str) -> Column:
        if c in keep:
            return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
        return F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    return joined.select(*(value(c).alias(c) for c in old.columns))


def insert_absent(old: DataFrame, new: DataFrame, key: str = "url") -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks, other columns null."""
    return old.unionByName(new.join(old, key, "left_anti"), allowMissingColumns=True)


def newest_links(links: DataFrame) -> DataFrame:
    """One row for each (url, file_path), that of the latest indexed_at; ties by source_name, nulls first."""
    best = F.max(F.struct("indexed_at", "source_name"))
    return links.groupBy("url", "file_path").agg(best.alias("m")).select("url", "file_path", F.col("m.source_name").alias("source_name"), F.col("m.indexed_at").alias("indexed_at"))


def replace_links(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Links with those of ``files``, which were read again, replaced by ``new``; other files keep theirs."""
    return newest_links(old.join(files.select("file_path"), "file_path", "left_anti").unionByName(new))


def remove_source(sources: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Sources without one; its links stay and name none."""
    return sources.where(F.col("name") != name), links.withColumn("source_name", F.when(F.col("source_name") != name, F.col("source_name")))


def dangling_links(links: DataFrame, pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Links whose page or source is not there: empty if the references hold."""
    no_page = links.join(pages, "url", "left_anti").withColumn("missing", F.lit("page"))
    named = links.where(F.col("source_name").isNotNull())
    no_source = named.join(sources, named["source_name"] == sources["name"], "left_anti").withColumn("missing", F.lit("source"))
    return no_page.unionByName(no_source)


def mark_diverted(pages: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Pending pages that today's rules skip or rewrite get the reason; all others stay as they are.

    ``verdicts``: (url, target, reason) of the pages' urls.
    """
    told = verdicts.where(~F.col("target").eqNullSafe(F.col("url"))).select("url", F.coalesce("reason", F.concat(F.lit("rewritten to "), F.col("target"))).alias("_why"))
    return pages.join(told, "url", "left").withColumn("fail_reason", F.when(needs_fetch() & F.col("_why").isNotNull(), F.col("_why")).otherwise(F.col("fail_reason"))).drop("_why")


def pipeline_summary(indexed: DataFrame, fetched: DataFrame, parsed: DataFrame, failed: DataFrame) -> DataFrame:
    """One row: how many urls were indexed, fetched, parsed and failed."""
    named = {"indexed": indexed, "fetched": fetched, "parsed": parsed, "failed": failed}
    rows = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("what"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.agg(*(F.count_if(F.col("what") == name).alias(name) for name in named))


def first_in_order(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order): each key once, where it came first."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order``; of rows that tie, the greatest by all columns."""
    ties = [F.desc(c) for c in rows.columns if c not in (key, order)]
    window = Window.partitionBy(key).orderBy(F.desc(order), *ties)
    return rows.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
