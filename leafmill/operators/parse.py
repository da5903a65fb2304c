"""From raw pages to accepted markdown or a reason against it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import html as H
from leafmill.functions.markdown import clean_markdown
from leafmill.functions.text import word_count
from leafmill.functions.urls import is_raw_text_url


def parsed(pages: DataFrame, raw_pages: DataFrame, min_words: int = H.MIN_WORDS, dropped: frozenset[str] = H.DROPPED) -> DataFrame:
    """(url, slug, markdown, title, word_count, fail_reason) of each page; either markdown or fail_reason is null.

    Plain text is stored as it is. HTML is checked, fixed, converted, cleaned and
    counted; the gate counts code blocks where the text without them is too short,
    the stored count leaves them out. ``dropped`` are the elements that are no content. PDF text comes extracted, in ``raw_pages.html``.
    """
    rows = pages.select("url", "slug", "content_type").join(raw_pages.select("slug", "html"), "slug", "left")
    plain = is_raw_text_url(F.col("url"))
    is_html = ~plain & (F.coalesce("content_type", F.lit("html")) != "pdf")
    checked = rows.withColumn("_bad", F.when(F.col("html").isNull(), F.concat(F.lit("raw file missing on disk ("), F.coalesce("content_type", F.lit("html")), F.lit(")"))).when(is_html, H.check_html(F.col("html"))))
    # a Python function is run for all rows, whatever guards it: the others get null
    made = checked.withColumn("_md", H.html_to_markdown(F.when(is_html & F.col("_bad").isNull(), H.fix_html(F.col("html"))), dropped))
    text = made.withColumn("_text", F.when(is_html, clean_markdown(F.col("_md.stripped"))).otherwise(F.col("html")))
    counted = text.withColumn("_n", word_count(F.col("_text"))).withColumn("_gate", F.greatest(F.col("_n"), F.when(is_html, word_count(F.col("_md.whole"))).otherwise(F.lit(0))))
    kind = F.when(F.col("content_type") == "pdf", "pdf").otherwise("html")
    short = F.when(~plain & (F.col("_gate") < min_words), F.concat(F.lit("too short ("), F.col("_gate").cast("string"), F.lit(f" words < {min_words}, from "), _size(F.octet_length("html")), F.lit(" "), kind, F.lit(")")))
    reason = F.coalesce("_bad", short)
    good = reason.isNull()
    return counted.select(
        "url",
        "slug",
        F.when(good, F.coalesce("_text", F.lit(""))).alias("markdown"),
        F.when(good & is_html, H.title(F.col("html"))).alias("title"),
        F.when(good, F.col("_n")).otherwise(F.lit(0)).cast("long").alias("word_count"),
        reason.alias("fail_reason"),
    )


def _size(size):
    return F.when(size < 1024, F.format_string("%d B", size)).otherwise(F.format_string("%d KB", F.floor(size / 1024)))


def recorded(pages: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Pages with the outcome of parsing: accepted ones get title, words and parsed_at and lose their failure."""
    r = results.select("url", F.col("title").alias("_t"), F.col("word_count").alias("_w"), F.col("fail_reason").alias("_f"), F.lit(True).alias("_done"))
    joined = pages.join(r, "url", "left")
    ok = F.col("_done").isNotNull() & F.col("_f").isNull()
    bad = F.col("_f").isNotNull()
    changed = {
        "title": F.when(ok, F.col("_t")).otherwise(F.col("title")),
        "word_count": F.when(ok, F.col("_w")).otherwise(F.col("word_count")),
        "parsed_at": F.when(ok, F.lit(now)).when(bad, F.lit(None).cast("string")).otherwise(F.col("parsed_at")),
        "fail_reason": F.when(ok, F.lit(None).cast("string")).when(bad, F.col("_f")).otherwise(F.col("fail_reason")),
    }
    return joined.withColumns(changed).select(*pages.columns)
