"""Queries of the engine over the archive's tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import html, markdown, urls
from leafmill.functions.chunks import chunked
from leafmill.functions.embed import embedded
from leafmill.functions.links import extract_urls, page_links
from leafmill.functions.text import word_count
from leafmill.operators import catalog, crawl, parse, search, verdicts
from leafmill.plans.rules import DEFAULT_RULES
from leafmill.session import cut_lineage, table
from leafmill.sources.fetching import transient
from leafmill.sources.rules import parse_rules
from leafmill.streaming import events

Query = Callable[[SparkSession, str], DataFrame]


STATE = ("url", "fetched_at", "parsed_at", "fail_reason")


def _pages(s: SparkSession, d: str, *columns: str) -> DataFrame:
    """The pages, repeats once. Only the columns asked for are read; a filter on them reaches the scan,
    as it would not through the first values that dropDuplicates takes."""
    pages = table(s, d, "pages")
    return (pages.select("url", *(c for c in columns if c != "url")) if columns else pages).distinct()


def _links(s: SparkSession, d: str) -> DataFrame:
    return catalog.newest_links(table(s, d, "links"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").dropDuplicates(["doc_id"])


def _source(s: SparkSession, d: str) -> str:
    return table(s, d, "sources").agg(F.min("name")).first()[0]


def _of(columns: tuple[str, ...], f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(_pages(s, d, *columns))


def _on(table_: Callable[[SparkSession, str], DataFrame], f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda s, d: f(table_(s, d))


def _prune(mode: str) -> Query:
    return lambda s, d: catalog.prune_victims(_pages(s, d, "slug", "fail_reason"), _links(s, d), mode).select("url", "slug")


def _pruned_links(s: SparkSession, d: str) -> DataFrame:
    pages, links = _pages(s, d, "fail_reason"), _links(s, d)
    return catalog.without(pages, links, catalog.prune_victims(pages, links, "failed"))[1].select("url", "file_path")


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Each page fetched again: the newest conversion's word count and title, added_at as it was."""
    pages = _pages(s, d)
    conversions = catalog.latest(table(s, d, "conversion_results").distinct().where("converted_at is not null").select("url", "converted_at", "result_id", "title", "word_count"), "url", "converted_at")
    new = pages.select("url", "original_url", "domain", "slug", "content_type", "author").join(conversions, "url")
    fresh = new.select(
        "url", "original_url", "domain", "slug", "content_type", "title", "author", "word_count", F.lit(None).cast("string").alias("fail_reason"),
        F.lit("2099").alias("added_at"), F.col("converted_at").alias("fetched_at"), F.col("converted_at").alias("parsed_at"),
    )
    return catalog.upsert(pages, fresh).select("url", "title", "word_count", "fail_reason", "added_at", "fetched_at")


def _insert_absent(s: SparkSession, d: str) -> DataFrame:
    linked = table(s, d, "links").select("url").distinct()
    found = linked.withColumn("original_url", F.col("url")).withColumn("domain", urls.domain_for_url(F.col("url"))).withColumn("slug", urls.slug_for_url(F.col("url")))
    known = _pages(s, d, "original_url", "domain", "slug", "parsed_at").where("parsed_at is not null")
    return catalog.insert_absent(known, found).select("url", "original_url", "domain", "slug", "parsed_at")


def _replace_links(s: SparkSession, d: str) -> DataFrame:
    """The files of one source read again and found to link one page."""
    links = table(s, d, "links")
    files = links.where(F.col("source_name") == _source(s, d)).select("file_path").distinct()
    new = files.select(F.lit("https://leafmill.example/").alias("url"), "file_path", F.lit(None).cast("string").alias("source_name"), F.lit("2099").alias("indexed_at"))
    return catalog.replace_links(links, new, files)


def _diverted(s: SparkSession, d: str) -> DataFrame:
    pages = _pages(s, d, *STATE)
    told = verdicts.with_verdict(pages.select("url"), "url", DEFAULT_RULES)
    return catalog.mark_diverted(pages, told).select("url", "fail_reason")


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    return verdicts.with_verdict(_pages(s, d, "original_url"), "original_url", DEFAULT_RULES)


def _registered(s: SparkSession, d: str) -> DataFrame:
    return verdicts.registered(table(s, d, "pages").select("original_url", "added_at"), "original_url", "added_at", DEFAULT_RULES)


def _note_urls(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", F.posexplode(extract_urls(F.col("text"))).alias("pos", "url"))


def _html(s: SparkSession, d: str) -> DataFrame:
    """A page around each conversion, as the tables hold no HTML."""
    rows = table(s, d, "conversion_results").dropDuplicates(["result_id"])
    page = F.concat(F.lit("<html><head><title> "), F.coalesce("title", F.lit("")), F.lit(" </title></head><body>"), F.coalesce("md_content", F.lit("")), F.lit("</body></html>"))
    return rows.select("result_id", page.alias("html"))


def _html_checks(s: SparkSession, d: str) -> DataFrame:
    return _html(s, d).select("result_id", html.check_html(F.col("html")).alias("reason"), html.title(F.col("html")).alias("title"))


def _too_short(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "conversion_results").dropDuplicates(["result_id"]).where("md_content is not null")
    counted = rows.select("result_id", word_count(F.col("md_content")).alias("words"), F.octet_length("md_content").alias("size"))
    return counted.select("result_id", "words", html.too_short(F.col("words"), 50, F.col("size"), "html").alias("reason"))


def _cleaned(s: SparkSession, d: str) -> DataFrame:
    return _documents(s, d).select("doc_id", markdown.clean_markdown(F.col("text")).alias("cleaned"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return chunked(_documents(s, d))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_vectors").dropDuplicates(["vec_id"])


def _index_changes(s: SparkSession, d: str) -> DataFrame:
    """The collection as stored, against the files as they are read now: each first chunk has another text, and so
    another id, and files whose path has a length divisible by seven are gone."""
    stored = _vectors(s, d).select("source", "id", "chunk_index")
    current = stored.where("length(source) % 7 <> 0").withColumn("id", F.when(F.col("chunk_index") == 0, F.md5("id")).otherwise(F.col("id")))
    new, stale, gone = search.index_changes(stored, current, current.select("source").distinct())
    parts = [df.select("source", "id", F.lit(n).alias("change")) for n, df in (("new", new), ("stale", stale), ("pruned", gone))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _embeddings(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").withColumn("collection", (F.col("label") % 3).cast("string"))


def _queries(vectors: DataFrame) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _knn(s: SparkSession, d: str) -> DataFrame:
    vectors = _embeddings(s, d)
    return search.nearest(_queries(vectors), vectors, 5).withColumn("distance", F.round("distance", 6))


def _knn_collections(s: SparkSession, d: str) -> DataFrame:
    vectors = _embeddings(s, d)
    hits = search.nearest(_queries(vectors), vectors, 5, collection="collection")
    top = search.merged(hits, 5)
    return top.select("query_id", "vec_id", "collection", "rank", F.round(search.confidence(F.col("distance")), 4).alias("confidence"))


def _knn_chunks(s: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(s, d).select("vec_id", "embedding")
    return search.nearest(_queries(vectors), vectors, 5).select("query_id", "vec_id", "rank")


def _ranks(s: SparkSession, d: str) -> DataFrame:
    vectors = _embeddings(s, d)
    hits = search.nearest(_queries(vectors), vectors, 26).where("vec_id <> query_id")
    labelled = hits.join(vectors.select("vec_id", F.col("label").alias("source")), "vec_id")
    expected = _queries(vectors).join(vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("source")), "query_id").select("query_id", "source")
    return search.rank_of_expected(search.ranked_sources(labelled), expected)


def _crawl(s: SparkSession, d: str) -> DataFrame:
    """From each domain's first page: a page's links are those of the files that link it, within its domain.

    A file's pages are met through the file, so that a file with many makes no product."""
    domains = _pages(s, d, "domain")
    linked = cut_lineage(_links(s, d).select("url", "file_path").join(domains, "url"))
    seeds = domains.groupBy("domain").agg(F.min("url").alias("url"))

    def links_of(frontier: DataFrame) -> DataFrame:
        files = linked.join(frontier, "url", "left_semi").select("file_path", "domain").distinct()
        return linked.join(files, ["file_path", "domain"], "left_semi").select(F.col("url").alias("link"))

    return crawl.crawl(seeds, links_of, 2)


def _top_domain(s: SparkSession, d: str) -> str:
    return _pages(s, d, "domain").groupBy("domain").count().orderBy(F.desc("count"), "domain").first()["domain"]


def _rule_actions(s: SparkSession, d: str) -> DataFrame:
    """Every kind of match and of action, on the pages as they are."""
    top = _top_domain(s, d)
    rules = parse_rules(rf"""
[[rule]]
name = "no blog of its own"
type = "host"
match = "blog.{top}"
  [[rule.action]]
  type = "replace"
  old = "://blog."
  new = "://"
[[rule]]
name = "by way of a mirror"
type = "starts_with"
match = "https://docs."
  [[rule.action]]
  type = "prepend"
  text = "https://mirror.example/"
[[rule]]
name = "a year is enough"
type = "regex"
match = '^https://[^/]+/\d{{4}}/\d\d/'
  [[rule.action]]
  type = "regex_replace"
  pattern = '/(\d{{4}})/\d\d/'
  replacement = "/$1/"
[[rule]]
name = "not this site"
type = "domain"
match = "{top}"
  [[rule.action]]
  type = "skip"
  reason = "too much of it"
""")
    return verdicts.with_verdict(_pages(s, d, "url"), "url", rules)


def _run_failures(s: SparkSession, d: str) -> DataFrame:
    """The ten most frequent failures among the pages of one run: those of one source's links."""
    run = _links(s, d).where(F.col("source_name") == _source(s, d))
    return catalog.run_failures(_pages(s, d, "domain", "fail_reason"), run)


def _fetch_errors(s: SparkSession, d: str) -> DataFrame:
    """What a browser may say of each page, in short, and whether it is worth another attempt."""
    said = ("Timeout 30000ms exceeded.", "net::ERR_NAME_NOT_RESOLVED at https://x\nCall log", "net::ERR_CONNECTION_REFUSED", "net::ERR_CONNECTION_RESET at", "odd\nmore", "timeout")
    message = F.element_at(F.array(*map(F.lit, said)), F.length("url") % len(said) + 1)
    rows = _pages(s, d, "url").select("url", message.alias("message"))
    return rows.select("url", html.fetch_error(F.col("message")).alias("reason"), transient(F.col("message")).alias("again"))


def _site_html() -> F.Column:
    """HTML of a page, of a size and with a number of words that follow from its address."""
    n = F.length("url")
    return F.concat(
        F.lit("<html><head><title> "), F.coalesce("title", F.lit("")), F.lit(" </title><style>"), F.repeat(F.lit("x"), 20 * (n % 31)), F.lit("</style></head><body><nav>Home</nav><h1>"), F.col("slug"),
        F.lit("</h1><p>"), F.repeat(F.lit("plain words here "), n % 23), F.lit("</p><ul><li>first</li><li>second</li></ul><footer>the end</footer></body></html>"),
    )


def _parsed_pages(s: SparkSession, d: str) -> DataFrame:
    pages = _pages(s, d, "slug", "title", "content_type")
    return parse.parsed(pages, pages.select("slug", _site_html().alias("html")))


def _page_links(s: SparkSession, d: str) -> DataFrame:
    """Links of a page that names its address, a neighbour and a mail address."""
    body = F.concat(F.lit("<p><a href=\""), F.col("url"), F.lit("\">x</a> <a href=\"/next\">y</a> <a href=\"mailto:a@b.example\">z</a></p>"))
    rows = _pages(s, d, "url").withColumn("html", body)
    return rows.select("url", F.explode(page_links("html", "url")).alias("link"))


class LetterShares:
    """An embedder that a reader can follow: how often each letter of the alphabet occurs."""

    dimension = 26

    def embed(self, texts: list[str]) -> np.ndarray:
        counts = np.array([[t.lower().count(c) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts], float)
        counts[counts.sum(axis=1) == 0, 0] = 1
        return counts / np.linalg.norm(counts, axis=1, keepdims=True)


def _embedded(s: SparkSession, d: str) -> DataFrame:
    vectors = _vectors(s, d).select("vec_id", embedded(F.col("document"), LetterShares()).alias("v"))
    return vectors.select("vec_id", F.posexplode("v").alias("letter", "share")).select("vec_id", "letter", F.round(F.col("share").cast("double"), 3).alias("share"))


def _plain_steps(s: SparkSession, d: str) -> DataFrame:
    """The steps of the clean-up that need no look-around."""
    return _documents(s, d).select("doc_id", markdown.clean_markdown(F.col("text"), ("missing spaces",)).alias("spaced"))


def _chunk_checks(s: SparkSession, d: str) -> DataFrame:
    """Of each document with chunks: that they are numbered without a gap, no longer than they may be, in order of
    their lines and addressed by their content."""
    docs = _documents(s, d)
    chunks = chunked(docs)
    own = F.sha2(F.concat_ws(":", "source", F.col("index").cast("string"), F.col("line").cast("string"), "text"), 256)
    made = chunks.groupBy("source").agg(
        F.count("*").alias("chunks"), F.max("index").alias("last"), F.max(F.length("text") - F.length("heading")).alias("longest"),
        F.min((F.col("id") == own).cast("int")).alias("addressed"), F.transform(F.sort_array(F.collect_list(F.struct("index", "line"))), lambda x: x["line"]).alias("lines"),
    )
    rows = docs.select(F.col("file_path").alias("source")).join(made, "source")
    return rows.select(
        "source", (F.col("last") == F.col("chunks") - 1).alias("numbered"), (F.col("longest") <= 1200 + 200 + 2).alias("short"),
        (F.col("addressed") == 1).alias("addressed"), (F.col("lines") == F.sort_array("lines")).alias("in_order"),
    )


def _stream_windows(s: SparkSession, d: str) -> DataFrame:
    rows = events.streamed_table(events.windowed(events.read_stream(s, d, "events")))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def queries() -> dict[str, Query]:
    links = _links
    return {
        "status_by_domain": _of(("domain", *STATE), lambda p: catalog.status_by(p, "domain")),
        "status_counts": _of(STATE, catalog.status_counts),
        "page_states": _of(STATE, lambda p: p.select("url", catalog.state().alias("state"))),
        "fail_summary": _of(("domain", "fail_reason"), catalog.fail_summary),
        "duplicate_slugs": _of(("slug",), catalog.duplicate_slugs),
        "shared_folders": _of(("slug",), lambda p: catalog.duplicate_slugs(p.withColumn("slug", F.regexp_replace("slug", "-[0-9a-f]{16}$", "")))),
        "list_newest": lambda s, d: catalog.list_fetched(_pages(s, d, "fetched_at"), limit=20).select("url", "fetched_at"),
        "list_of_source": lambda s, d: catalog.list_fetched(_pages(s, d, "domain", "fetched_at"), _links(s, d), source=_source(s, d)).select("url", "domain", "fetched_at"),
        "unparsed": _of(STATE, lambda p: p.where(catalog.unparsed()).select("url")),
        "fetch_candidates": lambda s, d: catalog.candidates(_links(s, d).groupBy("url").agg(F.min("url").alias("original_url")), _pages(s, d, "original_url", "fetched_at", "fail_reason")),
        "linked_failures": lambda s, d: catalog.failures_for(_pages(s, d, "fail_reason"), _links(s, d)).select("url", "fail_reason"),
        "prune_failed": _prune("failed"),
        "prune_missing": _prune("missing"),
        "links_after_prune": _pruned_links,
        "exclusive_pages": lambda s, d: catalog.exclusive_pages(_pages(s, d, "url"), _links(s, d), _source(s, d)).select("url"),
        "dangling_links": lambda s, d: catalog.dangling_links(_links(s, d), _pages(s, d, "url"), table(s, d, "sources")).select("url", "file_path", "missing"),
        "dangling_after_prune": lambda s, d: catalog.dangling_links(_links(s, d), _pages(s, d, "fail_reason").where("fail_reason is null"), table(s, d, "sources").where("name <> '" + _source(s, d) + "'")).select("url", "file_path", "missing"),
        "newest_links": _on(links, lambda x: x),
        "replace_links": _replace_links,
        "remove_source": lambda s, d: catalog.remove_source(table(s, d, "sources"), _links(s, d), _source(s, d))[1],
        "upsert_pages": _upsert,
        "insert_absent": _insert_absent,
        "diverted_pages": _diverted,
        "url_verdicts": _verdicts,
        "registered_urls": _registered,
        "url_parts": _of(("url",), lambda p: p.select("url", urls.domain_for_url(F.col("url")).alias("filed"), urls.slug_for_url(F.col("url")).alias("made_slug"), urls.is_pdf_url(F.col("url")).alias("pdf"), urls.is_raw_text_url(F.col("url")).alias("raw_text"))),
        "note_urls": _note_urls,
        "html_checks": _html_checks,
        "too_short": _too_short,
        "clean_markdown": _cleaned,
        "chunks": _chunks,
        "index_changes": _index_changes,
        "collections": _on(_vectors, lambda v: search.collections(v)),
        "collection_roots": lambda s, d: search.collections(_vectors(s, d), table(s, d, "sources").select(F.col("name").alias("collection"), F.col("path").alias("root"))),
        "knn": _knn,
        "knn_collections": _knn_collections,
        "knn_chunks": _knn_chunks,
        "retrieval_ranks": _ranks,
        "retrieval_metrics": lambda s, d: search.metrics(_ranks(s, d)),
        "imperfect_queries": lambda s, d: search.imperfect(_ranks(s, d)),
        "crawl": _crawl,
        "rule_actions": _rule_actions,
        "run_failures": _run_failures,
        "fetch_errors": _fetch_errors,
        "parsed_pages": _parsed_pages,
        "page_links": _page_links,
        "embedded_chunks": _embedded,
        "markdown_spaces": _plain_steps,
        "chunk_checks": _chunk_checks,
        "event_windows": lambda s, d: events.windowed(table(s, d, "events")).withColumn("total", F.round("total", 2)),
        "event_sliding_windows": lambda s, d: events.windowed(table(s, d, "events"), "2 days", slide="1 day").select("start", "event_type", "n"),
        "event_sessions": lambda s, d: events.sessions(table(s, d, "events")),
        "stream_event_windows": _stream_windows,
    }
