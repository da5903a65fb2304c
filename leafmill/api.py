"""The archive as one object: what the command line and programs use."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmill.functions.chunks import chunked
from leafmill.functions.links import extract_urls
from leafmill.functions.urls import domain_for_url, slug_for_url
from leafmill.operators import catalog, parse, search
from leafmill.operators.crawl import crawl, saved_page_links
from leafmill.operators.verdicts import with_verdict
from leafmill.plans.rules import DEFAULT_RULES
from leafmill.session import cut_lineage
from leafmill.sources.notes import find_notes, note_urls, read_files, read_notes
from leafmill.sources.rules import Rule
from leafmill.sources.warehouse import Warehouse, valid_collection

Embed = Callable[[list[str]], list[list[float]]]


def hashed_words(texts: list[str], size: int = 64) -> list[list[float]]:
    """A deterministic stand-in for a model: unit vectors of hashed words."""
    import numpy as np
    import xxhash

    out = np.zeros((len(texts), size))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            out[i, xxhash.xxh32_intdigest(word) % size] += 1
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class Archive:
    """Notes, pages and chunks of one warehouse. Methods commit what they change."""

    def __init__(self, spark: SparkSession, folder: str | Path, rules: list[Rule] = DEFAULT_RULES) -> None:
        self.spark = spark
        self.store = Warehouse(spark, folder)
        self.rules = rules

    def now(self) -> str:
        return datetime.now(timezone.utc).isoformat(timespec="seconds")

    # -- sources and notes

    def add_source(self, name: str, path: str) -> bool:
        sources = self.store.table("sources")
        if not sources.where(F.col("name") == name).isEmpty():
            return False
        row = self.spark.createDataFrame([(name, str(path), self.now())], sources.schema)
        self.store.commit(sources=sources.unionByName(row))
        return True

    def remove_source(self, name: str, with_pages: bool = False) -> None:
        pages, links = self.store.table("pages"), self.store.table("links")
        if with_pages:
            pages, links = catalog.without(pages, links, catalog.exclusive_pages(pages, links, name))
        sources, links = catalog.remove_source(self.store.table("sources"), links, name)
        self.store.commit(pages=pages, links=links, sources=sources)

    def index(self, folder: str | Path, source: str | None = None) -> int:
        """Reads the notes below ``folder``, which may be one note: registers their URLs and replaces their links. URLs found."""
        return self._index(folder, source).count()

    def index_all(self) -> int:
        """Reads every source, in order of their names; a URL of several is registered by the first. URLs found, each once."""
        found = [self._index(r["path"], r["name"]).select("url") for r in self.store.table("sources").orderBy("name").collect()]
        return reduce(DataFrame.unionByName, found).distinct().count() if found else 0

    def _index(self, folder: str | Path, source: str | None) -> DataFrame:
        notes, _bad = read_notes(self.spark, folder, source)
        raw = cut_lineage(note_urls(notes))
        told = cut_lineage(with_verdict(raw, "raw", self.rules).where("target is not null"))
        order = F.struct("ord", "pos", "raw")
        found = told.groupBy(F.col("target").alias("url")).agg(F.min(order)["raw"].alias("original_url"))
        self._register(found, links=told.select(F.col("target").alias("url"), "file_path", "source_name").distinct(), files=notes.select("file_path"))
        return found

    def register(self, urls: list[str]) -> int:
        """Adds URLs given directly; the first of several forms of one is its original."""
        if not urls:
            return 0
        raw = self.spark.createDataFrame(pd.DataFrame({"ord": range(len(urls)), "raw": urls}))
        told = with_verdict(raw, "raw", self.rules).where("target is not null")
        found = cut_lineage(told.groupBy(F.col("target").alias("url")).agg(F.min_by("raw", "ord").alias("original_url")))
        self._register(found)
        return found.count()

    def _register(self, found: DataFrame, links: DataFrame | None = None, files: DataFrame | None = None) -> None:
        new = found.withColumn("domain", domain_for_url(F.col("url"))).withColumn("slug", slug_for_url(F.col("url"), F.col("domain")))
        new = new.withColumn("added_at", F.lit(self.now())).withColumn("word_count", F.lit(0).cast("long"))
        changes = {"pages": catalog.insert_absent(self.store.table("pages"), new)}
        if not catalog.duplicate_slugs(changes["pages"]).isEmpty():
            raise ValueError("two urls have one slug: nothing was registered")
        if links is not None:
            changes["links"] = catalog.replace_links(self.store.table("links"), links.withColumn("indexed_at", F.lit(self.now())), files)
        self.store.commit(**changes)

    # -- fetching from a snapshot, parsing, crawling

    def fetch(self, snapshot: DataFrame, refetch: bool = False) -> DataFrame:
        """Takes pending pages (or all) from ``snapshot`` (url, content_type, html, pdf, error): the
        connector to a network is a table that another job fills. What it lacks fails."""
        pages = self.store.table("pages")
        todo = catalog.candidates(pages.select("url", "original_url"), pages, refetch)
        got = cut_lineage(todo.join(snapshot, "url", "left").join(pages.select("url", "domain", "slug"), "url"))
        ok = F.col("error").isNull() & (F.col("html").isNotNull() | F.col("pdf").isNotNull())
        new = got.select(
            "url", "original_url", "domain", "slug", F.when(ok, F.coalesce("content_type", F.lit("html"))).alias("content_type"),
            F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("author"), F.lit(0).cast("long").alias("word_count"),
            F.when(~ok, F.coalesce("error", F.lit("not in the snapshot"))).alias("fail_reason"), F.lit(self.now()).alias("added_at"),
            F.when(ok, F.lit(self.now())).alias("fetched_at"), F.lit(None).cast("string").alias("parsed_at"),
        )
        raw = catalog.upsert(self.store.table("raw_pages"), got.where(ok).select("slug", F.coalesce("content_type", F.lit("html")).alias("content_type"), "html", "pdf"), "slug", keep=())
        self.store.commit(pages=catalog.upsert(pages, new), raw_pages=raw)
        return new

    def parse(self, reparse: bool = False) -> int:
        pages = self.store.table("pages")
        todo = pages.where(F.col("fetched_at").isNotNull() if reparse else catalog.unparsed())
        done = cut_lineage(parse.parsed(todo, self.store.table("raw_pages")))
        good = done.where("markdown is not null")
        kept = self.store.table("parsed_pages").join(good.select("slug"), "slug", "left_anti")
        self.store.commit(pages=parse.recorded(pages, done, self.now()), parsed_pages=kept.unionByName(good.select("slug", "markdown")))
        return good.count()

    def crawl(self, seeds: DataFrame, depth: int) -> DataFrame:
        return crawl(seeds, saved_page_links(self.store.table("pages"), self.store.table("raw_pages"), self.rules), depth)

    # -- catalog

    def status(self) -> tuple[DataFrame, DataFrame]:
        pages = self.store.table("pages")
        return catalog.status_counts(pages), catalog.fail_summary(pages)

    def list(self, **options) -> DataFrame:
        return catalog.list_fetched(self.store.table("pages"), self.store.table("links"), **options)

    def prune(self, mode: str, dry_run: bool = False) -> DataFrame:
        """(slug) of the pages removed, in order; with ``dry_run`` of those that would be."""
        pages, links = self.store.table("pages"), self.store.table("links")
        victims = cut_lineage(catalog.prune_victims(pages, links, mode).select("url", "slug"))
        if not dry_run and not victims.isEmpty():
            pages, links = catalog.without(pages, links, victims)
            gone = victims.select("slug")
            changed = {n: self.store.table(n).join(gone, "slug", "left_anti") for n in ("raw_pages", "parsed_pages")}
            self.store.commit(pages=pages, links=links, **changed)
        return victims.select("slug").orderBy("slug")

    def page(self, url: str) -> dict:
        """The parsed page of a URL, given as stored or in another form; LookupError says why not."""
        pages = self.store.table("pages")
        target = with_verdict(self.spark.createDataFrame([(url,)], "u string"), "u", self.rules).first()["target"]
        found = {r["url"]: r for r in pages.where(F.col("url").isin([u for u in (url, target) if u])).collect()}
        row = found.get(url) or found.get(target)
        if row is None:
            raise LookupError(f"not in the archive: {url}")
        for wrong, why in ((row["fail_reason"], row["fail_reason"]), (not row["fetched_at"], "not fetched yet"), (not row["parsed_at"], "not parsed yet")):
            if wrong:
                raise LookupError(f"{why}: {row['url']}")
        text = self.store.table("parsed_pages").where(F.col("slug") == row["slug"]).first()
        if text is None:
            raise LookupError(f"its text is missing: {row['url']}")
        return row.asDict() | {"markdown": text["markdown"]}

    def extract(self, paths: list[str]) -> DataFrame:
        """(url) of the URLs in some files, in order, each once."""
        files = read_files(self.spark, paths)
        rows = files.where("error is null").select("ord", F.posexplode(extract_urls(F.col("content").cast("string"))).alias("pos", "url"))
        return rows.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").select("url")

    # -- search

    def index_documents(self, folder: str | Path, collection: str, embed: Embed = hashed_words, prune: bool = True) -> tuple[int, int, int]:
        """Brings a collection up to date with the markdown below ``folder``: (files, new chunks, pruned chunks)."""
        if not valid_collection(collection):
            raise ValueError(f"invalid collection name: {collection}")
        root = str(Path(folder).resolve())
        roots = self.store.table("roots")
        pinned = roots.where(F.col("collection") == collection).first()
        if pinned and pinned["root"] != root:
            raise ValueError(f"collection {collection} belongs to {pinned['root']}")
        paths = find_notes(root, (".md",))
        relative = F.regexp_replace("file_path", "^" + _quoted(root) + "/", "")
        files = read_files(self.spark, paths).select(relative.alias("file_path"), F.col("content").cast("string").alias("text"), "error")
        current = cut_lineage(chunked(files.where("error is null and is_valid_utf8(text)")))
        mine = self.store.table("vectors", collection)
        walked = files.select(F.col("file_path").alias("source")) if prune else None
        new, stale, gone = (cut_lineage(x) for x in search.index_changes(mine, current, walked))
        drop = stale.select("source", "id").unionByName(gone.select("source", "id"))
        added = _embedded(new, embed).withColumn("collection", F.lit(collection))
        columns = mine.columns
        kept = mine.join(drop, ["source", "id"], "left_anti").select(columns)
        changes = {"vectors": {collection: kept.unionByName(added.select(columns))}} if not (new.isEmpty() and drop.isEmpty()) else {}
        if paths and not pinned:
            changes["roots"] = roots.unionByName(self.spark.createDataFrame([(collection, root)], roots.schema))
        self.store.commit(**changes)
        return len(paths), new.count(), gone.count()

    def refresh(self, embed: Embed = hashed_words) -> dict[str, tuple[int, int, int] | None]:
        """Every collection brought up to date from its folder; None for one whose folder is gone, which keeps its chunks."""
        roots = {r["collection"]: r["root"] for r in self.store.table("roots").collect()}
        return {name: self.index_documents(root, name, embed) if Path(root).is_dir() else None for name, root in sorted(roots.items())}

    def evaluate(self, gold: DataFrame, embed: Embed = hashed_words, depth: int = 25) -> tuple[DataFrame, DataFrame]:
        """Metrics of the gold queries (query, expected), and (query, rank) of each: of the first expected
        source among those of the ``depth`` best chunks."""
        asked = [(i, r["query"], r["expected"]) for i, r in enumerate(gold.toLocalIterator())]
        if not asked:
            ranks = self.spark.createDataFrame([], "query_id long, query string, rank int")
            return search.metrics(ranks), ranks.select("query", "rank")
        vectors = self.store.table("vectors")
        ask = self.spark.createDataFrame([(i, q, e, v) for (i, q, e), v in zip(asked, embed([q for _, q, _ in asked]))], "query_id long, query string, expected array<string>, embedding array<float>")
        hits = search.merged(search.nearest(ask, vectors, depth, key="id", collection="collection"), depth, key="id")
        named = hits.join(vectors.select("collection", "id", "source"), ["collection", "id"])
        expected = ask.select("query_id", F.explode("expected").alias("source"))
        ranks = search.rank_of_expected(search.ranked_sources(named), expected).join(ask.select("query_id", "query"), "query_id")
        return search.metrics(ranks), ranks.select("query", "rank")

    def query(self, text: str, k: int = 5, collection: str | None = None, embed: Embed = hashed_words) -> DataFrame:
        """(rank, confidence, collection, source, line, document): the best chunks of all collections, or one."""
        vectors = self.store.table("vectors", collection)
        ask = self.spark.createDataFrame([(0, embed([text])[0])], "query_id long, embedding array<float>")
        hits = search.merged(search.nearest(ask, vectors, k, key="id", collection="collection"), k, key="id")
        rows = hits.join(vectors.select("collection", "id", "source", "line", "document"), ["collection", "id"])
        return rows.select("rank", F.bround(search.confidence(F.col("distance")), 2).alias("confidence"), "collection", "source", "line", "document").orderBy("rank")


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _embedded(chunks: DataFrame, embed: Embed) -> DataFrame:
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embed(texts.tolist()))

    return chunks.select("id", vectors("text").alias("embedding"), F.col("text").alias("document"), "source", "heading", "line", "index")
