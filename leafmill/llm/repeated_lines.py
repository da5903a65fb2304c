"""Problem 1: lines repeated across the documents of one site.

Every task parses its lines into token trees of fixed depth, one for each
domain: the first level is the number of tokens, the next ``DEPTH`` levels are
the first tokens, and a leaf holds the keys below it and a template, in which a
position whose token varies is a wildcard slot. Trees are merged across tasks by
adding the counts and widening the slots of equal leaves. A merged leaf that
covers fewer results than make a line excessive holds none and is pruned before
any key is counted across tasks; the keys of the others are counted exactly, and
a second pass over the texts finds their lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.corpus import beside_text, hash64, line_key, places, rows_to_batches, settled, unique
from leafmill.session import written

#: Tokens that lead to a leaf, after the number of tokens.
DEPTH = 2
#: Positions of a template that are kept; a longer line ends in a wildcard.
SLOTS = 12
WILDCARD = "<*>"
#: An excessive line occurs in at least so many results of its domain ...
MIN_RESULTS = 5
#: ... and in at least one of so many.
ONE_OF = 5
#: Keys a task holds before it hands its trees on; more only means more rows to merge.
HELD_KEYS = 200_000

_TREE = pa.schema([("domain", pa.string()), ("least", pa.int64()), ("leaf", pa.int64()), ("template", pa.string()), ("key", pa.int64()), ("results", pa.int64())])


class TokenTree:
    """The token trees of a task: domain -> number of tokens and first tokens -> leaf."""

    def __init__(self) -> None:
        self.leaves: dict[tuple, list] = {}
        self.size = 0

    def add(self, domain: str, least: int, key: str) -> None:
        tokens = key.split(" ")
        path = (domain, len(tokens), *tokens[:DEPTH])
        leaf = self.leaves.get(path)
        if leaf is None:
            leaf = self.leaves[path] = [least, tokens[:SLOTS], {}]
        elif key not in leaf[2]:
            leaf[1] = widen(leaf[1], tokens)
        counts = leaf[2]
        if key in counts:
            counts[key] += 1
        else:
            counts[key] = 1
            self.size += 1

    def rows(self) -> Iterator[tuple]:
        for path, (least, slots, counts) in self.leaves.items():
            leaf = hash64("\x00".join(map(str, path)))
            template = " ".join(slots) + (" " + WILDCARD if path[1] > SLOTS else "")
            for key, n in counts.items():
                yield path[0], least, leaf, template, hash64(key), n
                template = None  # once for each leaf of a task
        self.__init__()


def widen(slots: list[str], tokens: list[str]) -> list[str]:
    """``slots`` with a wildcard wherever ``tokens`` differs."""
    return [a if a == b else WILDCARD for a, b in zip(slots, tokens)]


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        tree = TokenTree()
        for _rid, md, domain, n in unique(batches, "result_id", "md_content", "domain", "n_domain"):
            least = max(MIN_RESULTS, -(-n // ONE_OF))
            for key in {line_key(line) for line in md.split("\n")} - {""}:
                tree.add(domain, least, key)
            if tree.size > HELD_KEYS:
                yield from tree.rows()
        yield from tree.rows()

    return rows_to_batches(rows(), _TREE)


def token_trees(conversions: DataFrame, where: DataFrame) -> DataFrame:
    """(domain, least, leaf, template, key, results): the leaves of every task's trees.

    ``least`` is the number of results that make a line of the domain excessive.
    A task makes at most one row for each key, so a frequent line is no frequent
    row, and gives the template of a leaf in one of its rows. Written once: merging
    the trees and counting the keys read columns of it.
    """
    texts = beside_text(conversions, where.where("domain <> ''").select("result_id", "domain", "n_domain"))
    return written(texts.mapInArrow(_trees, "domain string, least long, leaf long, template string, key long, results long"))


def merged_templates(trees: DataFrame) -> DataFrame:
    """(domain, template, covered, keys) of every merged leaf that may hold an excessive line.

    ``covered`` adds up the results of the leaf's keys, so it is never less than
    those of any one of them. A slot that is not the same in all trees is a wildcard.
    """
    slots = F.collect_set(F.split("template", " "))
    merged = trees.groupBy("domain", "leaf", "least").agg(slots.alias("all"), F.sum("results").alias("covered"), F.count_distinct("key").alias("keys"))
    first = F.get("all", F.lit(0))
    template = F.transform(first, lambda t, i: F.when(F.forall("all", lambda x: F.get(x, i) == t), t).otherwise(F.lit(WILDCARD)))
    return merged.where("covered >= least").select("domain", F.array_join(template, " ").alias("template"), "covered", "keys")


def merged_leaves(trees: DataFrame) -> DataFrame:
    """(leaf) of the merged trees that cover enough results to hold an excessive line."""
    merged = trees.groupBy("leaf").agg(F.sum("results").alias("covered"), F.max("least").alias("least"))
    return merged.where("covered >= least").select("leaf")


def excessive_keys(trees: DataFrame) -> DataFrame:
    """(domain, keys): the keys of excessive lines, at most as many for a domain as five pages have lines.

    Only keys of leaves that the merged trees leave are counted.
    """
    kept = trees.select("domain", "leaf", "key", "least", "results").join(merged_leaves(trees), "leaf", "left_semi")
    counted = kept.groupBy("domain", "key").agg(F.max("least").alias("least"), F.sum("results").alias("results"))
    return counted.where("results >= least").groupBy("domain").agg(F.collect_set("key").alias("keys"))


def frequent_templates(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """``merged_templates`` of all results: the lines of a domain in few rows, of which some may be excessive."""
    conversions = settled(conversions.select("result_id", "url", "md_content"), "result_id")
    return merged_templates(token_trees(conversions, places(conversions, pages)))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for rid, md, keys in unique(batches, "result_id", "md_content", "keys"):
            keys = set(keys)
            for i, line in enumerate(md.split("\n"), 1):
                if (key := line_key(line)) and hash64(key) in keys:
                    yield rid, i

    return rows_to_batches(rows(), pa.schema([("result_id", pa.int64()), ("line_no", pa.int32())]))


def excessive_lines(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, line_no) of every occurrence of an excessive line.

    Lines without letters never count; a null text has no lines; a line counts
    once for each result however often it returns there. Results without a
    domain form no site and have no cases. An empty table gives no rows.
    """
    conversions = settled(conversions.select("result_id", "url", "md_content"), "result_id")
    where = places(conversions, pages)
    keys = excessive_keys(token_trees(conversions, where))
    marked = where.select("result_id", "domain").join(keys, "domain").select("result_id", "keys")
    return beside_text(conversions, marked).mapInArrow(_occurrences, "result_id long, line_no int")


def without_lines(conversions: DataFrame, found: DataFrame) -> DataFrame:
    """(result_id, md_content, removed): each text without the lines of ``found``.

    A text that loses every line becomes the empty string; a null text stays null.
    """
    drop = found.groupBy("result_id").agg(F.collect_set("line_no").alias("gone"))
    rows = conversions.where("result_id is not null").select("result_id", "md_content").dropDuplicates(["result_id"])
    left = F.filter(F.split("md_content", "\n"), lambda _line, i: ~F.array_contains("gone", i + 1))
    return rows.join(drop, "result_id", "left").select(
        "result_id",
        F.when(F.col("gone").isNull(), F.col("md_content")).otherwise(F.array_join(left, "\n")).alias("md_content"),
        F.coalesce(F.size("gone"), F.lit(0)).alias("removed"),
    )
