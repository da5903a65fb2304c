"""The converted pages as the text operators see them.

A text is shuffled once, by result_id. Whatever needs the domain is worked out
on narrow rows and met with the text in place, so no partition of texts is a
domain's and a large domain makes no large task. Operators count in a first
pass over the texts and decide in a second, which reads the same shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import written

_WORDS = re.compile(r"[^\W\d_]+")


def line_key(line: str) -> str:
    """``line`` in lower case, each run of characters that are no letters one space, trimmed."""
    low = line.lower()
    key = " ".join(_WORDS.findall(low))
    if not key.isascii() and not key.replace(" ", "").isalpha():  # signs that count as alphanumeric only
        key = " ".join("".join(c if c.isalpha() else " " for c in low).split())
    return key


def hash64(text: str | bytes, seed: int = 0) -> int:
    """A stable signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(text, seed)
    return h - (1 << 64) if h >> 63 else h


#: Repeats of one row that may meet in a task.
REPEATS = 1000


def settled(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` in which keys with more than ``REPEATS`` rows have each row once.

    Operators drop exact repeats where they meet, in the partition of their key. A row
    that is delivered over and over would make that partition large, so it is reduced
    to one here, first within each task. Nothing but exact repeats is dropped, here or
    there, so results do not depend on the number. Such keys are few, and counting finds
    that there are none at the price of one narrow aggregation.
    """
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > REPEATS).select(key)
    if hot.isEmpty():
        return rows
    hot = written(hot)
    return rows.join(hot, key, "left_anti").unionByName(rows.join(hot, key, "left_semi").distinct())


def places(conversions: DataFrame, pages: DataFrame) -> DataFrame:
    """(result_id, domain, content_type, n_domain): where each result with text
    comes from and how many results with text its domain has.

    A url that ``pages`` lacks takes the last two labels of its own host as
    domain; without any host the domain is the empty string. Rows without
    result_id or text are left out; repeats count once.
    """
    keys = (
        conversions.where(F.col("result_id").isNotNull() & F.col("md_content").isNotNull())
        .select("result_id", "url")
        .groupBy("result_id")
        .agg(F.min("url").alias("url"))
    )
    known = pages.where("url is not null").groupBy("url").agg(F.max("domain").alias("domain"), F.max("content_type").alias("content_type"))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-z]+://(?:[^/?#]*\.)?([^./?#@:]+\.[^./?#@:]+)(?::\d+)?(?:[/?#]|$)", 1)
    placed = keys.join(known, "url", "left").select(
        "result_id", F.coalesce("domain", host).alias("domain"), F.coalesce("content_type", F.lit("html")).alias("content_type")
    )
    sizes = placed.groupBy("domain").agg(F.count("*").alias("n_domain"))
    return placed.join(sizes, "domain").select("result_id", "domain", "content_type", "n_domain")


def beside_text(conversions: DataFrame, narrow: DataFrame) -> DataFrame:
    """``narrow`` (one row for each result_id) with md_content.

    The narrow side is the hash table, so the texts are shuffled but not sorted.
    A repeated row stays next to its twin, in one partition, where ``unique`` drops it.
    """
    text = conversions.where(F.col("result_id").isNotNull() & F.col("md_content").isNotNull()).select("result_id", "md_content")
    return text.join(narrow.hint("shuffle_hash"), "result_id")


def unique(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The values of ``columns`` of each row, of which the first is its key and the second its text; exact repeats
    of both are dropped, and rows of one key with different texts are not."""
    seen: set = set()
    for batch in slices(batches, 1000):
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if (own := (row[0], hash(row[1]))) not in seen:
                seen.add(own)
                yield row


def distinct_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """``batches`` of rows with result_id and md_content in parts, without the exact repeats of both."""
    seen: set = set()
    for batch in slices(batches, rows):
        keys = [(rid, hash(text)) for rid, text in zip(batch.column("result_id").to_pylist(), batch.column("md_content").to_pylist())]
        new = dict.fromkeys(keys)
        if len(new) < len(keys) or not seen.isdisjoint(new):
            at = [i for i, key in enumerate(keys) if key not in seen and not seen.add(key)]
            batch = batch.take(pa.array(at, pa.int64()))
        else:
            seen.update(new)
        if batch.num_rows:
            yield batch


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of so many rows, so that few of them are held as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def rows_to_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``rows``, made as they come."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if not pa.types.is_list(kind) or pa.types.is_list(kind.value_type) or None in values:
        return pa.array(values, kind)
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(list(chain.from_iterable(values)), kind.value_type))
