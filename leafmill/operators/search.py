"""Search over vectors: exact nearest neighbours, ranking, index maintenance and evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries, and bytes of their vectors, that go to the tasks at once, and distances that a task holds at once.
QUERY_BLOCK = 100_000
QUERY_BYTES = 64 << 20
DISTANCES = 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null if either vector is all zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def confidence(distance: Column) -> Column:
    """Per cent, from 0."""
    return F.greatest(F.lit(0.0), (1 - distance) * 100)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", key: str = "vec_id", vector: str = "embedding", collection: str | None = None) -> DataFrame:
    """(query_id, key[, collection], distance, rank) of the ``k`` nearest vectors of each query, exactly.

    The queries, a stated set and small beside the vectors, go to all tasks, which
    compare them with their vectors as matrix products and keep the k best of each
    query, so that k rows for each query, task and collection are shuffled. One pass
    over the vectors answers up to ``QUERY_BLOCK`` queries of ``QUERY_BYTES``, and more
    take a pass for each so many. Ties go to the smaller key. Null and all-zero vectors neither
    ask nor answer. With ``collection`` the ranks are by collection.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    group = [collection] if collection else []
    found = None
    for block in _blocks(queries.select(query_id, F.col(vector).alias("q")).where("q is not null")):
        ids = block[query_id].tolist()
        matrix = np.array(block["q"].tolist(), dtype=np.float64)
        norms = np.sqrt((matrix**2).sum(axis=1))
        ids, unit = [i for i, n in zip(ids, norms) if n > 0], matrix[norms > 0] / norms[norms > 0, None]
        if not len(ids):
            continue
        rows = vectors.select(key, *group, F.col(vector).alias("v")).where(F.col("v").isNotNull() & F.col(key).isNotNull())
        types = dict(vectors.dtypes) | dict(queries.dtypes)
        schema = f"{query_id} {types[query_id]}, {key} {types[key]}, " + "".join(f"{g} {types[g]}, " for g in group) + "distance double"
        part = rows.mapInArrow(_best(ids, unit, k, query_id, key, group), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"{query_id} long, {key} long, distance double, rank int")
    window = Window.partitionBy(query_id, *group).orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in queries.toLocalIterator():
        held.append(row.asDict())
        size += 8 * len(row["q"])
        if len(held) >= QUERY_BLOCK or size >= QUERY_BYTES:
            yield pd.DataFrame(held)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held)


def _best(ids: list, unit: np.ndarray, k: int, query_id: str, key: str, group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, tuple[np.ndarray, list, np.ndarray]] = {}  # of each group: query, key and distance of the best so far
        for batch in batches:
            vectors = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            norms = np.sqrt((vectors**2).sum(axis=1))
            keys = batch.column(key).to_pylist()
            groups = list(zip(*(batch.column(g).to_pylist() for g in group))) if group else [()] * len(keys)
            members: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                if norms[i] > 0:
                    members.setdefault(g, []).append(i)
            for g, at in members.items():
                at = np.array(at)
                v = (vectors[at] / norms[at, None]).T
                step = max(1, DISTANCES // len(at))
                parts = []
                for first in range(0, len(ids), step):
                    distance = np.round(1 - unit[first : first + step] @ v, 12)
                    most = np.partition(distance, k - 1, axis=1)[:, k - 1 : k] if len(at) > k else np.inf
                    q, i = np.nonzero(distance <= most)
                    parts.append((q + first, at[i], distance[q, i]))
                q, i, d = (np.concatenate(x) for x in zip(*parts))
                old = kept.get(g)
                names = [keys[j] for j in i.tolist()]
                if old:
                    q, d, names = np.concatenate([old[0], q]), np.concatenate([old[2], d]), old[1] + names
                place = {n: r for r, n in enumerate(sorted(set(names)))}
                order = np.lexsort((np.fromiter(map(place.__getitem__, names), np.int64, len(names)), d, q))
                q = q[order]
                begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
                first_k = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q)))) < k
                order = order[first_k]
                kept[g] = q[first_k], [names[j] for j in order.tolist()], d[order]
        for g, (q, names, d) in kept.items():
            columns = {query_id: [ids[j] for j in q.tolist()], key: names} | {c: [x] * len(names) for c, x in zip(group, g)} | {"distance": d}
            yield pa.RecordBatch.from_pandas(pd.DataFrame(columns), preserve_index=False)

    return run


def merged(hits: DataFrame, k: int, query_id: str = "query_id", key: str = "vec_id") -> DataFrame:
    """The ``k`` best hits of all collections together, ranked from 1; ties by collection, then key."""
    window = Window.partitionBy(query_id).orderBy("distance", "collection", key)
    return hits.drop("rank").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def ranked_sources(hits: DataFrame, query_id: str = "query_id", source: str = "source") -> DataFrame:
    """(query_id, source, source_rank): sources by their best hit, each once."""
    best = hits.groupBy(query_id, source).agg(F.min("rank").alias("rank"))
    window = Window.partitionBy(query_id).orderBy("rank", source)
    return best.select(query_id, source, F.row_number().over(window).alias("source_rank"))


def rank_of_expected(sources: DataFrame, expected: DataFrame, query_id: str = "query_id", source: str = "source") -> DataFrame:
    """(query_id, rank): of each query in ``expected``, the rank of its first expected source, null if missed."""
    hit = sources.join(expected.select(query_id, source), [query_id, source]).groupBy(query_id).agg(F.min("source_rank").alias("rank"))
    return expected.select(query_id).distinct().join(hit, query_id, "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """One row: queries, hit_at_1, hit_at_3, hit_at_5 and mrr, to three digits, zeros without queries."""

    def to_3(c: Column) -> Column:
        return F.coalesce(F.bround(c, 3), F.lit(0.0))

    hits = [to_3(F.avg(F.when(F.col("rank") <= n, 1.0).otherwise(0.0))).alias(f"hit_at_{n}") for n in (1, 3, 5)]
    return ranks.agg(F.count("*").alias("queries"), *hits, to_3(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"))


def imperfect(ranks: DataFrame) -> DataFrame:
    """Queries not at rank 1: misses first, then the worst."""
    return ranks.where(F.col("rank").isNull() | (F.col("rank") > 1)).orderBy(F.col("rank").isNotNull(), F.desc("rank"))


def index_changes(stored: DataFrame, current: DataFrame, walked: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, stale, pruned) chunks of an index, by (source, id).

    New: not stored. Stale: stored under a source that was read, and no longer in
    it. Pruned: stored under a source that is not in ``walked``; nothing is pruned
    without ``walked``, or if the walk found nothing. A file that could not be read
    is in ``walked`` but not in ``current`` and keeps its chunks.
    """
    keys = ["source", "id"]
    new = current.join(stored.select(*keys), keys, "left_anti")
    read = current.select("source").distinct()
    stale = stored.join(read, "source", "left_semi").join(current.select(*keys), keys, "left_anti")
    if walked is None or walked.isEmpty():
        return new, stale, stored.limit(0)
    return new, stale, stored.join(walked.select("source"), "source", "left_anti")


def collections(vectors: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(collection, chunks, files[, root]) of each collection."""
    rows = vectors.groupBy("collection").agg(F.count("*").alias("chunks"), F.count_distinct("source").alias("files"))
    return rows.join(roots, "collection", "left") if roots is not None else rows
