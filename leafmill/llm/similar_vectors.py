"""Problem 4: the most similar vectors of every vector.

A hash-prefix forest. Each tree gives a vector a long string of bits, the signs
of projections beside thresholds; the strings of a tree are sorted, and each
task holds cells of the sorted arrays. Cells are cut at prefixes only, so no
subtree of up to ``CANDIDATES`` vectors lies in two. A vector's query descends to
the largest prefix that at most ``CANDIDATES`` vectors share; where fewer than
half as many do, it ascends to the prefix around that, so in every tree it meets
``CANDIDATES / 2`` others at least. Candidates are compared exactly where they
lie. Where even whole strings are shared by more, further bits are drawn inside
that run, so dense groups are split like any other, and over several tasks if
they are too large for one. The best of all trees are merged.

Projections are fitted on a bounded sample: random directions scaled by its
covariance, thresholds at its medians. Every vector is indexed and queried.
Equal directions are one entry of the index with its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.corpus import rows_to_batches
from leafmill.session import written

#: Neighbours of each vector.
K = 5
#: Trees, bits of a string (at most 63), and vectors that share the prefix a query ends at, at most.
TREES = 16
BITS = 48
CANDIDATES = 2000
#: Vectors that the projections are fitted on, at most.
SAMPLE = 4096
#: Entries of a cell of the sorted arrays, about, and vectors of the sample that a cell has at least.
RUN = 24_000
SAMPLED = 8
#: Digits to which directions must agree to be equal.
DIGITS = 6

_UNIT = pa.schema([("vec_id", pa.int64()), ("same", pa.int64()), ("unit", pa.binary())])


def _units(id_column: str, vector_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for k, v in zip(batch.column(id_column).to_pylist(), batch.column(vector_column)):
                    values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    norm = float(np.sqrt(values @ values)) if len(values) else 0.0
                    if norm > 0 and np.isfinite(norm):
                        unit = values / norm
                        key = xxhash.xxh64_intdigest((np.round(unit, DIGITS) + 0.0).tobytes())
                        yield k, key - (1 << 64) if key >> 63 else key, unit.astype(np.float32).tobytes()

        return rows_to_batches(rows(), _UNIT, 5000)

    return run


def unit_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, same, unit): vectors of length one and a hash of their direction.

    Rows without id or vector, vectors that are all zero or not finite, and vectors
    of another length than most take no part; of rows with one id that by the hash
    of its direction first counts.
    """
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull()).select(F.col(id_column).cast("long").alias(id_column), vector_column)
    lengths = rows.groupBy(F.size(vector_column).alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(1).collect()
    rows = rows.where(F.size(vector_column) == (lengths[0]["length"] if lengths else 0))
    units = rows.mapInArrow(_units(id_column, vector_column), "vec_id long, same long, unit binary")
    return units.groupBy("vec_id").agg(F.min_by("same", "same").alias("same"), F.min_by("unit", "same").alias("unit"))


def projections(units: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions and thresholds of all trees, fitted on about ``SAMPLE`` of the ``n`` vectors, those that a hash of vec_id draws; these."""
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 32)) < int((1 << 32) * min(1.0, SAMPLE / n))
    rows = units.where(drawn).select("vec_id", "unit").collect() or units.limit(1).select("vec_id", "unit").collect()
    rows.sort()
    sample = np.stack([np.frombuffer(r["unit"], np.float32) for r in rows]).astype(np.float64)
    size = sample.shape[1]
    values, axes = np.linalg.eigh(np.cov(sample.T).reshape(size, size) if len(sample) > 1 else np.eye(size))
    spread = axes * np.sqrt(np.maximum(values, 1e-9))
    rng = np.random.default_rng(4)
    directions = (spread @ rng.standard_normal((size, TREES * BITS))).astype(np.float32)
    sample = sample.astype(np.float32)
    return directions, np.median(sample @ directions, axis=0), sample


def strings_of(x: np.ndarray, directions: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The string of each vector in each tree."""
    place = (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)).astype(np.int64)
    return (x @ directions > thresholds).reshape(len(x), TREES, BITS).astype(np.int64) @ place


def cells_of(strings: np.ndarray, n: int) -> np.ndarray:
    """First strings of the cells of a tree of ``n`` entries, told from the ``strings`` of a sample.

    Prefixes of more than ``RUN`` entries are cut in two. A side that is too small
    for a cell stays with what is next to it in the other, and can ascend there.
    """
    strings = np.sort(strings)
    of_each = n / len(strings)
    least = max(SAMPLED, CANDIDATES / of_each)
    starts = [0]
    todo = [(0, len(strings), BITS - 1, 0)]
    while todo:
        low, high, bit, prefix = todo.pop()
        if bit >= 0 and (high - low) * of_each > RUN:
            middle = low + int(np.searchsorted((strings[low:high] >> bit) & 1, 1))
            if min(middle - low, high - middle) >= least:
                starts.append(prefix | 1 << bit)
            todo += [(low, middle, bit - 1, prefix), (middle, high, bit - 1, prefix | 1 << bit)]
    return np.array(sorted(starts), np.int64)


#: Of a whole string that more entries share than a cell should hold: further directions and thresholds, which cut it.
Cut = tuple[np.ndarray, np.ndarray]


def crowded(strings: np.ndarray, sample: np.ndarray, n: int, tree: int) -> dict[int, Cut]:
    """How the whole strings of a tree of ``n`` entries that are too large for a task are cut into 2, 4, ... cells, told
    from the ``strings`` of a sample: around what its vectors have in common, in each tree another way."""
    out = {}
    values, counts = np.unique(strings, return_counts=True)
    for value, count in zip(values.tolist(), counts.tolist()):
        cuts = min(int(np.ceil(np.log2(max(1.0, count * n / len(strings) / RUN)))), int(np.log2(max(1, count // SAMPLED))))
        if cuts > 0:
            own = sample[strings == value]
            rng = np.random.default_rng([tree, value, 1])
            basis = own - own.mean(axis=0)
            directions = (basis.T @ rng.standard_normal((len(own), cuts)).astype(np.float32)).astype(np.float32)
            out[value] = directions, np.median(own @ directions, axis=0)
    return out


_ENTRY = "tree int, cell int, string long, ids array<long>, unit binary"


def _strings(directions: np.ndarray, thresholds: np.ndarray, cells: list[np.ndarray] | None = None, cuts: list[dict[int, Cut]] | None = None):
    starts = cells or [np.zeros(1, np.int64)] * TREES
    first = np.cumsum([0, *map(len, starts)])
    further: list[dict[int, tuple[int, Cut]]] = []
    at = int(first[-1])
    for of_tree in cuts or [{}] * TREES:
        further.append({})
        for value, cut in of_tree.items():
            further[-1][value] = at, cut
            at += 1 << len(cut[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                unit = part.column("unit")
                x = np.stack([np.frombuffer(u, np.float32) for u in unit.to_pylist()])
                strings = strings_of(x, directions, thresholds)
                for t in range(TREES):
                    own = np.ascontiguousarray(strings[:, t])
                    cell = (first[t] + np.searchsorted(starts[t], own, side="right") - 1).astype(np.int32)
                    for value, (base, (more, above)) in further[t].items():
                        rows = np.flatnonzero(own == value)
                        if len(rows):
                            cell[rows] = base + (x[rows] @ more > above) @ (1 << np.arange(len(above)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), t, np.int32)), pa.array(cell), pa.array(own), part.column("ids"), unit], ["tree", "cell", "string", "ids", "unit"]
                    )

    return run


def prefix_runs(strings: np.ndarray, x: np.ndarray, limit: int = CANDIDATES, tree: int = 0) -> Iterator[np.ndarray]:
    """Positions of the sorted ``strings`` in groups of at most ``limit``: the largest subtrees of
    the prefix tree that are no larger, runs of one whole string being split further, in each tree another way."""
    for rows, _low, _high in queries(strings, x, limit, tree):
        yield rows


def queries(strings: np.ndarray, x: np.ndarray, limit: int = CANDIDATES, tree: int = 0) -> Iterator[tuple[np.ndarray, int, int]]:
    """The groups of ``prefix_runs``, each with the range of its candidates in ``strings``: its own,
    the prefix around it if that is less than half of ``limit``, or none for a piece of a whole string."""
    todo = [(0, len(strings), BITS - 1, 0, len(strings))]
    while todo:
        low, high, bit, around, end = todo.pop()
        if high - low <= limit:
            yield np.arange(low, high), *((low, high) if 2 * (high - low) >= limit else (around, end))
        elif bit < 0:
            for rows in _denser(np.arange(low, high), x, limit, np.random.default_rng([tree, int(strings[low])])):
                yield rows, 0, 0
        else:
            middle = low + int(np.searchsorted((strings[low:high] >> bit) & 1, 1))
            todo += [(a, b, bit - 1, low, high) for a, b in ((low, middle), (middle, high)) if b > a]


def _denser(rows: np.ndarray, x: np.ndarray, limit: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    todo = [rows]
    while todo:
        part = todo.pop()
        if len(part) <= limit:
            yield part
        else:
            around = x[part] - x[part].mean(axis=0)
            order = np.argsort(around @ rng.standard_normal(x.shape[1]).astype(np.float32), kind="stable")
            todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]


_FOUND = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("near", pa.list_(pa.int64())), ("cosine", pa.list_(pa.float64()))])


#: Products that are held at once.
PRODUCTS = 4_000_000


def _search(k: int, limit: int = CANDIDATES):
    def one_cell(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        strings = rows.column("string").to_numpy()
        x = np.stack([np.frombuffer(u, np.float32) for u in rows.column("unit").to_pylist()])
        ids = rows.column("ids").to_pylist()
        for group, low, high in queries(strings, x, limit, rows.column("tree")[0].as_py()):
            among = np.arange(low, high) if high else group
            if len(among) < 2:  # alone, but it may have equals
                own = ids[group[0]]
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((own[0], own, [], []), _FOUND)], schema=_FOUND)
                continue
            itself = group - low if high else np.arange(len(group))
            c = x[among]
            m = min(k, len(among) - 1)
            size = max(1, PRODUCTS // len(among))
            for at in range(0, len(group), size):
                run = group[at : at + size]
                v = x[run]
                sims = v @ c.T
                sims[np.arange(len(run)), itself[at : at + size]] = -2
                best = np.argpartition(sims, len(among) - m, axis=1)[:, len(among) - m :]
                # the last digits of float32 products depend on the block: what is kept is computed again
                exact = np.einsum("ij,ikj->ik", v.astype(np.float64), c[best].astype(np.float64))
                found = []
                for r, (others, cosines) in enumerate(zip(best.tolist(), exact.tolist())):
                    near = sorted((-s, i) for o, s in zip(others, cosines) for i in ids[among[o]])[:k]
                    own = ids[run[r]]
                    found.append((own[0], own, [i for _, i in near], [-s for s, _ in near]))
                yield pa.RecordBatch.from_arrays([pa.array(c_, f.type) for c_, f in zip(zip(*found), _FOUND)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            for a, b in zip(*_edges(cell)):
                part = batch.slice(a, b - a)
                if held and held[-1].column("cell")[0].as_py() != cell[a]:
                    yield from one_cell(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from one_cell(pa.Table.from_batches(held))

    return run


def _edges(values: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(values):
        return [], []
    starts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist()]
    return starts, [*starts[1:], len(values)]


def _merge(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for own, nears, cosines in zip(*(batch.column(c).to_pylist() for c in ("ids", "nears", "cosines"))):
                    best: dict[int, float] = {}
                    for near, cosine in zip(nears, cosines):
                        best.update(zip(near, cosine))
                    for x in own:
                        equal = [(-2.0, i, 1.0) for i in own if i != x]
                        for rank, (_, i, c) in enumerate(sorted(equal + [(-c, i, c) for i, c in best.items()])[:k], 1):
                            yield x, i, rank, c

        return rows_to_batches(rows(), pa.schema([("vec_id", pa.int64()), ("near_id", pa.int64()), ("rank", pa.int32()), ("cosine", pa.float64())]))

    return run


def _smallest(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy("vec_id")
    return rows.withColumn("at", F.row_number().over(window)).where(F.col("at") <= n).drop("at")


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """(vec_id, near_id, rank, cosine): the ``k`` most similar other vectors of each vector.

    At equal similarity the smaller id comes first. Null, all-zero and non-finite
    vectors, and those of an odd length, neither ask nor answer; with fewer than k
    others there are fewer rows.
    """
    spark = vectors.sparkSession
    units = written(unit_vectors(vectors, id_column, vector_column))  # five uses follow
    n = units.count()
    if not n:
        return spark.createDataFrame([], "vec_id long, near_id long, rank int, cosine double")
    directions, thresholds, sample = projections(units, n)
    # of each direction the k + 1 smallest ids answer for all; salted, as one direction may have any share of the rows
    narrow = units.select("same", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt"))
    few = _smallest(_smallest(narrow, k + 1, "same", "salt"), k + 1, "same").groupBy("same").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    entries = units.select("vec_id", "unit", "same").join(few, "same").where(F.col("vec_id") == F.get("ids", F.lit(0))).select("ids", "unit")
    different = np.unique(sample, axis=0)
    n = n * len(different) // len(sample)
    by_tree = strings_of(different, directions, thresholds).T
    cells = [cells_of(of_tree, n) for of_tree in by_tree]
    cuts = [crowded(of_tree, different, n, t) for t, of_tree in enumerate(by_tree)]
    strings = entries.mapInArrow(_strings(directions, thresholds, cells, cuts), _ENTRY)
    tasks = sum(map(len, cells)) + sum(1 << len(above) for of_tree in cuts for _, above in of_tree.values())
    placed = strings.repartition(tasks, "cell").sortWithinPartitions("cell", "string")
    found = placed.mapInArrow(_search(k, CANDIDATES), "vec_id long, ids array<long>, near array<long>, cosine array<double>")
    merged = found.groupBy("vec_id").agg(F.first("ids").alias("ids"), F.collect_list("near").alias("nears"), F.collect_list("cosine").alias("cosines"))
    own = merged.mapInArrow(_merge(k), "vec_id long, near_id long, rank int, cosine double")
    # an id beyond the k + 1 smallest of its direction has the k smallest as neighbours
    full = few.where(F.size("ids") > k).select("same", "ids")
    beyond = narrow.select("same", "vec_id").join(full, "same").where(F.col("vec_id") > F.get("ids", F.lit(k)))
    others = beyond.select("vec_id", F.posexplode(F.slice("ids", 1, k)).alias("pos", "near_id")).select(
        "vec_id", "near_id", (F.col("pos") + 1).alias("rank"), F.lit(1.0).alias("cosine")
    )
    return own.unionByName(others)


def neighbour_pairs(vectors: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b), a < b: pairs of which one is among the most similar of the other."""
    pairs = nearest(vectors).select(F.least("vec_id", "near_id").alias("vec_id_a"), F.greatest("vec_id", "near_id").alias("vec_id_b"))
    return pairs.distinct()
