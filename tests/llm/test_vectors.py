"""Problem 4."""

import numpy as np

from leafmill.llm import similar_vectors as V

SCHEMA = "vec_id long, embedding array<float>, ids string, near_id long"


def rows_of(rng, n=400):
    centres = rng.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.4 * rng.standard_normal(16)).astype(np.float32)) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(9)]  # equal to one, more than k
    rows += [(n + 20, rows[3][1] * np.float32(2)), (n + 21, np.zeros(16, np.float32)), (n + 22, None)]
    return rows


def brute(rows, k=5):
    kept = sorted((i, v / np.linalg.norm(v)) for i, v in ((i, v.astype(np.float64)) for i, v in rows if v is not None and v.any()))
    ids, x = [i for i, _ in kept], np.stack([v for _, v in kept])
    sims = np.round(x @ x.T, 6)
    np.fill_diagonal(sims, -2)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return {i: [ids[j] for j in row] for i, row in zip(ids, order)}


def frame(spark, rows):
    data = [(i, None if v is None else [float(x) for x in v], "clash", 0) for i, v in rows]
    odd = [(None, [1.0] * 16, None, None), (9001, [1.0, 2.0], None, None), (9002, [], None, None), (9003, [1.0, None] * 8, None, None), (9004, [float("nan")] * 16, None, None)]
    return spark.createDataFrame([*data, *data, *(odd if rows else [])], SCHEMA)


def found(df):
    out = {}
    for r in V.nearest(df).orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append(r["near_id"])
    return out


def test_exact_where_all_are_candidates(spark):
    rows = rows_of(np.random.default_rng(1))
    assert found(frame(spark, rows)) == brute(rows)


def test_recall_of_the_forest(spark, monkeypatch):
    monkeypatch.setattr(V, "CANDIDATES", 60)
    monkeypatch.setattr(V, "RUN", 1000)
    rows = rows_of(np.random.default_rng(2))
    got, want = found(frame(spark, rows)), brute(rows)
    assert set(got) == set(want)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9
    pairs = [tuple(r) for r in V.neighbour_pairs(frame(spark, rows)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_runs_are_bounded_and_whole():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 4)).astype(np.float32)
    strings = np.sort(rng.integers(0, 4, 500)) << (V.BITS - 2)
    strings[:300] = 0  # one string for many
    runs = list(V.prefix_runs(strings, x, 50))
    assert max(map(len, runs)) <= 50 and sorted(np.concatenate(runs).tolist()) == list(range(500))


def test_few_and_none(spark):
    assert V.nearest(frame(spark, [])).count() in (0,)
    two = [(1, np.ones(16, np.float32)), (2, np.ones(16, np.float32) * 3), (5, None)]
    assert found(frame(spark, two).where("vec_id is not null")) == {1: [2], 2: [1]}
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert V.nearest(one).count() == 0 and V.nearest(one.limit(0)).count() == 0


def test_recall_in_a_cluster_that_no_threshold_cuts(spark):
    """Vectors that share their strings in all trees are split in each tree another way."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal(64) + 0.005 * rng.standard_normal((10_000, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    directions, above = np.zeros((64, V.TREES * V.BITS), np.float32), np.ones(V.TREES * V.BITS, np.float32)
    units = spark.createDataFrame([([i], x[i].tobytes()) for i in range(len(x))], "ids array<long>, unit binary")
    strings = units.coalesce(1).mapInArrow(V._strings(directions, above), V._ENTRY).sortWithinPartitions("tree", "string")
    near = strings.mapInArrow(V._search(5), "vec_id long, ids array<long>, near array<long>, cosine array<double>").collect()
    found = {}
    for r in near:
        found.setdefault(r["vec_id"], set()).update(r["near"])
    asked = range(0, len(x), 20)
    sims = x[asked].astype(np.float64) @ x.T.astype(np.float64)
    sims[np.arange(len(asked)), asked] = -2
    best = np.argsort(-sims, axis=1)[:, :5]
    recall = np.mean([len(found[i] & set(b)) / 5 for i, b in zip(asked, best.tolist())])
    print("recall", recall)
    assert recall >= 0.95


def test_few_ascend_to_the_prefix_around():
    """A small run is compared with the prefix around it, and no cell cuts a run."""
    rng = np.random.default_rng(6)
    strings = np.sort(np.concatenate([rng.integers(0, 1 << 10, 199), (1 << 20) + rng.integers(0, 9, 11)]))
    for rows, low, high in V.queries(strings, np.zeros((len(strings), 2), np.float32), 200):
        assert high - low >= 100 and low <= rows[0] and rows[-1] < high
    many = rng.integers(0, 1 << V.BITS, 1000)
    many[:5] = 7  # few far from the others: no cell of their own
    many[5:500] |= 1 << (V.BITS - 1)
    many[500:] = many[500:] >> 20
    starts = V.cells_of(many, 100_000)
    sizes = np.bincount(np.searchsorted(starts, many, side="right") - 1)
    assert len(starts) > 3 and sizes.min() >= 20 and sizes.sum() == 1000


def test_a_string_of_too_many_is_cut_over_cells(spark, monkeypatch):
    """A near-equal cluster several times as large as a cell lies in several, and is searched as well."""
    monkeypatch.setattr(V, "RUN", 600)
    monkeypatch.setattr(V, "CANDIDATES", 300)
    rng = np.random.default_rng(9)
    x = rng.standard_normal(16) + 0.01 * rng.standard_normal((3000, 16))
    strings = np.full(3000, 77, np.int64)
    cut = V.crowded(strings, x.astype(np.float32), 3000, 0)
    assert list(cut) == [77] and len(cut[77][1]) == 3 and V.crowded(np.arange(3000), x, 3000, 0) == {}
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(x)]
    got, want = found(frame(spark, rows)), brute(rows)
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.8
