import numpy as np
import pytest

from leafmill.operators import search as S


def vectors(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], f"c{i % 3}", f"s{i % 5}") for i in range(n)]
    rows += [(n, None, "c0", "s0"), (n + 1, [0.0] * 8, "c0", "s0"), (n + 2, rows[0][1], "c0", "s0")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, collection string, source string"), rows


def brute(rows, q, k, keep=lambda r: True):
    a = np.array(rows[q][1])
    found = []
    for r in rows:
        if r[1] is not None and any(r[1]) and keep(r):
            b = np.array(r[1])
            found.append((round(1 - float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), r[0]))
    return [i for _, i in sorted(found)[:k]]


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 4)
    df, rows = vectors(spark)
    queries = df.where("vec_id % 10 = 0 or vec_id >= 60").selectExpr("vec_id as query_id", "embedding")
    got = {}
    for r in S.nearest(queries, df.repartition(3), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert set(got) == {0, 10, 20, 30, 40, 50, 62}
    assert all(got[q] == brute(rows, q, 5) for q in got)
    hits = S.nearest(queries.where("query_id = 0"), df, 2, collection="collection")
    assert hits.count() == 6
    assert [r["vec_id"] for r in S.merged(hits, 2).orderBy("rank").collect()] == [0, 62]
    assert S.nearest(queries.limit(0), df, 2).count() == 0
    with pytest.raises(ValueError):
        S.nearest(queries, df, 0)


def test_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 6), (4, None)], "query_id int, rank int")
    assert tuple(S.metrics(ranks).first()) == (4, 0.25, 0.5, 0.5, round((1 + 1 / 2 + 1 / 6) / 4, 3))
    assert tuple(S.metrics(ranks.limit(0)).first()) == (0, 0.0, 0.0, 0.0, 0.0)
    assert [r["query_id"] for r in S.imperfect(ranks).collect()] == [4, 3, 2]


def test_ranks_of_sources(spark):
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4)], "query_id int, source string, rank int")
    ranked = S.ranked_sources(hits)
    assert [(r["source"], r["source_rank"]) for r in ranked.orderBy("source_rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    expected = spark.createDataFrame([(1, "c"), (1, "a"), (2, "a")], "query_id int, source string")
    assert {tuple(r) for r in S.rank_of_expected(ranked, expected).collect()} == {(1, 2), (2, None)}


def test_index_changes(spark):
    stored = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "source string, id string")
    current = spark.createDataFrame([("a", "2"), ("a", "4")], "source string, id string")
    walked = current.select("source").distinct()
    new, stale, gone = S.index_changes(stored, current, walked)
    assert [[tuple(r) for r in x.collect()] for x in (new, stale, gone)] == [[("a", "4")], [("a", "1")], [("b", "3")]]
    assert S.index_changes(stored, current.limit(0), walked.limit(0))[2].count() == 0
    assert S.index_changes(stored, current)[2].count() == 0


def test_collections(spark):
    df, _ = vectors(spark)
    roots = spark.createDataFrame([("c0", "/r")], "collection string, root string")
    assert {(r["collection"], r["chunks"], r["root"]) for r in S.collections(df, roots).collect()} == {("c0", 23, "/r"), ("c1", 20, None), ("c2", 20, None)}
