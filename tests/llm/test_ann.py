import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import ann, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=10):
    use = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for q, x in use:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in use if i != q)[:k]
            out[q] = [(r + 1, i, d) for r, (d, i) in enumerate(near)]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_exact_where_all_leaves_open_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(260)]
    rows += [(i, rows[0][1]) for i in range(300, 330)]  # many copies of a query: ties go to smaller ids
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got, want = found(ann.neighbours(df, F.col("vec_id") % 100 == 0, open_share=99.0)), brute(rows)
    assert got.keys() == want.keys()
    for q in want:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert np.allclose([x[2] for x in got[q]], [x[2] for x in want[q]], atol=1e-12)


def test_fewer_candidates_than_asked_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1)], SCHEMA)
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.neighbours(df, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert ann.neighbours(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert ann.neighbours(df.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_ties_end_at_the_smaller_id_whatever_the_groups(spark):
    # 99 vectors, all as far from the query
    rows = [(0, [1.0] + [0.0] * 99)] + [(i, [0.0] * i + [1.0] + [0.0] * (99 - i)) for i in range(99, 0, -1)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    for options in ({}, {"group_rows": 4, "group_queries": 1, "leaf_rows": 2, "open_share": 99.0}):
        got = found(ann.neighbours(df, F.col("vec_id") == 0, **options))
        assert [x[:2] for x in got[0]] == [(r, r) for r in range(1, 11)]
        assert {x[2] for x in got[0]} == {float(np.sqrt(2))}


def test_chunks_of_rows_and_queries_lose_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 5).astype(np.float32).tolist()) for i in range(400)]  # many equal distances and vectors
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = found(ann.neighbours(df, F.col("vec_id") % 20 == 0, group_rows=16, group_queries=4, leaf_rows=4, open_share=99.0))
    use = {i: np.array(v) for i, v in rows if any(v)}
    assert got.keys() == {i for i in use if i % 20 == 0}
    for q, near in got.items():
        want = sorted((float(np.sqrt(((use[q] - x) ** 2).sum())), i) for i, x in use.items() if i != q)[:10]
        assert [(i, d) for _, i, d in near] == [(i, d) for d, i in want]


def test_clashing_names_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0], "a", 1), (0, [1.0, 0.0], "b", 2), (1, [0.0, 1.0], "c", 3), (1, [1.0, 1.0], "d", 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string, least int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1)]


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, folder):
    place = f"/root/testdata/{folder}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{place}/embeddings.parquet").collect()]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    got, hits, asked = found(queries.op1_neighbours(spark, place)), 0, 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, far)) if i != q][:10]
        near = got[int(ids[q])]
        assert [r for r, _, _ in near] == list(range(1, 11)) and all(abs(d - far[ids == i][0]) < 1e-12 for _, i, d in near)
        hits, asked = hits + len({int(ids[i]) for i in order} & {i for _, i, _ in near}), asked + 10
    assert hits / asked >= 0.92


def test_opened_share_falls_with_size():
    shares = [ann.opened_share(n) for n in (10**3, 10**4, 10**6, 10**9)]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.1


def test_forest_recall_on_clusters():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 32))[rng.integers(20, size=4000)] + 0.3 * rng.normal(size=(4000, 32))
    forest = [ann.grow(x, 5, s) for s in range(6)]
    leaf = [ann.leaves_of(t, x) for t in forest]
    hits = 0
    for q in range(40):
        true = np.argsort(((x - x[q]) ** 2).sum(1))[1:11]
        seen = np.zeros(len(x), bool)
        for t, k in ann.search(forest, x[q], 1.0):
            seen |= leaf[t] == k
        hits += seen[true].sum()
    assert hits / 400 >= 0.9
