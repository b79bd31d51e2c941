"""The stored vector index: exact, with few rows read in full; upkeep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import retrieval, vectors


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def asked(df, condition):
    return df.where(condition).select(F.col("vec_id").alias("query_id"), "embedding")


def test_search_is_exact_and_reads_few_rows_in_full(spark, tmp_path):
    """The vectors at hand, which hardly cluster: all of the ten nearest, from less than 15 % of the rows."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectors.build(rows, str(tmp_path))
    q = asked(rows, "vec_id % 40 = 0")
    exact = retrieval.dense_topk(q, rows.withColumnRenamed("vec_id", "doc_id"), 10).select("query_id", "doc_id", "rank")
    got = vectors.search(index, q, 10).select("query_id", "doc_id", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))
    assert vectors.candidates(index, q, 10).count() < 0.15 * q.count() * rows.count()
    assert index.count() == rows.count() and {r.id for r in index.ids().collect()} == {r.vec_id for r in rows.select("vec_id").collect()}


def test_upkeep(spark, tmp_path):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 16)) * 5
    x = np.concatenate([c + rng.normal(size=(40, 16)) for c in centres])
    df = table(spark, x)
    index = vectors.build(df.where("vec_id % 2 = 0"), str(tmp_path), lists=6)
    assert index.count() == 120 and len(index.centres) == 6
    rest = df.unionByName(spark.createDataFrame([(None, [1.0] * 16), (900, None), (901, [float("nan")] * 16)], df.schema))
    for _ in range(2):  # a repeated batch changes nothing
        index = vectors.add(index, rest, "b1")
        assert index.count() == 240 and index.ids().distinct().count() == 240
    index = vectors.add(index, df, "b2")
    assert index.count() == 240
    q = asked(df, "vec_id % 7 = 0")
    want = sorted(map(tuple, retrieval.dense_topk(q, df.withColumnRenamed("vec_id", "doc_id"), 5).select("query_id", "doc_id").collect()))
    assert sorted(map(tuple, vectors.search(index, q, 5).select("query_id", "doc_id").collect())) == want
    assert vectors.drift(index)["farther"] < 1.2 and vectors.rebuilt(index).place == index.place
    far = table(spark, rng.normal(size=(300, 16)) * 40, 5000)
    index = vectors.add(index, far, "far")
    assert vectors.drift(index)["farther"] > vectors.FARTHER
    new = vectors.rebuilt(index)
    assert new.place != index.place and new.count() == 540 and vectors.drift(new)["farther"] < 1.1
    # a build that was not written to its end is passed over
    (tmp_path / "zzz" / "rows").mkdir(parents=True)
    assert vectors.opened(spark, str(tmp_path)).place == new.place


def test_few_rows(spark, tmp_path):
    one = table(spark, [[1.0, 0.0]])
    assert [tuple(r) for r in vectors.search(vectors.build(one, str(tmp_path / "a")), asked(one, "true"), 3).collect()] == [(0, 0, 1.0, 1)]
    none = vectors.build(one.where("false"), str(tmp_path / "b"))
    assert none.count() == 0
    with pytest.raises(FileNotFoundError):
        vectors.opened(spark, str(tmp_path / "c"))
