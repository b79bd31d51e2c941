"""Sinks: lines, samples, marks for spreadsheets, records, bundles; relevance and the plainer filter."""

import json
import os

from pyspark.sql import functions as F

from siltstone.functions.predicate import compile_equalities
from siltstone.operators import variants
from siltstone.sources import files, sinks


def parts(path):
    return [p for p in path.iterdir() if p.name.startswith("part-")]


def test_lines_and_samples(spark, tmp_path):
    df = spark.createDataFrame([(3, "c"), (1, None), (2, "b")], "n int, t string").repartition(2)
    sinks.write_jsonl(df, str(tmp_path / "l"))
    lines = sorted(json.loads(x)["n"] for p in parts(tmp_path / "l") for x in p.read_text().splitlines())
    sinks.write_sample(df, str(tmp_path / "s"), 2, F.col("n"))
    sample = [json.loads(x) for x in parts(tmp_path / "s")[0].read_text().splitlines()]
    assert lines == [1, 2, 3] and sample == [{"n": 1, "t": None}, {"n": 2, "t": "b"}]


def test_tables_for_spreadsheets(spark, tmp_path):
    df = spark.createDataFrame([("é", 'a "b"\nc')], "name string, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert parts(tmp_path / "c")[0].read_bytes().startswith(b"\xef\xbb\xbfname,")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "c")).collect()] == [("é", 'a "b"\nc')]


def test_newest_first(spark, tmp_path):
    for name, t in (("a.json", 100), ("b.json", 300), ("c.json", 300), ("d.txt", 900)):
        (tmp_path / name).write_text("{}")
        os.utime(tmp_path / name, (t, t))
    assert [r.file[-6:] for r in sinks.newest(spark, str(tmp_path)).collect()] == ["b.json", "c.json", "a.json"]


def test_response_records(spark):
    rows = [("q", "a", [("d", 1)], False, "factual", None, 1.5, [("c1", "x" * 500)])]
    df = spark.createDataFrame(rows, "query string, answer string, citations array<struct<doc_id:string,page:int>>, insufficient boolean, query_type string, model_used string, latency_sec double, retrieved_chunks array<struct<chunk_id:string,text:string>>")
    got = json.loads(df.select(sinks.response_record().alias("j")).first().j)
    assert got["n_citations"] == 1 and got["model_used"] is None and got["retrieved_chunks"] == [{"chunk_id": "c1", "text": "x" * 300}]


def test_bundle(spark, tmp_path):
    means, rows = spark.createDataFrame([("dense", 0.5)], "variant string, mrr double"), spark.createDataFrame([(1, "dense", 0.5), (1, "sparse", 0.2)], "query_id int, variant string, mrr double")
    sinks.write_bundle(str(tmp_path), means, rows)
    a, b = sinks.read_bundle(spark, str(tmp_path), "variant string, mrr double", "query_id int, mrr double, variant string")
    assert [tuple(r) for r in a.collect()] == [("dense", 0.5)] and sorted((r.variant, r.mrr) for r in b.collect()) == [("dense", 0.5), ("sparse", 0.2)]


def test_relevant_chunks(spark):
    chunks = spark.createDataFrame([("a1", "a", 1), ("a3", "a", 3), ("a9", "a", 9), ("b1", "b", 1)], "chunk_id string, doc_id string, page_start int")
    golden = spark.createDataFrame([(1, "a", 2), (2, "a", None), (3, None, 1), (4, "z", 1)], "query_id int, source_doc string, source_page int")
    got = sorted(map(tuple, variants.relevant_chunks(chunks, golden).collect()))
    assert got == [(1, "a1"), (1, "a3"), (2, "a1"), (2, "a3"), (2, "a9")]
    assert variants.relevant_chunks(chunks, golden, "doc").where("query_id = 1").count() == 3


def test_table_names_the_best(spark):
    rows = [("dense", 1, 0.5, 0.4), ("sparse", 1, 0.5, 0.6), ("dense", 2, None, 0.4), ("sparse", 2, 0.1, 0.6)]
    means = spark.createDataFrame(rows, "variant string, k int, precision double, mrr double").withColumns({c: F.lit(0.0) for c in ("recall", "f1", "hit_rate", "ndcg", "ap")})
    got = {r.metric: (r.dense, r.sparse, r.best) for r in variants.table(means, ("dense", "sparse")).collect()}
    assert got["P@1"] == (0.5, 0.5, "dense") and got["P@2"] == (None, 0.1, "sparse") and got["MRR"] == (0.4, 0.6, "sparse") and len(got) == 13


def test_equalities(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "n int, t string")
    keep = lambda c: [r.n for r in df.where(compile_equalities(c)).orderBy("n").collect()]
    assert keep({"t": "x"}) == [1] and keep({"t": None}) == [2] and keep(None) == [1, 2, 3] and keep({"$gt": 3}) == [1, 2, 3]
    assert keep({"$or": [{"t": "x"}, {"$and": [{"n": 3}, {"t": "y"}]}]}) == [1, 3] and keep({"$or": []}) == []
