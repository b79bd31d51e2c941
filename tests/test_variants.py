"""Questions under variants: errors, own filters, judged lists."""

from pyspark.sql import functions as F

from siltstone.functions.predicate import key_of, keys_of, route_question
from siltstone.operators import sparse, variants


def test_routes(spark):
    rows = [("comparative", True, []), ("factual", True, []), ("factual", False, []), ("factual", False, ["FR"]), ("gap_detection", True, ["FR", "DE"])]
    df = spark.createDataFrame(rows, "category string, benchmark boolean, countries array<string>")
    got = [r.k for r in df.select(key_of(route_question(F.col("category"), F.col("benchmark"), F.col("countries"), "own")).alias("k")).collect()]
    assert got == [None, "source=own", None, "country=FR", None]
    assert spark.createDataFrame([("a", None)], "x string, y string").select(keys_of(country=F.col("x"), source=F.col("y")).alias("k")).first().k == ["country=a"]


def test_run_and_judge(spark, tmp_path):
    good = "The {0} report describes targets for {0} energy, transport, buildings and land use in clear words that readers follow easily, with measures, budgets and dates for every sector."
    docs = spark.createDataFrame([(i, good.format(w), v, [f"country={c}"]) for i, w, v, c in ((1, "solar", [1.0, 0.0], "A"), (2, "wind", [0.0, 1.0], "B"), (3, "solar", [0.8, 0.6], "B"))], "doc_id long, text string, embedding array<double>, keys array<string>")
    asked = spark.createDataFrame([(10, "solar energy", [1.0, 0.0], None), (11, "solar energy", [1.0, 0.0], "country=B"), (12, "solar", None, None), (13, "", [0.0, 1.0], None), (14, None, None, None), (15, "wind", [0.0, 1.0], "country=none")], "query_id long, text string, embedding array<double>, only string")
    index = sparse.sparse_index(docs.select("doc_id", "text"), str(tmp_path))
    lists = variants.run(asked, docs, index, 2).cache()
    got: dict = {}
    for r in lists.orderBy("rank").collect():
        got.setdefault((r.query_id, r.variant), []).append(r.error or r.doc_id)
    assert got[10, "dense"] == [1, 3] and 1 in got[10, "hybrid"] and len(got[10, "hybrid"]) == 2 and got[11, "dense"] == [3, 2]
    assert set(got[11, "sparse"]) <= {2, 3} and set(got[11, "hybrid"]) == {2, 3}
    assert got[12, "dense"] == ["no vector"] and got[12, "sparse"] == got[12, "hybrid"] and len(got[12, "sparse"]) == 2
    assert got[13, "sparse"] == ["no terms"] and got[13, "hybrid"][0] == 2
    assert got[14, "dense"] == got[14, "hybrid"] == ["no vector"] and got[14, "sparse"] == ["no terms"]
    assert got[15, "dense"] == got[15, "hybrid"] == [None]
    relevant = spark.createDataFrame([(10, 1), (11, 2), (15, 2)], "query_id long, doc_id long")
    totals = asked.select("query_id", F.lit(1).alias("n_relevant"))
    rows = {(r.query_id, r.variant): r for r in variants.judged(lists, relevant, totals, (1, 2)).where("k = 2").collect()}
    assert rows[10, "dense"].mrr == 1.0 and rows[11, "dense"].mrr == 0.5 and rows[14, "dense"].mrr is None and rows[15, "hybrid"].recall == 0.0
    means = {r.variant: r for r in variants.summary(variants.judged(lists, relevant, totals, (2,))).collect()}
    assert (means["dense"].n, means["dense"].n_failed, means["sparse"].n_failed, means["hybrid"].n_failed) == (4, 2, 2, 1)
    assert means["dense"].mrr == round((1 + 0.5 + 0 + 0) / 4, 5)


def test_question_subset(spark):
    golden = spark.createDataFrame([(3, "factual", ["a"]), (1, "factual", ["a"]), (2, "factual", ["a", "b"]), (4, "gap", ["a"]), (0, "factual", [])], "query_id int, category string, countries array<string>")
    assert [r.query_id for r in variants.question_subset(golden, "factual", 1, 20).collect()] == [1, 3]
