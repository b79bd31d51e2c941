"""Nested exemplars, rules as data, best flags, common dimensions."""

from pyspark.sql import functions as F

from siltstone.operators import evaluation, gap


def test_exemplars_are_bounded_and_ordered(spark):
    rows = [("a", i, float(9 - i)) for i in range(10)] + [(None, 50, 1.0), ("b", 60, None)]
    df = spark.createDataFrame(rows, "mode string, id int, score double").repartition(4)
    got = {r["mode"]: r for r in evaluation.exemplars(df, "mode", 3, F.col("score"), F.col("id")).collect()}
    assert got["a"].n == 10 and [(c.place, c.id) for c in got["a"].cases] == [(1, 9), (2, 8), (3, 7)]
    assert got[None].n == 1 and got["b"].cases[0].score is None
    assert "WindowGroupLimit" in evaluation.exemplars(df, "mode", 3, F.col("score"))._jdf.queryExecution().executedPlan().toString()


def test_rules_hold_only_above_their_limits(spark):
    found = [("count", "FM1_RETRIEVAL_MISS", 1.0), ("count", "NONE", 9.0), ("pct", "corpus", 10.0), ("pct", "retrieval", 90.0), ("delta", "hard", 0.11), ("count", "FM3_CONTEXT_RECALL", 2.0)]
    got = [r.target for r in evaluation.advise(spark.createDataFrame(found, "kind string, name string, value double")).orderBy("place").collect()]
    assert got == ["FM1_RETRIEVAL_MISS", "FM3_CONTEXT_RECALL", "HARD_QUESTIONS"]
    above = spark.createDataFrame([("pct", "corpus", 10.5), ("delta", "hard", 0.1)], "kind string, name string, value double")
    assert [r.target for r in evaluation.advise(above).collect()] == ["FM7_CORPUS_GAP"]


def test_metric_table_marks_the_best(spark):
    df = spark.createDataFrame([("x", 1.0, 5.0), ("y", 2.0, 5.0), ("z", None, 7.0)], "model string, up double, down double")
    got = {(r.metric, r.variant): r.best for r in evaluation.metric_table(df, "model", {"up": True, "down": False}).collect()}
    assert got == {("up", "x"): False, ("up", "y"): True, ("up", "z"): False, ("down", "x"): True, ("down", "y"): True, ("down", "z"): False}


def test_common_leader(spark):
    rows = [("A", 0, "d1", 0.2), ("A", 0, "d2", 0.9), ("B", 1, "d1", 0.5), ("B", 1, "d3", 0.1), ("C", 2, "d1", 0.2), ("C", 2, "d2", None)]
    got = {(r.entity_a, r.entity_b): (r.common, r.total_a, r.leader) for r in gap.common_leader(spark.createDataFrame(rows, "entity string, position int, dimension string, score double")).collect()}
    assert got == {("A", "B"): (["d1"], 0.2, "A"), ("A", "C"): (["d1"], 0.2, None), ("B", "C"): (["d1"], 0.5, "C")}


def test_rouge_all(spark):
    df = spark.createDataFrame([(1, "the cat sat", "the cat ran off"), (2, "", "x"), (3, None, None)], "id int, hyp string, ref string")
    got = {r.id: r for r in evaluation.rouge_all(df).collect()}
    assert abs(got[1].rouge1.precision - 2 / 3) < 1e-12 and got[1].rouge2.recall == 1 / 3 and got[1].rougeL.recall == 0.5 and got[2].rougeL.f1 == 0.0 and set(got) == {1, 2, 3}
