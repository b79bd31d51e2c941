"""Values of several shapes, and sources merged by precedence."""

import json

from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import evaluation, evidence
from siltstone.sources import reports


def test_single_reports(spark, tmp_path):
    full = {"score": 0.81, "label": "OWN", "details": {"raw_llm_outputs": {"pass_c": "text"}, "measurability": {"level": "VAGUE"}, "commitments": [1, {"a": 2}]}}
    files = {
        "net_zero__South_Africa.json": full, "methane__India.json": {"score": "0.3", "details": {"measurability": "none", "commitments": "x", "raw_llm_outputs": {"pass_c": {}}}},
        "sub/transport__Viet_Nam__2.json": {"label": None, "score": None}, "no_cell.json": full,
    }
    (tmp_path / "sub").mkdir()
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "methane__Broken.json").write_text("{not json")
    (tmp_path / "lulucf__China.json").write_bytes(b"\xef\xbb\xbf" + json.dumps([1]).encode())
    values = reports.read_variants(spark, str(tmp_path))
    assert [r.file.rsplit("/", 1)[1] for r in reports.malformed(values).collect()] == ["methane__Broken.json"]
    got = {(r.dimension, r.entity): tuple(r)[2:] for r in reports.single_reports(values).collect()}
    assert got == {
        ("net_zero", "South Africa"): (0.81, "OWN", True, "VAGUE", 2), ("methane", "India"): (0.3, "PARTIAL", False, "ABSENT", 0),
        ("transport", "Viet Nam  2"): (None, "ABSENT", False, "ABSENT", 0), ("lulucf", "China"): (None, "ABSENT", False, "ABSENT", 0),
    }


def test_first_report_that_holds_a_score(spark, tmp_path):
    one = lambda **x: {"country_analyses": x}
    files = {
        "gap_net_zero_A_1.json": one(India={"gap_findings": []}, China={"gap_findings": [{"score": 0.4, "severity": "LOW"}, {"severity_score": "0.7"}, "odd", {"score": 0}]}),
        "gap_net_zero_A_2.json": one(India={"gap_findings": [{"severity_score": 0.2}], "overall_severity": "MINE"}, China={"gap_findings": [{"score": 0.9}]}),
        "gap_net_zero_A_3.json": one(India={"gap_findings": [{"score": 0.99}]}), "gap_methane_X.json": one(India="none"), "gap_methane_Y.json": {"country_analyses": []},
        "gap_methane_Z.json": one(India={"gap_findings": [{"score": 0.5}]}), "gap_other_Z.json": one(India={"gap_findings": [{"score": 0.5}]}),
    }
    for name, value in files.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "gap_net_zero_0.json").write_text("")
    got = {(r.dimension, r.entity): (r.score, r.severity, r.file[-8:]) for r in reports.original_reports(reports.read_variants(spark, str(tmp_path)), ["net_zero", "methane"]).collect()}
    assert got == {("net_zero", "China"): (0.7, "LOW", "A_1.json"), ("net_zero", "India"): (0.2, "MINE", "A_2.json"), ("methane", "India"): (0.5, "SIGNIFICANT", "e_Z.json")}


def test_keyed_items(spark):
    raw = [
        (1, {"per_query": [{"qid": "a", "x": 1}, {"id": "b"}, {"x": 3}, 7]}), (2, {"per_query": {"m": [{"qid": "a"}], "n": [{"qid": "", "id": "c"}], "o": 3}}),
        (3, {"per_query": 5}), (4, {}), (5, [1]),
    ]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in raw] + [(6, "no json"), (7, None)], "n int, raw string").select("n", F.try_parse_json("raw").alias("value"))
    rows = {(r.n, r.name, r.key) for r in reports.keyed_items(df).collect()}
    assert rows == {(1, None, "a"), (1, None, "b"), (2, "m", "a"), (2, "n", "c")}
    assert {(r.n, r.key) for r in reports.keyed_items(df, names=("n",)).collect()} == {(1, "a"), (1, "b"), (2, "c")}
    sizes = {r.n: r.s for r in df.select("n", F.size(reports.items(F.col("value"), "$.per_query", ("x", "m"))).alias("s")).collect()}
    assert sizes == {1: 4, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0, 7: 0}


def test_merge_by_precedence(spark):
    spine = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), (None, 4)], "k string, own int")
    first = spark.createDataFrame([("a", None, 10), ("b", "b1", None), ("z", "z", 9), (None, "n", None)], "k string, x string, y int")
    second = spark.createDataFrame([("a", "old", 7, 0, 99), ("a", "new", 8, 1, 98), ("b", "b2", 20, 0, 97)], "k string, x string, y int, nth int, own int")
    got = {r.k: r.asDict() for r in evidence.merge(spine, [("first", first), ("second", second)], "k", place="nth").collect()}
    assert set(got) == {"a", "b", "c", None}
    assert (got["a"]["x"], got["a"]["y"], got["a"]["own"]) == ("new", 10, 1)
    assert (got["b"]["x"], got["b"]["y"], got["b"]["from_first"], got["b"]["from_second"]) == ("b1", 20, True, True)
    assert (got["c"]["x"], got["c"]["from_first"], got["c"]["from_second"]) == (None, False, False)
    assert (got[None]["x"], got[None]["own"], got[None]["from_second"]) == ("n", 4, False)
    whole = {r.k: r.asDict() for r in evidence.merge(spine, [("first", first), ("second", second)], "k", whole=True, place="nth").collect()}
    assert (whole["a"]["x"], whole["a"]["y"]) == (None, 10) and (whole["b"]["x"], whole["b"]["y"]) == ("b1", None)
    assert evidence.merge(spine.where("false"), [("first", first)], "k").count() == 0
    plan = evidence.merge(spine, [("first", first), ("second", second)], "k")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_claim_lists(spark):
    rows = [('```json\n["One.", 2, null]\n```', ""), ("[]", "A sentence of some length here."), ("none", "A sentence of some length here. Short."), (None, "A sentence of some length here."), ('{"a": 1}', "x"), (json.dumps([str(i) for i in range(20)]), "")]
    got = [r.c for r in spark.createDataFrame(rows, "reply string, answer string").select(T.claim_list(F.col("reply"), F.col("answer")).alias("c")).collect()]
    assert got == [["One.", "2", None], [], ["A sentence of some length here"], ["A sentence of some length here"], [], [str(i) for i in range(12)]]


def test_refused_answers_count_as_wholly_wrong(spark):
    verdicts = spark.createDataFrame([(1, "SUPPORTED"), (1, "FABRICATED"), (2, "SUPPORTED")], "id int, verdict string")
    got = {r.id: tuple(r)[1:] for r in evaluation.hallucination(verdicts, refused=spark.createDataFrame([(2,), (3,)], "id int")).collect()}
    assert got == {1: (2, 0.5, 0.25), 2: (0, 1.0, 0.0), 3: (0, 1.0, 0.0)}
