import pytest
from pyspark.sql import functions as F

from siltstone.functions import predicate, scores, text


def value(spark, column, **row):
    types = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in row.items()) or "x int"
    return spark.createDataFrame([tuple(row.values()) or (1,)], schema).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, want",
    [("emis-\nsions", "emissions"), ("a ﬁne—day x", "a fine--day x"), ("Page 1 of 40\ntext", "text"), ("a\n\n\n\nb", "a b"), (" 12 \nx", "x")],
)
def test_clean_page(spark, raw, want):
    assert value(spark, text.clean_page(F.col("t")), t=raw) == want


def test_sentences(spark):
    got = value(spark, text.sentences(F.col("t")), t='See Fig. 2 and e.g. No. 5. Then stop! "Why?" (So) it is.\n\nNew part. lower stays')
    assert got == ["See Fig. 2 and e.g. No. 5.", "Then stop!", '"Why?" (So) it is.', "New part. lower stays"]


def test_tokenise(spark):
    assert value(spark, text.tokenise(F.col("t")), t="The (CO2) émis» of a 2030, x 1.5°C -- which!") == ["co2", "émis", "2030", "1.5°c"]


@pytest.mark.parametrize(
    "t, want",
    [(None, True), ("x" * 19, True), ("▲▼ " + "word " * 30, True), ("12 34 " * 40, True), ("word " * 50, True), ("some honest prose about several topics that reads well and keeps going until done", False), ("a b c d e f g h i j k l m n", True)],
)
def test_gate(spark, t, want):
    assert value(spark, text.is_garbled(F.col("t")), t=t) is want


@pytest.mark.parametrize("line, want", [("Chapter 3 - Aims", True), ("1.2 Goals", True), ("ANNEX TABLES", True), ("A. Part", True), ("IV) Next", True), ("plain words", False), ("", False), ("1. " + "X" * 130, False)])
def test_heading(spark, line, want):
    assert (value(spark, text.heading(F.col("t")), t=line) is not None) is want


def test_citations_and_classes(spark):
    got = value(spark, text.citations(F.col("t")), t="[D1, p.3] [D1,p 3] [D2, p.x] [D_2 , p. 14]")
    assert [(c.doc, c.page) for c in got] == [("D1", 3), ("D_2", 14)]
    kinds = {"highest target compared to 2015": "gap", "which country is it": "comparative", "what is it": "factual"}
    for q, k in kinds.items():
        assert value(spark, text.classify_query(F.col("t")), t=q) == k


@pytest.mark.parametrize(
    "raw, want",
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": {"b": 2}} done', '{"a": {"b": 2}}'), ("{'a': [1, 2,],}", '{"a": [1, 2]}'), ("none", None), (None, None), ("", None)],
)
def test_repair_json(spark, raw, want):
    assert value(spark, text.repair_json(F.col("t")), t=raw) == want


def test_labels(spark):
    for s, want in ((0.80, "CRITICAL"), (0.79, "SIGNIFICANT"), (0.50, "SIGNIFICANT"), (0.20, "PARTIAL"), (0.19, "ALIGNED"), (None, "ABSENT")):
        assert value(spark, scores.severity_label(F.col("s").cast("double")), s=s) == want
    assert value(spark, scores.measurability_score(F.lit("QUANTIFIED"), F.lit(0))) == 0.85
    assert value(spark, scores.canonical_gap_type(F.lit("VAGUE vs MEASURABLE"))) == "vague_target"
    assert value(spark, scores.safe_double(F.col("t"), 7.0), t="n/a") == 7.0


OPS = {"$eq": lambda a, b: a == b, "$ne": lambda a, b: a != b, "$gt": lambda a, b: a is not None and a > b, "$gte": lambda a, b: a is not None and a >= b, "$lt": lambda a, b: a is not None and a < b, "$lte": lambda a, b: a is not None and a <= b, "$in": lambda a, b: a is not None and a in b, "$nin": lambda a, b: a not in b or a is None}


def direct(row, cond):
    if not cond:
        return True
    if "$and" in cond:
        return all(direct(row, c) for c in cond["$and"])
    if "$or" in cond:
        return any(direct(row, c) for c in cond["$or"])
    return all(all(OPS[o](row[k], x) for o, x in v.items() if o in OPS) if isinstance(v, dict) else row[k] == v for k, v in cond.items())


FILTERS = [
    {}, {"lang": "fr"}, {"rank": {"$lte": 5}}, {"lang": {"$ne": "fr"}}, {"lang": {"$nin": ["fr", "de"]}}, {"lang": {"$in": ["fr"]}}, {"rank": {"$gt": 1, "$lt": 9}}, {"lang": "fr", "rank": 1},
    {"$and": [{"rank": {"$gte": 2}}, {"$or": [{"lang": "de"}, {"lang": "en"}]}]}, {"$or": []}, {"$and": [], "lang": "fr"}, {"rank": {"$odd": 3}}, {"lang": None},
]


@pytest.mark.parametrize("cond", FILTERS, ids=str)
def test_filters_equal_a_direct_reading(spark, cond):
    rows = [{"lang": x, "rank": r} for x in ("fr", "de", "en", None) for r in (1, 5, 9, None)]
    df = spark.createDataFrame([(r["lang"], r["rank"]) for r in rows], "lang string, rank int")
    got = [(r.lang, r.rank) for r in df.where(predicate.compile_filter(cond)).collect()]
    assert sorted(map(str, got)) == sorted(str((r["lang"], r["rank"])) for r in rows if direct(r, cond))
    flipped = df.where(~predicate.compile_filter(cond)).count()
    assert len(got) + flipped == len(rows)


def test_inst_prompt(spark):
    m = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("system", "S"), ("user", "U"), ("assistant", "A"), ("user", "V"))])
    assert value(spark, text.inst_prompt(m)) == "<s>[INST] S\n\nU [/INST] A </s><s>[INST] V [/INST]"
