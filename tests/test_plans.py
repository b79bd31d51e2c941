"""Every registered query against its SQL over the smallest tables, and the plans that matter."""

import duckdb
import pytest

import __spark_entry__ as entry
from siltstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, data, duck, name):
    df = catalog.QUERIES[name](spark, data)
    rows = df.collect()
    assert rows
    if name in catalog.ORACLE_SQL:
        cur = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(str(tuple(r[n] for n in names)) for r in rows) == sorted(map(str, cur.fetchall()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(spark, data):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    p = catalog.QUERIES["metadata_filter"](spark, data)._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
    assert "GreaterThanOrEqual(n_chars,500)" in p and "EqualNullSafe(lang,fr)" in p
    p = plan(catalog.QUERIES["event_windows"](spark, data))
    assert "props" not in p.split("ReadSchema")[1]


def test_top_k_is_limited_before_the_shuffle(spark, data):
    assert "WindowGroupLimit" in plan(catalog.QUERIES["bm25_topk"](spark, data))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["ablation_rrf_k", "ablation_bm25_k1", "ablation_pool"])
def test_ablations_ask_every_question(spark, data, duck, name):
    asked = duck.execute("SELECT count(*) FROM benchmark JOIN embeddings ON item_id = vec_id").fetchone()[0]
    assert {r.n for r in catalog.QUERIES[name](spark, data).collect()} == {asked}


def test_answers_leave_the_texts_where_they_are(spark, data, monkeypatch):
    from siltstone.plans import texts

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = texts.rag_answers(spark, data)
        scans = [x.split("\n")[0] for x in plan(few).split("Exchange hashpartitioning(doc_id#")[1:]]
        joins = [x for x in plan(few).split("\n") if "BroadcastHashJoin [doc_id#" in x]
        assert joins and all("text#" not in x for x in scans)
        monkeypatch.setattr(texts, "BROADCAST_HITS", 0)
        many = texts.rag_answers(spark, data)
        key = lambda r: str(tuple(r))
        assert sorted(map(key, few.collect())) == sorted(map(key, many.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_postings_in_ranges_take_one_shuffle(spark):
    from siltstone.operators import sparse

    docs = spark.createDataFrame([(1, "river bank river"), (1, "bank river river"), (2, ""), (3, None), (4, "lake")], "doc_id long, text string")
    ranged = sparse.postings(docs, ranges=True)
    assert plan(ranged).split("Initial Plan")[0].count("Exchange") == 1
    want = [(1, "bank", 3, 2), (1, "river", 3, 4), (4, "lake", 1, 1)]
    assert sorted(map(tuple, ranged.collect())) == want and sorted(map(tuple, sparse.postings(docs).collect())) == want
