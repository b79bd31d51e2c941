"""The registered queries over the smallest tables: against SQL, the library, and the pipeline's own parts."""

import hashlib

import corpus_pipeline
import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from siltstone.llm import queries

TABLES = ("documents", "pages", "conversations", "labels", "embeddings", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, data, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cur = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cur.fetchall()))


def test_operators_are_registered():
    assert {n.split("_")[0] for n in queries.QUERIES} >= {f"op{i}" for i in range(1, 11)} | {"op11", "op12", "op13"}


def test_op2_equals_the_library(spark, data):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op2_sentencepiece(spark, data).collect():
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-5, "", "en", None, 0), (-6, "w " * 20000, "en", "src1", 40000)], docs.schema)
    stage = docs.unionByName(odd)
    ids = {r.doc_id for r in docs.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, data).cache()
        assert stage.columns == docs.columns, name
        assert {r.doc_id for r in stage.collect()} <= ids | {None, -5, -6}
    out = corpus_pipeline.STAGES[-1][1](spark, stage, data)
    assert out.count() == stage.count() > 0
    assert stage.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    empty = docs.where("false")
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, data)
    assert empty.count() == 0
