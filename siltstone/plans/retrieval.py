"""Retrieval queries: benchmark passages asked against documents; vectors against vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.predicate import compile_filter, key_of, keys_of, route_question
from siltstone.operators import evaluation, retrieval, variants, vectors
from siltstone.operators import sparse as bm25

from .common import sql_bm25, sql_garbled, sql_sparse, sql_tokenise, store, table

FILTER = {"$and": [{"$or": [{"lang": "fr"}, {"lang": "de"}]}, {"n_chars": {"$gte": 500}}, {"source": {"$nin": ["src0", "src3"]}}]}


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return table(spark, d, "documents").select("doc_id", "text", "lang").join(v, "doc_id", "left")


def _with_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return _questions(spark, d).join(v, "query_id", "left")  # without a vector the sparse side still answers


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("query_label"))


def _index(spark: SparkSession, d: str) -> bm25.SparseIndex:
    """The stored index of the documents, shared by all queries that search them."""
    docs = table(spark, d, "documents")
    return bm25.sparse_index(docs.select("doc_id", "text"), store(spark), version=bm25.files(docs))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.bm25_topk(_questions(spark, d), table(spark, d, "documents"), _index(spark, d)).select("query_id", "doc_id", "score", "rank")


def sparse_post_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter after the ranking: 80 rows ranked, filtered, 40 kept."""
    docs = table(spark, d, "documents")
    top = bm25.bm25_topk(_questions(spark, d), docs, _index(spark, d), 80)
    kept = top.drop("rank").join(docs.where(compile_filter({"lang": "en"})).select("doc_id"), "doc_id", "left_semi")
    return retrieval.ranked(kept, 40, F.desc("score"), F.col("doc_id")).select("query_id", "doc_id", "score", "rank")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_topk(_asked(spark, d), _vectors(spark, d), 10, exclude_self=True).select("query_id", "doc_id", "score", "rank")


def dense_pre_filter(spark: SparkSession, d: str) -> DataFrame:
    """The filter before the ranking."""
    return retrieval.dense_topk(_asked(spark, d), _vectors(spark, d), 10, where=compile_filter({"label": {"$in": [1, 2, 3]}}), exclude_self=True).select("query_id", "doc_id", "score", "rank")


COLUMNS = ("query_id", "doc_id", "dense_score", "dense_rank", "sparse_score", "sparse_rank", "rrf_score", "retrieval_mode", "fused_rank")


def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.hybrid(_with_vectors(spark, d), _documents(spark, d), _index(spark, d), 10, where=compile_filter({"lang": "en"})).select(*COLUMNS, "rank")


def hybrid_debug(spark: SparkSession, d: str) -> DataFrame:
    """All fused candidates, with what the gate says of each."""
    return retrieval.hybrid(_with_vectors(spark, d), _documents(spark, d), _index(spark, d), 10, debug=True).select(*COLUMNS, "garbled")


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(compile_filter(FILTER)).select("doc_id", "lang", "source", "n_chars")


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense lists judged by equal labels, and how many rows are relevant to each query."""
    asked, vectors = _asked(spark, d), _vectors(spark, d)
    lists = retrieval.dense_topk(asked, vectors, 10, exclude_self=True)
    lists = lists.join(vectors.select("doc_id", "label"), "doc_id").join(asked.select("query_id", "query_label"), "query_id")
    lists = lists.select("query_id", "doc_id", "rank", F.coalesce((F.col("label") == F.col("query_label")).cast("int"), F.lit(0)).alias("relevant"))
    counts = vectors.groupBy("label").agg(F.count("*").alias("n"))
    return lists, asked.join(counts, F.col("query_label") == F.col("label"), "left").select("query_id", F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_relevant"))


METRICS = ("precision", "recall", "f1", "hit_rate", "ndcg", "ap", "mrr")


def ir_metrics_at_k(spark: SparkSession, d: str) -> DataFrame:
    m = evaluation.ranking_metrics(*_judged(spark, d))
    return m.select("query_id", "k", "n_relevant", *[F.round(c, 6).alias(c) for c in METRICS])


def metrics_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Means at each k: overall, by category, by difficulty, in one pass."""
    m = evaluation.ranking_metrics(*_judged(spark, d))
    category = F.element_at(F.array(F.lit("factual"), F.lit("comparative"), F.lit("gap_detection")), (F.col("query_id") % 3 + 1).cast("int"))
    difficulty = F.when(F.col("query_id") % 2 == 0, "easy").otherwise("hard")
    m = m.withColumn("category", category).withColumn("difficulty", difficulty)
    means = m.groupingSets([["k"], ["k", "category"], ["k", "difficulty"]], "k", "category", "difficulty").agg(F.count("*").alias("n"), *[F.round(F.avg(c), 5).alias(c) for c in METRICS])
    return means.select("k", "category", "difficulty", "n", *METRICS)


def _golden(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as golden questions: some without a vector, some without text; the filter that each implies as ``only``."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "lang")
    i = F.col("query_id")
    q = _with_vectors(spark, d).join(lang, "query_id", "left")
    category = F.element_at(F.array(F.lit("factual"), F.lit("comparative"), F.lit("gap_detection")), (i % 3 + 1).cast("int"))
    countries = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 4 == 1, F.array("lang", F.lit("xx"))).otherwise(F.array("lang"))
    q = q.withColumns({"category": category, "difficulty": F.when(i % 2 == 0, "easy").otherwise("hard"), "countries": countries, "embedding": F.when(i % 7 != 3, F.col("embedding")), "text": F.when(i % 11 == 5, "").otherwise(F.col("text"))})
    return q.withColumn("only", key_of(route_question(F.col("category"), i % 2 == 0, F.col("countries"), "src1"))).drop("lang")


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    docs = _documents(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return docs.withColumn("keys", keys_of(country=F.col("lang"), source=F.col("source")))


def _relevant(spark: SparkSession, d: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of equal labels, and how many rows are relevant to each question."""
    label = table(spark, d, "embeddings").select("vec_id", "label")
    own = asked.select("query_id").join(label.toDF("query_id", "label"), "query_id")
    counts = label.groupBy("label").agg(F.count("*").alias("n"))
    return own.join(label.withColumnRenamed("vec_id", "doc_id"), "label").select("query_id", "doc_id"), own.join(counts, "label").select("query_id", F.col("n").alias("n_relevant"))


def variant_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Dense, sparse and hybrid search of every question under its own filter, judged; means by variant and k leave failed questions out."""
    asked = _golden(spark, d)
    lists = variants.run(asked, _keyed(spark, d), _index(spark, d), 10)
    return variants.summary(variants.judged(lists, *_relevant(spark, d, asked)), 5)


def variant_table(spark: SparkSession, d: str) -> DataFrame:
    """The means of ``variant_evaluation`` as a table of metrics, the best variant of each named."""
    return variants.table(variant_evaluation(spark, d))


def variant_rows(spark: SparkSession, d: str) -> DataFrame:
    """What ``variant_evaluation`` averages: one row a question, variant and k, with the error of those that failed."""
    asked = _golden(spark, d)
    rows = variants.judged(variants.run(asked, _keyed(spark, d), _index(spark, d), 10), *_relevant(spark, d, asked))
    return rows.select("query_id", "variant", "k", "error", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ndcg", "mrr")])


def _subset(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 factual questions about one country."""
    return variants.question_subset(_golden(spark, d).where("embedding is not null and text <> ''"), "factual", 1, 20)


def ablation_rrf_k(spark: SparkSession, d: str) -> DataFrame:
    """The fusion's constant at 30, 60 and 120, over the same lists of all questions."""
    asked, docs = _with_vectors(spark, d), _documents(spark, d)
    dense, sparse = retrieval.dense_topk(asked, docs, 40), bm25.bm25_topk(asked, docs, _index(spark, d), 40)
    each = lambda x: x.withColumn("rrf_k", F.explode(F.array(F.lit(30), F.lit(60), F.lit(120)))).withColumn("query_id", F.col("query_id") * 1000 + F.col("rrf_k"))
    dense, sparse = each(dense).drop("rrf_k"), each(sparse).drop("rrf_k")
    fused = retrieval.ranked(retrieval.fuse(dense, sparse, (F.col("query_id") % 1000).cast("double")), 5, *retrieval.fused_order())
    lists = fused.select(F.floor(F.col("query_id") / 1000).alias("query_id"), (F.col("query_id") % 1000).alias("rrf_k"), "doc_id", "rank")
    return _at_five(spark, d, lists, "rrf_k")


def ablation_bm25_k1(spark: SparkSession, d: str) -> DataFrame:
    """The saturation constant at 1.2, 1.6 and 2.0 for all questions: one search, the constant is a column."""
    settings = F.broadcast(spark.createDataFrame([(12,), (16,), (20,)], "k1 int"))
    asked = _questions(spark, d).crossJoin(settings).withColumn("query_id", F.col("query_id") * 100 + F.col("k1"))
    top = retrieval.ranked(bm25.bm25_scores(asked, _index(spark, d), k1=F.col("k1") / 10.0), 10, F.desc("score"), F.col("doc_id"))
    lists = top.select(F.floor(F.col("query_id") / 100).alias("query_id"), (F.col("query_id") % 100).alias("k1_tenths"), "doc_id", "rank", "score")
    tops = lists.groupBy("k1_tenths").agg(F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 4).alias("best_score"), F.sum("doc_id").alias("doc_id_sum"))
    return _at_five(spark, d, lists.drop("score"), "k1_tenths").join(tops, "k1_tenths")


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored index's terms: document frequency, weight, and postings summed up."""
    index = _index(spark, d)
    sums = index.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("dl").alias("dl"))
    return index.terms.join(sums, "term").select("term", "df", F.round("idf", 6).alias("idf"), "tf", "dl")


def dense_only(spark: SparkSession, d: str) -> DataFrame:
    """The dense variant behind the gate."""
    return retrieval.dense_only(_with_vectors(spark, d), _documents(spark, d), 10).select("query_id", "doc_id", "score", "rank")


def sparse_only(spark: SparkSession, d: str) -> DataFrame:
    """The sparse variant behind the gate, filtered after ranking."""
    return retrieval.sparse_only(_with_vectors(spark, d), _documents(spark, d), _index(spark, d), 10, compile_filter({"lang": "en"})).select("query_id", "doc_id", "score", "rank")


def _at_five(spark: SparkSession, d: str, lists: DataFrame, setting: str) -> DataFrame:
    """Hit, reciprocal rank and NDCG of the first five rows of each (query_id, ``setting``), by equal labels; means by setting."""
    label = table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "label")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id")).join(label.toDF("query_id", "ql"), "query_id")
    counts = label.groupBy(F.col("label").alias("ql")).agg(F.count("*").alias("n_relevant"))
    judged = lists.where("rank <= 5").join(asked, "query_id").join(label.toDF("doc_id", "dl"), "doc_id", "left")
    rel = F.coalesce((F.col("ql") == F.col("dl")).cast("int"), F.lit(0))
    per = judged.groupBy("query_id", "ql", setting).agg(F.max(rel).cast("double").alias("hit"), F.coalesce(F.max(F.when(rel == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(rel / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    per = per.join(counts, "ql").withColumn("ndcg", F.col("dcg") / ideal)
    return per.groupBy(setting).agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("hit_at_5"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg_at_5"))


def ablation_filter(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search under each question's own filter and without."""
    asked, docs, index = _subset(spark, d), _keyed(spark, d), _index(spark, d)
    runs = [variants.run(q, docs, index, 5, ("hybrid",)).where("error is null").select("query_id", "doc_id", "rank", F.lit(name).alias("setting")) for name, q in (("filtered", asked), ("open", asked.withColumn("only", F.lit(None).cast("string"))))]
    return _at_five(spark, d, runs[0].unionByName(runs[1]), "setting")


def ablation_pool(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid search over candidate pools of 2, 4 and 8 times the result, from lists of the deepest for all questions, behind the gate."""
    asked, docs, k = _with_vectors(spark, d), _documents(spark, d), 5
    dense, sparse = retrieval.dense_topk(asked, docs, 8 * k), bm25.bm25_topk(asked, docs, _index(spark, d), 8 * k)
    pools = F.explode(F.array(F.lit(2), F.lit(4), F.lit(8)))
    cut = lambda x: x.withColumn("pool", pools).where(F.col("rank") <= F.col("pool") * k).withColumn("query_id", F.col("query_id") * 10 + F.col("pool")).drop("pool")
    fused = retrieval.ranked(retrieval.fuse(cut(dense), cut(sparse)), 3 * k, *retrieval.fused_order()).withColumnRenamed("rank", "place")
    kept = retrieval.gated(fused.withColumn("rank", F.col("place")), docs, k, F.col("place"))
    lists = kept.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("pool"), "doc_id", "rank")
    return _at_five(spark, d, lists, "pool")


def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The stored vector index: built over two thirds of the rows, the rest added, searched; equal to the exact scan."""
    rows = table(spark, d, "embeddings")
    place = f"{store(spark)}/vectors-{bm25.files(rows)}"
    try:
        index = vectors.opened(spark, place)
    except FileNotFoundError:
        index = vectors.build(rows.where("vec_id % 3 > 0"), place)
    index = vectors.add(index, rows, "rest")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.search(index, asked, 11).where("query_id <> doc_id").select("query_id", "doc_id", "score")


QUERIES = {f.__name__: f for f in (bm25_topk, sparse_post_filter, dense_topk, dense_pre_filter, rrf_hybrid, hybrid_debug, metadata_filter, ir_metrics_at_k, metrics_grouping_sets, ablation_rrf_k, ablation_bm25_k1, bm25_index, dense_only, sparse_only, ablation_filter, ablation_pool, variant_evaluation, variant_table, variant_rows, vector_index)}

_Q = "q AS (SELECT item_id AS query_id, text FROM benchmark)"
_QV = "q AS (SELECT item_id AS query_id, text, embedding FROM benchmark JOIN embeddings ON item_id = vec_id)"
_DENSE = "SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0"


def _dense_sql(n: int, where: str = "TRUE") -> str:
    return f"""dense AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT q.query_id, a.doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM q, documents a JOIN embeddings v ON a.doc_id = v.vec_id WHERE {where})) WHERE rank <= {n})"""


_FUSED = """fused AS (SELECT query_id, doc_id, dense.score AS dense_score, dense.rank AS dense_rank, s2.score AS sparse_score, s2.rank AS sparse_rank,
    round(coalesce(1.0 / (60 + dense.rank), 0) + coalesce(1.0 / (60 + s2.rank), 0), 6) AS rrf_score,
    CASE WHEN s2.rank IS NULL THEN 'dense_only' WHEN dense.rank IS NULL THEN 'sparse_only' ELSE 'hybrid' END AS retrieval_mode
  FROM dense FULL OUTER JOIN s2 USING (query_id, doc_id)),
f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS fused_rank FROM fused)"""

_JUDGED = f"""l AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_DENSE})),
j AS (SELECT l.query_id, l.rank, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS relevant FROM l JOIN embeddings a ON a.vec_id = l.query_id JOIN embeddings b ON b.vec_id = l.doc_id WHERE rank <= 10),
h AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM j),
n AS (SELECT a.vec_id AS query_id, (SELECT count(*) FROM embeddings b WHERE b.label = a.label) - 1 AS n_relevant FROM embeddings a WHERE a.vec_id % 20 = 0),
g AS (SELECT n.query_id, k, n_relevant, count(*) FILTER (rank <= k AND relevant = 1) AS hit,
    coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k AND relevant = 1), 0) AS dcg, coalesce(sum(hits / rank) FILTER (rank <= k AND relevant = 1), 0) AS ps,
    coalesce(max(1 / rank) FILTER (relevant = 1), 0) AS mrr
  FROM n CROSS JOIN (SELECT unnest([1, 3, 5, 10])::BIGINT AS k) LEFT JOIN h ON h.query_id = n.query_id GROUP BY ALL),
m AS (SELECT query_id, k, n_relevant, hit / k AS p, CASE WHEN n_relevant = 0 THEN 1.0 ELSE hit / n_relevant END AS r, CASE WHEN hit > 0 THEN 1.0 ELSE 0.0 END AS hit_rate,
    CASE WHEN n_relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END AS ndcg,
    CASE WHEN n_relevant > 0 THEN ps / least(k, n_relevant) ELSE 0.0 END AS ap, mrr FROM g),
mm AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m)"""

_AT_FIVE = """j AS (SELECT t.query_id, SETTING, rank, a.label AS ql, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS rel FROM t JOIN embeddings a ON a.vec_id = t.query_id LEFT JOIN embeddings b ON b.vec_id = t.doc_id WHERE rank <= 5),
      p AS (SELECT query_id, ql, SETTING, max(rel) AS hit, coalesce(max(1 / rank) FILTER (rel = 1), 0) AS rr, sum(rel / log2(rank + 1)) AS dcg FROM j GROUP BY ALL),
      e AS (SELECT label, list_sum(list_transform(range(1, least(5, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM embeddings GROUP BY label)
      SELECT SETTING, count(*) AS n, round(avg(hit), 6) AS hit_at_5, round(avg(rr), 6) AS mrr, round(avg(dcg / ideal), 6) AS ndcg_at_5 FROM p JOIN e ON ql = label GROUP BY SETTING"""

_FITS = "(q.only IS NULL OR q.only = 'country=' || a.lang OR q.only = 'source=' || a.source)"
_GOLDEN = """g0 AS (SELECT item_id AS query_id, CASE WHEN item_id % 11 = 5 THEN '' ELSE b.text END AS text, CASE WHEN item_id % 7 <> 3 THEN embedding END AS embedding, lang,
    CASE item_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparative' ELSE 'gap_detection' END AS category, CASE WHEN item_id % 5 = 0 THEN 0 WHEN item_id % 4 = 1 THEN 2 ELSE 1 END AS countries
  FROM benchmark b LEFT JOIN embeddings ON item_id = vec_id LEFT JOIN documents d ON doc_id = item_id),
g1 AS (SELECT query_id, text, embedding, category, countries, CASE WHEN category = 'comparative' THEN NULL WHEN query_id % 2 = 0 AND countries = 0 THEN 'source=src1' WHEN countries = 1 THEN 'country=' || lang END AS only FROM g0)"""
_QA = f"{_GOLDEN}, q AS (SELECT * FROM g1 WHERE category = 'factual' AND countries = 1 AND embedding IS NOT NULL AND text <> '' ORDER BY query_id LIMIT 20)"
_VARIANTS = f"""{_GOLDEN}, q AS (SELECT * FROM g1), {sql_bm25('q')}, {sql_sparse(80)}, {_dense_sql(40, f"q.embedding IS NOT NULL AND {_FITS}")},
bad AS (SELECT query_id, embedding IS NULL AS d, len({sql_tokenise('text')}) = 0 AS s FROM q),
sx AS (SELECT sparse.* FROM sparse JOIN q USING (query_id) JOIN documents a USING (doc_id) JOIN bad USING (query_id) WHERE {_FITS} AND NOT bad.s),
s2 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sx) WHERE rank <= 40), {_FUSED},
every AS (SELECT 'dense' AS variant, query_id, doc_id, rank AS place FROM dense WHERE rank <= 30
  UNION ALL SELECT 'sparse', * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM sx WHERE rank <= 60) WHERE place <= 30
  UNION ALL SELECT 'hybrid', query_id, doc_id, fused_rank FROM f2 WHERE fused_rank <= 30),
l AS (SELECT variant, query_id, doc_id, row_number() OVER (PARTITION BY variant, query_id ORDER BY place) AS rank FROM every JOIN documents a USING (doc_id) WHERE NOT {sql_garbled('a.text')}),
j AS (SELECT l.*, CASE WHEN a.label = b.label THEN 1 ELSE 0 END AS relevant FROM l JOIN embeddings a ON a.vec_id = query_id LEFT JOIN embeddings b ON b.vec_id = doc_id WHERE rank <= 10),
h AS (SELECT *, sum(relevant) OVER (PARTITION BY variant, query_id ORDER BY rank) AS hits FROM j),
n AS (SELECT query_id, variant, (SELECT count(*) FROM embeddings b WHERE b.label = a.label) AS n_relevant,
    CASE WHEN variant <> 'sparse' AND bad.d AND (variant = 'dense' OR bad.s) THEN 'no vector' WHEN variant = 'sparse' AND bad.s THEN 'no terms' END AS error
  FROM bad JOIN embeddings a ON a.vec_id = query_id, (SELECT unnest(['dense', 'sparse', 'hybrid']) AS variant)),
g AS (SELECT n.query_id, n.variant, k, error, n_relevant, count(*) FILTER (rank <= k AND relevant = 1) AS hit, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= k AND relevant = 1), 0) AS dcg,
    coalesce(sum(hits / rank) FILTER (rank <= k AND relevant = 1), 0) AS ps, coalesce(max(1 / rank) FILTER (relevant = 1), 0) AS mrr
  FROM n CROSS JOIN (SELECT unnest([1, 3, 5, 10])::BIGINT AS k) LEFT JOIN h ON h.query_id = n.query_id AND h.variant = n.variant GROUP BY ALL),
m AS (SELECT query_id, variant, k, error, CASE WHEN error IS NULL THEN hit / k END AS p, CASE WHEN error IS NULL THEN CASE WHEN n_relevant = 0 THEN 1.0 ELSE hit / n_relevant END END AS r, CASE WHEN error IS NULL THEN CASE WHEN hit > 0 THEN 1.0 ELSE 0.0 END END AS hit_rate,
    CASE WHEN error IS NULL THEN dcg / list_sum(list_transform(range(1, least(k, n_relevant) + 1), lambda i: 1 / log2(i + 1))) END AS ndcg, CASE WHEN error IS NULL THEN ps / least(k, n_relevant) END AS ap, CASE WHEN error IS NULL THEN mrr END AS mrr FROM g)"""

ORACLE_SQL = {
    "bm25_topk": f"WITH {_Q}, {sql_bm25('q')}, {sql_sparse(10)} SELECT query_id, doc_id, score, rank FROM sparse",
    "sparse_post_filter": f"""WITH {_Q}, {sql_bm25('q')}, {sql_sparse(80)} SELECT query_id, doc_id, score, rank FROM (
      SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 40""",
    "dense_topk": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_DENSE})) WHERE rank <= 10",
    "dense_pre_filter": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_DENSE} AND b.label IN (1, 2, 3))) WHERE rank <= 10",
    "rrf_hybrid": f"""WITH {_QV}, {sql_bm25('q')}, {sql_sparse(80)}, {_dense_sql(40, "a.lang = 'en'")},
      s2 AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 40), {_FUSED}
      SELECT * FROM (SELECT f2.*, row_number() OVER (PARTITION BY query_id ORDER BY fused_rank) AS rank FROM f2 JOIN documents a USING (doc_id)
        WHERE fused_rank <= 30 AND NOT {sql_garbled('a.text')}) WHERE rank <= 10""",
    "hybrid_debug": f"""WITH {_QV}, {sql_bm25('q')}, {sql_sparse(80)}, {_dense_sql(40)}, s2 AS (SELECT * FROM sparse WHERE rank <= 40), {_FUSED}
      SELECT f2.*, {sql_garbled('a.text')} AS garbled FROM f2 JOIN documents a USING (doc_id)""",
    "metadata_filter": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('fr', 'de') AND n_chars >= 500 AND coalesce(source NOT IN ('src0', 'src3'), TRUE)",
    "ir_metrics_at_k": f"WITH {_JUDGED} SELECT query_id, k, n_relevant, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, hit_rate::DOUBLE AS hit_rate, round(ndcg, 6) AS ndcg, round(ap, 6) AS ap, round(mrr, 6) AS mrr FROM mm",
    "metrics_grouping_sets": f"""WITH {_JUDGED}, c AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 'factual' WHEN 1 THEN 'comparative' ELSE 'gap_detection' END AS category, CASE WHEN query_id % 2 = 0 THEN 'easy' ELSE 'hard' END AS difficulty FROM mm)
      SELECT k, category, difficulty, count(*) AS n, round(avg(p), 5) AS precision, round(avg(r), 5) AS recall, round(avg(f1), 5) AS f1, round(avg(hit_rate), 5) AS hit_rate, round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS ap, round(avg(mrr), 5) AS mrr
      FROM c GROUP BY GROUPING SETS ((k), (k, category), (k, difficulty))""",
    "ablation_rrf_k": f"""WITH {_QV}, {sql_bm25('q')}, {sql_sparse(40)}, {_dense_sql(40)},
      f AS (SELECT query_id, doc_id, rrf_k, dense.rank AS dr, sparse.rank AS sr, round(coalesce(1 / (rrf_k + dense.rank), 0) + coalesce(1 / (rrf_k + sparse.rank), 0), 6) AS rrf
        FROM dense FULL OUTER JOIN sparse USING (query_id, doc_id) CROSS JOIN (SELECT unnest([30, 60, 120])::BIGINT AS rrf_k)),
      t AS (SELECT *, row_number() OVER (PARTITION BY query_id, rrf_k ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST) AS rank FROM f),
      {_AT_FIVE.replace('SETTING', 'rrf_k')}""",
    "ablation_bm25_k1": "WITH " + _Q + ", " + sql_bm25("q", "k1 / 10.0").replace("idf USING (term) JOIN tf USING (term), s GROUP BY ALL", "idf USING (term) JOIN tf USING (term), s, (SELECT unnest([12, 16, 20]) AS k1) GROUP BY ALL").replace("SELECT query_id, doc_id, round(sum", "SELECT query_id, doc_id, k1, round(sum") + f""",
      t AS (SELECT query_id, doc_id, score, k1::BIGINT AS k1_tenths, row_number() OVER (PARTITION BY query_id, k1 ORDER BY score DESC, doc_id) AS rank FROM sc),
      {_AT_FIVE.replace('SETTING', 'k1_tenths').replace("SELECT k1_tenths, count(*)", ", u AS (SELECT k1_tenths, count(*)")})
      SELECT u.*, best_score, doc_id_sum FROM u JOIN (SELECT k1_tenths, round(avg(score) FILTER (rank = 1), 4) AS best_score, sum(doc_id)::BIGINT AS doc_id_sum FROM t WHERE rank <= 10 GROUP BY k1_tenths) USING (k1_tenths)""",
    "bm25_index": f"""WITH {_Q}, {sql_bm25('q')} SELECT term, count(*) AS df, round(any_value(idf), 6) AS idf, sum(tf)::BIGINT AS tf, sum(dl)::BIGINT AS dl FROM tf JOIN idf USING (term) GROUP BY term""",
    "dense_only": f"""WITH {_QV}, {_dense_sql(30)}, g AS (SELECT dense.* FROM dense JOIN documents a USING (doc_id) WHERE NOT {sql_garbled('a.text')})
      SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
    "sparse_only": f"""WITH {_QV}, {sql_bm25('q')}, {sql_sparse(60)},
      f AS (SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse JOIN documents USING (doc_id) WHERE lang = 'en') WHERE rank <= 30),
      g AS (SELECT f.* FROM f JOIN documents a USING (doc_id) WHERE NOT {sql_garbled('a.text')})
      SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g) WHERE rank <= 10""",
    "ablation_filter": f"""WITH {_QA}, {sql_bm25('q')}, {sql_sparse(40)}, w AS (SELECT unnest(['filtered', 'open']) AS setting),
      v AS (SELECT setting, q.query_id, a.doc_id, round(list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM q, documents a JOIN embeddings v ON a.doc_id = v.vec_id, w WHERE setting = 'open' OR {_FITS}),
      dn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, doc_id) AS rank FROM v) WHERE rank <= 20),
      sp AS (SELECT * FROM (SELECT setting, query_id, doc_id, score, row_number() OVER (PARTITION BY setting, query_id ORDER BY score DESC, doc_id) AS rank FROM sparse JOIN q USING (query_id) JOIN documents a USING (doc_id), w WHERE setting = 'open' OR {_FITS}) WHERE rank <= 20),
      f AS (SELECT setting, query_id, doc_id, dn.rank AS dr, sp.rank AS sr, round(coalesce(1.0 / (60 + dn.rank), 0) + coalesce(1.0 / (60 + sp.rank), 0), 6) AS rrf FROM dn FULL OUTER JOIN sp USING (setting, query_id, doc_id)),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST) AS place FROM f) WHERE place <= 15),
      t AS (SELECT setting, query_id, doc_id, row_number() OVER (PARTITION BY setting, query_id ORDER BY place) AS rank FROM o JOIN documents a USING (doc_id) WHERE NOT {sql_garbled('a.text')}),
      {_AT_FIVE.replace('SETTING', 'setting')}""",
    "ablation_pool": f"""WITH {_QV}, {sql_bm25('q')}, {sql_sparse(40)}, {_dense_sql(40)}, w AS (SELECT unnest([2, 4, 8]) AS pool),
      dn AS (SELECT * FROM dense, w WHERE rank <= 5 * pool), sp AS (SELECT * FROM sparse, w WHERE rank <= 5 * pool),
      f AS (SELECT pool::BIGINT AS pool, query_id, doc_id, dn.rank AS dr, sp.rank AS sr, round(coalesce(1.0 / (60 + dn.rank), 0) + coalesce(1.0 / (60 + sp.rank), 0), 6) AS rrf FROM dn FULL OUTER JOIN sp USING (pool, query_id, doc_id)),
      o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pool, query_id ORDER BY rrf DESC, dr NULLS LAST, sr NULLS LAST) AS place FROM f) WHERE place <= 15),
      t AS (SELECT pool, query_id, doc_id, row_number() OVER (PARTITION BY pool, query_id ORDER BY place) AS rank FROM o JOIN documents a USING (doc_id) WHERE NOT {sql_garbled('a.text')}),
      {_AT_FIVE.replace('SETTING', 'pool')}""",
    "variant_rows": f"WITH {_VARIANTS} SELECT query_id, variant, k, error, round(p, 6) AS precision, round(r, 6) AS recall, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM m",
    "variant_evaluation": f"""WITH {_VARIANTS} SELECT variant, k, count(*) FILTER (error IS NULL) AS n, count(*) FILTER (error IS NOT NULL) AS n_failed, round(avg(p), 5) AS precision, round(avg(r), 5) AS recall,
      round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) WHEN error IS NULL THEN 0.0 END), 5) AS f1, round(avg(hit_rate), 5) AS hit_rate, round(avg(ndcg), 5) AS ndcg, round(avg(ap), 5) AS ap, round(avg(mrr), 5) AS mrr FROM m GROUP BY variant, k""",
    "vector_index": f"SELECT query_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_DENSE})) WHERE rank <= 10",
}
_LABELLED = ", ".join(f"'{n}@' || k" for n in variants.LABELS.values())
ORACLE_SQL["variant_table"] = f"""WITH x AS ({ORACLE_SQL['variant_evaluation']}), l AS (SELECT variant, unnest([{_LABELLED}, CASE WHEN k = 10 THEN 'MRR' END]) AS metric, unnest([{', '.join(variants.LABELS)}, mrr]) AS value FROM x)
SELECT metric, max(value) FILTER (variant = 'dense') AS dense, max(value) FILTER (variant = 'sparse') AS sparse, max(value) FILTER (variant = 'hybrid') AS hybrid,
  arg_max(variant, value * 1e6 - list_position(['dense', 'sparse', 'hybrid'], variant) / 10) AS best FROM l WHERE metric IS NOT NULL GROUP BY metric"""
