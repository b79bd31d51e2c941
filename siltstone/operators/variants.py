"""Every question under every variant of the search, as one plan.

One dense and one sparse search serve all variants; each question carries its own filter as a key that rows
must answer to, so a batch of different filters is one search.  A question that a variant
cannot answer is a row with an error, without metrics, and means leave it out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokenise

from .evaluation import CUTS, ranking_metrics
from .retrieval import dense_topk, fuse, fused_order, gated
from .sparse import SparseIndex, bm25_topk, ranked

METRICS = ("precision", "recall", "f1", "hit_rate", "ndcg", "ap", "mrr")


def question_subset(golden: DataFrame, category: str, countries: int, most: int) -> DataFrame:
    """The first ``most`` questions of a category that name so many countries, by id."""
    return golden.where((F.col("category") == category) & (F.size("countries") == countries)).orderBy("query_id").limit(most)


def _failing(variant: str) -> Column:
    """Why a variant cannot answer a question (query_id, text, embedding), or null; the hybrid answers with one side alone."""
    no_vector, no_terms = F.col("embedding").isNull(), F.size(tokenise(F.coalesce("text", F.lit("")))) == 0
    return {
        "dense": F.when(no_vector, "no vector"),
        "sparse": F.when(no_terms, "no terms"),
        "hybrid": F.when(no_vector & no_terms, "no vector"),
    }[variant]


def run(questions: DataFrame, docs: DataFrame, index: SparseIndex, k: int = 10, variants: tuple[str, ...] = ("dense", "sparse", "hybrid"), pool: int = 4, rrf_k: float = 60.0) -> DataFrame:
    """(query_id, variant, doc_id, rank, error): the first ``k`` rows of each question and variant; failures, and lists without rows, have one row without a document.

    ``questions``: query_id, text, embedding, only (a key or null); ``docs``: doc_id, text, embedding, keys.
    The dense side filters before it ranks, the sparse side after; all lists pass the quality gate.
    """
    asked = questions.select("query_id", "text", "embedding", "only")
    able = asked.withColumn("terms", F.size(tokenise(F.coalesce("text", F.lit("")))) > 0)
    depth = pool * k
    dense = dense_topk(asked, docs, depth)
    found = bm25_topk(able.where("terms").select("query_id", "text"), docs, index, 2 * depth)
    fits = F.col("only").isNull() | F.array_contains("keys", F.col("only"))
    found = found.join(asked.select("query_id", "only"), "query_id").join(docs.select("doc_id", "keys"), "doc_id").where(fits).select("query_id", "doc_id", "score", "rank")
    best = (F.desc("score"), F.col("doc_id"))
    parts = {
        "dense": lambda: dense.where(F.col("rank") <= 3 * k).select("query_id", "doc_id", F.col("rank").alias("place")),
        "sparse": lambda: ranked(found.where(F.col("rank") <= 6 * k).drop("rank"), 3 * k, *best).select("query_id", "doc_id", F.col("rank").alias("place")),
        "hybrid": lambda: ranked(fuse(dense, ranked(found.drop("rank"), depth, *best), rrf_k), 3 * k, *fused_order()).select("query_id", "doc_id", F.col("rank").alias("place")),
    }
    every = reduce(DataFrame.unionByName, [parts[v]().withColumn("variant", F.lit(v)) for v in variants])
    every = every.withColumn("query_id", F.struct("query_id", "variant")).withColumn("rank", F.col("place"))
    kept = gated(every, docs, k, F.col("place")).select("query_id.query_id", "query_id.variant", "doc_id", "rank")
    grid = asked.select("query_id", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), _failing(v).alias("error")) for v in variants])).alias("v")).select("query_id", "v.variant", "v.error")
    return grid.join(kept, ["query_id", "variant"], "left").select("query_id", "variant", "doc_id", "rank", "error")


def judged(lists: DataFrame, relevant: DataFrame, totals: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(query_id, variant, k, error, n_relevant, metrics) of ``run``'s lists; ``relevant``: (query_id, doc_id) pairs, ``totals``: n_relevant of every question."""
    hit = relevant.select("query_id", "doc_id", F.lit(1).alias("relevant")).distinct()
    marked = lists.where("doc_id is not null").join(hit, ["query_id", "doc_id"], "left").select(F.struct("query_id", "variant").alias("query_id"), "rank", F.coalesce("relevant", F.lit(0)).alias("relevant"))
    errors = lists.groupBy("query_id", "variant").agg(F.max("error").alias("error"))
    every = errors.join(totals, "query_id").select(F.struct("query_id", "variant").alias("query_id"), "n_relevant")
    met = ranking_metrics(marked, every, cuts).select("query_id.query_id", "query_id.variant", "k", "n_relevant", *METRICS)
    met = met.join(errors, ["query_id", "variant"])
    return met.select("query_id", "variant", "k", "error", "n_relevant", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) for c in METRICS])


def summary(rows: DataFrame, places: int = 5) -> DataFrame:
    """(variant, k, n, n_failed, means): failed questions are counted and left out of the means."""
    return rows.groupBy("variant", "k").agg(F.count_if(F.col("error").isNull()).alias("n"), F.count_if(F.col("error").isNotNull()).alias("n_failed"), *[F.round(F.avg(c), places).alias(c) for c in METRICS])


def relevant_chunks(chunks: DataFrame, golden: DataFrame, level: str = "page", tolerance: int = 1) -> DataFrame:
    """(query_id, chunk_id): chunks of the document that a question (query_id, source_doc, source_page) names, at its page give or take ``tolerance``.

    A question without a page, and the level ``doc``, take the whole document; one without a document has none.
    """
    met = chunks.select("chunk_id", "doc_id", "page_start").join(golden.select("query_id", F.col("source_doc").alias("doc_id"), "source_page"), "doc_id")
    near = F.col("source_page").isNull() | (F.abs(F.col("page_start") - F.col("source_page")) <= tolerance)
    return met.where(near if level == "page" else F.lit(True)).select("query_id", "chunk_id")


# The names of measures in a table of metrics.
LABELS = {"precision": "P", "recall": "R", "f1": "F1", "hit_rate": "HR", "ndcg": "NDCG", "ap": "MAP"}


def table(means: DataFrame, variants: tuple[str, ...] = ("dense", "sparse", "hybrid")) -> DataFrame:
    """(metric, one column a variant, best): ``summary`` as a wide table, one row a measure and k, with the first variant of the largest value."""
    cells = [F.struct(F.concat(F.lit(f"{n}@"), "k").alias("metric"), F.col(c).alias("value")) for c, n in LABELS.items()]
    deepest = F.max("k").over(Window.partitionBy("variant"))  # the same at every k
    long_ = means.withColumn("deepest", deepest).select("variant", F.explode(F.array(*cells, F.struct(F.when(F.col("k") == F.col("deepest"), "MRR").alias("metric"), F.col("mrr").alias("value")))).alias("c"))
    rows = long_.select("variant", "c.metric", "c.value").where("metric is not null")
    order = F.array_position(F.array(*map(F.lit, variants)), F.col("variant"))
    one = [F.max(F.when(F.col("variant") == v, F.col("value"))).alias(v) for v in variants]
    return rows.groupBy("metric").agg(*one, F.max_by("variant", F.when(F.col("value").isNotNull(), F.struct("value", -order))).alias("best"))
