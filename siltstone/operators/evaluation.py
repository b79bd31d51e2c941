"""Evaluation: ranking metrics, n-gram overlap, hallucination, failures, resampling."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scores import clamp, ratio
from siltstone.functions.text import overlap_tokens

CUTS = (1, 3, 5, 10)


def ranking_metrics(lists: DataFrame, totals: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Long rows (query_id, k, metric columns) from judged ranked lists.

    ``lists``: query_id, rank, relevant (0 or 1); ``totals``: every query_id with ``n_relevant``.
    Precision divides by k; recall is 1 if nothing is relevant, NDCG and average precision
    are 0 then; average precision divides by the smaller of k and the number of relevant rows.
    """
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    gains = lists.withColumn("hits", F.sum("relevant").over(w))
    per = totals.select("query_id", F.col("n_relevant").cast("bigint").alias("n_relevant"), F.explode(F.array(*map(F.lit, cuts))).alias("k"))
    met = per.join(gains, "query_id", "left")
    inside = (F.col("rank") <= F.col("k")) & (F.col("relevant") == 1)
    agg = met.groupBy("query_id", "k", "n_relevant").agg(
        F.coalesce(F.sum(F.when(inside, 1)), F.lit(0)).alias("hits"),
        F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"),
        F.coalesce(F.sum(F.when(inside, F.col("hits") / F.col("rank"))), F.lit(0.0)).alias("precisions"),
        F.coalesce(F.max(F.when(F.col("relevant") == 1, 1 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("k", F.col("n_relevant").cast("int")), F.lit(1))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p, r = F.col("hits") / F.col("k"), ratio(F.col("hits"), F.col("n_relevant"), 1.0)
    return agg.select(
        "query_id", F.col("k").cast("bigint").alias("k"), "n_relevant",
        p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"),
        (F.col("hits") > 0).cast("double").alias("hit_rate"),
        F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("n_relevant") > 0, F.col("precisions") / F.least("k", "n_relevant")).otherwise(0.0).alias("ap"), "mrr",
    )


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces: shifted copies of the array side by side, so linear in its length.

    ``tokens`` should be a column that is there already, since it is named ``n`` times.
    """
    many = F.greatest(F.size(tokens) - n + 1, F.lit(0))
    return reduce(lambda g, i: F.zip_with(g, F.slice(tokens, i, many), lambda x, y: F.concat_ws(" ", x, y)), range(2, n + 1), F.slice(tokens, 1, many))


def rouge(pairs: DataFrame, sizes: tuple[int, ...] = (1, 2), key: str = "id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(key, n, precision, recall, f1): clipped n-gram overlap for each of ``sizes``; nothing in common or an empty side gives 0.

    Texts are split once and both sides' grams of all sizes leave in one pass; multisets meet in
    one aggregate over (key, n, gram): both sides' counts, then their minimum.
    """
    split = lambda c: overlap_tokens(F.coalesce(F.col(c), F.lit("")))
    t = pairs.select(key, F.explode(F.array(F.struct(F.lit(1).alias("side"), split(hyp).alias("t")), F.struct(F.lit(0).alias("side"), split(ref).alias("t")))).alias("s"))
    t = t.select(key, "s.side", F.col("s.t").alias("t"))

    def sized(n: int) -> Column:
        return F.transform(ngrams(F.col("t"), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g")))

    parts = [sized(n) for n in sizes]
    grams = t.select(key, "side", F.explode(F.concat(*parts)).alias("x")).select(key, "x.n", "x.g", "side")
    counts = grams.groupBy(key, "n", "g").agg(F.sum("side").alias("h"), F.sum(1 - F.col("side")).alias("r"))
    sums = counts.groupBy(key, "n").agg(F.sum(F.least("h", "r")).alias("both"), F.sum("h").alias("h"), F.sum("r").alias("r"))
    every = pairs.select(key, F.explode(F.array(*map(F.lit, sizes))).alias("n")).join(sums, [key, "n"], "left").fillna(0, ["both", "h", "r"])
    p, r = ratio(F.col("both"), F.col("h")), ratio(F.col("both"), F.col("r"))
    return every.select(key, "n", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def rouge_n(pairs: DataFrame, n: int, key: str = "id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(key, precision, recall, f1) of one size."""
    return rouge(pairs, (n,), key, hyp, ref).drop("n")


@F.pandas_udf(T.LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays, by bit-parallel rows."""

    def one(x, y) -> int:
        at: dict[str, int] = {}
        for i, w in enumerate(x):
            at[w] = at.get(w, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for w in y:
            hit = row & at.get(w, 0)
            row = ((row + hit) | (row - hit)) & full
        return len(x) - row.bit_count()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")


def rouge_l(pairs: DataFrame, key: str = "id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(key, precision, recall, f1) by the longest common subsequence of tokens."""
    t = pairs.select(key, overlap_tokens(F.coalesce(F.col(hyp), F.lit(""))).alias("h"), overlap_tokens(F.coalesce(F.col(ref), F.lit(""))).alias("r"))
    t = t.withColumn("n", lcs_length("h", "r"))
    p, r = ratio(F.col("n"), F.size("h")), ratio(F.col("n"), F.size("r"))
    return t.select(key, p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def hallucination(verdicts: DataFrame, key: str = "id", refused: DataFrame | None = None) -> DataFrame:
    """Rates of an answer from one row a claim with its ``verdict``.

    Answers of ``refused`` (key) gave no answer or an error: no claims, rate 1, grounding 0, whatever their verdicts.
    """
    rows = verdicts.select(key, "verdict")
    if refused is not None:
        rows = rows.unionByName(refused.select(key, F.lit("REFUSED").alias("verdict")))
    n = lambda v: F.count_if(F.col("verdict") == v)
    agg = rows.groupBy(key).agg(F.count("*").alias("n_claims"), n("SUPPORTED").alias("s"), n("PARTIAL").alias("p"), n("UNSUPPORTED").alias("u"), n("FABRICATED").alias("f"), n("REFUSED").alias("none"))
    total, gone = F.col("n_claims"), F.col("none") > 0
    rate, grounding = (F.col("u") + F.col("f")) / total, clamp((F.col("s") + 0.5 * F.col("p") - 0.5 * F.col("f")) / total)
    return agg.select(key, F.when(gone, 0).otherwise(total).cast("bigint").alias("n_claims"), F.when(gone, 1.0).otherwise(rate).alias("hallucination_rate"), F.when(gone, 0.0).otherwise(grounding).alias("grounding_score"))


# Flag, column and threshold of the simple failure flags.
FLAGS = (
    ("RETRIEVAL_MISS", "hit", 0.5, False), ("LOW_CONTEXT_PRECISION", "precision", 0.3, False), ("LOW_CONTEXT_RECALL", "recall", 0.3, False),
    ("LOW_FAITHFULNESS", "faithfulness", 0.5, False), ("HIGH_HALLUCINATION", "hallucination", 0.3, True), ("LOW_RELEVANCY", "relevancy", 0.5, False),
    ("LOW_LEXICAL_OVERLAP", "rouge1", 0.2, False), ("HALLUCINATED_CITATIONS", "bad_citations", 0.0, True),
)


def failure_flags(columns: dict[str, Column]) -> Column:
    """Array of the flags whose measure is beyond its threshold; ``NO_FAILURE`` if none.  Missing measures do not flag."""
    tests = [F.when((columns[c] > t) if above else (columns[c] < t), F.lit(name)) for name, c, t, above in FLAGS if c in columns]
    found = F.array_compact(F.array(*tests))
    return F.when(F.size(found) == 0, F.array(F.lit("NO_FAILURE"))).otherwise(found)


# Failure modes and the layer each is laid to.
LAYERS = {
    "FM1_RETRIEVAL_MISS": "retrieval", "FM2_CONTEXT_PRECISION": "retrieval", "FM3_CONTEXT_RECALL": "retrieval",
    "FM4_HALLUCINATION": "generation", "FM5_OVER_CONSTRAINED": "generation", "FM6_METRIC_MISMATCH": "metric", "FM7_CORPUS_GAP": "corpus", "NONE": "none",
}


def failure_taxonomy(df: DataFrame) -> DataFrame:
    """Adds ``modes`` (array) and ``primary_mode`` from hit, precision, recall, rouge1, hallucination, grounding, faithfulness, insufficient."""
    f1, f2, f3, f4, f5, f6, f7 = list(LAYERS)[:7]
    r1, hall, ground, faith = (F.col(c) for c in ("rouge1", "hallucination", "grounding", "faithfulness"))
    prec, rec = F.col("precision"), F.col("recall")
    valid = (prec > 0.01) | (rec > 0.01)
    t1 = ~F.col("hit") & (r1 < 0.20)
    t2, t3 = valid & (prec < 0.35) & ~t1, valid & (rec < 0.20) & ~t1
    t4 = ((hall > 0.35) | ((faith > 0.01) & (faith < 0.45))) & ~t1
    t5 = (r1 < 0.15) & (ground > 0.40) & (hall < 0.30) & ~t4 & ~t1
    t6 = (ground > 0.55) & (r1 < 0.20) & (hall < 0.25) & ((faith <= 0.01) | (faith > 0.55)) & ~t4 & ~t5 & ~t1
    fired = F.array_compact(F.array(*[F.when(t, F.lit(m)) for t, m in ((t1, f1), (t3, f3), (t2, f2), (t4, f4), (t5, f5), (t6, f6))]))
    other = F.when((r1 > 0.25) & (hall < 0.30), "NONE").when((hall > 0.20) & (r1 < 0.25), f4).when(r1 < 0.20, f5).otherwise(f6)
    modes = F.when(F.col("insufficient"), F.array(F.lit(f7))).when(F.size(fired) > 0, fired).otherwise(F.array(other))
    return df.withColumn("modes", modes).withColumn("primary_mode", F.col("modes")[0])


def layer_of(mode: Column) -> Column:
    return reduce(lambda c, kv: c.when(mode == kv[0], kv[1]), LAYERS.items(), F.when(F.lit(False), "")).otherwise("other")


def layer_attribution(modes: DataFrame) -> DataFrame:
    """(layer, n, pct) of ``primary_mode``."""
    total = Window.partitionBy()
    by = modes.groupBy(layer_of(F.col("primary_mode")).alias("layer")).agg(F.count("*").alias("n"))
    return by.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(total))


def failure_predictors(df: DataFrame, properties: dict[str, Column], fails: Column) -> DataFrame:
    """(property, n, failure_rate, delta, note) for boolean properties, beside the baseline.

    One pass: properties become rows and one aggregate counts all of them.
    """
    rows = df.select(fails.cast("double").alias("fail"), F.explode(F.array(F.lit("baseline"), *[F.when(c, F.lit(n)) for n, c in properties.items()])).alias("property")).where("property is not null")
    agg = rows.groupBy("property").agg(F.count("*").alias("n"), F.avg("fail").alias("failure_rate"))
    base = agg.where("property = 'baseline'").select(F.col("failure_rate").alias("base"))
    delta = F.col("failure_rate") - F.col("base")
    note = F.when(delta > 0.05, "higher failure rate").when(delta < -0.05, "lower failure rate").otherwise("similar to baseline")
    return agg.crossJoin(F.broadcast(base)).select("property", "n", "failure_rate", delta.alias("delta"), note.alias("note"))  # one row


def exemplars(cases: DataFrame, by: str, most: int, *order: Column) -> DataFrame:
    """(``by``, n, cases): how many rows each group has, and its first ``most`` as structs, in order.

    Rows are limited in each task before the shuffle, so an array never holds more than ``most``.
    """
    rest = [c for c in cases.columns if c != by]
    placed = cases.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)
    nested = placed.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("cases"))
    counts = cases.groupBy(by).agg(F.count("*").alias("n"))
    return counts.join(nested.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", "cases")


# What is advised, when: the kind of fact and its name, the value it must be above, and the priority.
RULES = (
    ("FM1_RETRIEVAL_MISS", "count", "FM1_RETRIEVAL_MISS", 0.0, "HIGH", "widen retrieval"),
    ("FM2_CONTEXT_PRECISION", "count", "FM2_CONTEXT_PRECISION", 0.0, "HIGH", "rank contexts again"),
    ("FM3_CONTEXT_RECALL", "count", "FM3_CONTEXT_RECALL", 0.0, "MEDIUM", "fetch more contexts"),
    ("FM4_HALLUCINATION", "count", "FM4_HALLUCINATION", 0.0, "HIGH", "bind answers to contexts"),
    ("FM5_OVER_CONSTRAINED", "count", "FM5_OVER_CONSTRAINED", 0.0, "MEDIUM", "ask for the figures"),
    ("FM7_CORPUS_GAP", "pct", "corpus", 10.0, "MEDIUM", "extend the corpus"),
    ("HARD_QUESTIONS", "delta", "hard", 0.10, "MEDIUM", "fetch more for hard questions"),
)
PRIORITIES = ("HIGH", "MEDIUM", "LOW")


def facts(modes: DataFrame, layers: DataFrame, predictors: DataFrame) -> DataFrame:
    """(kind, name, value): counts of failure modes, percentages of layers, and what properties add to the failure rate."""
    n = modes.select(F.explode("modes").alias("name")).groupBy("name").agg(F.count("*").cast("double").alias("value"))
    return (
        n.select(F.lit("count").alias("kind"), "name", "value")
        .unionByName(layers.select(F.lit("pct").alias("kind"), F.col("layer").alias("name"), F.col("pct").cast("double").alias("value")))
        .unionByName(predictors.select(F.lit("delta").alias("kind"), F.col("property").alias("name"), F.col("delta").alias("value")))
    )


def advise(found: DataFrame, rules=RULES) -> DataFrame:
    """(target, priority, advice, value, place): the rules whose fact is above their limit, in order of priority and then of the rules."""
    spark = found.sparkSession
    table = spark.createDataFrame([(*r, 100 * PRIORITIES.index(r[4]) + i) for i, r in enumerate(rules)], "target string, kind string, name string, above double, priority string, advice string, place long")
    return found.join(F.broadcast(table), ["kind", "name"]).where(F.col("value") > F.col("above")).select("target", "priority", "advice", "value", "place")  # as many rows as rules


def extremes(df: DataFrame, by: str, value: str, places: int = 5) -> DataFrame:
    """(``by``, mean, best, worst): each group's mean, and whether it is the largest or the smallest of all."""
    means = df.groupBy(by).agg(F.round(F.avg(value), places).alias("mean"))
    every = Window.partitionBy()  # one row a group
    return means.select(by, "mean", (F.col("mean") == F.max("mean").over(every)).alias("best"), (F.col("mean") == F.min("mean").over(every)).alias("worst"))


def metric_table(rows: DataFrame, variant: str, metrics: dict[str, bool]) -> DataFrame:
    """(metric, variant, value, best): wide measures as rows, with a flag at the best of each metric; ``metrics`` tells which are better when larger."""
    wide = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(up).alias("up")) for m, up in metrics.items()]))
    long_ = rows.select(F.col(variant).alias("variant"), wide.alias("m")).select("m.metric", "variant", "m.value", "m.up")
    best = Window.partitionBy("metric")
    flag = F.col("value") == F.when(F.col("up"), F.max("value").over(best)).otherwise(F.min("value").over(best))
    return long_.select("metric", "variant", "value", F.coalesce(flag, F.lit(False)).alias("best"))


def rouge_all(pairs: DataFrame, key: str = "id", hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """(key, rouge1, rouge2, rougeL): structs of precision, recall and f1."""
    grams = rouge(pairs, (1, 2), key, hyp, ref)
    one = lambda n: F.max(F.when(F.col("n") == n, F.struct("precision", "recall", "f1"))).alias(f"rouge{n}")
    lcs = rouge_l(pairs, key, hyp, ref).select(key, F.struct("precision", "recall", "f1").alias("rougeL"))
    return grams.groupBy(key).agg(one(1), one(2)).join(lcs, key)
