"""Gap cells, matrices and rankings; answer metrics, failures, attribution and resampling; ingestion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.scores import canonical_gap_type, cost, dirty_null, safe_double, severity_label
from siltstone.functions.text import overlap_tokens
from siltstone.operators import evaluation, gap, passes, resampling
from siltstone.sources import files
from siltstone.streaming.incremental import windowed_counts

from .common import DIMENSIONS, SQL_CELLS, SQL_EXCHANGES, cells, exchanges, sql_label, sql_overlap, table

# -- gap cells -----------------------------------------------------------------------------


def severity_labels(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("entity", "dimension", "score", severity_label(F.col("score")).alias("label"))


def gap_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = gap.matrix(cells(spark, d), DIMENSIONS)
    return m.toDF("entity", *[f"dim_{x[0]}" for x in DIMENSIONS])


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """Cells with several sources: an override in Asia, reports where orders are many, originals below a half."""
    c = cells(spark, d)
    nations = table(spark, d, "nation").select(F.col("n_name").alias("entity"))
    grid = gap.grid(nations, spark.createDataFrame([(x,) for x in DIMENSIONS], "dimension string"))
    level = F.when(F.col("commitments") % 4 == 0, "VAGUE").when(F.col("commitments") % 4 == 1, "QUANTIFIED").when(F.col("commitments") % 4 == 2, "ABSENT").otherwise("QUALIFIED")
    single = c.where("commitments >= 100").select("entity", "dimension", "score", level.alias("level"), "commitments", (F.col("score") >= 0.48).alias("has_findings"))
    return gap.merge_cells(grid, c.where("n_regionkey = 2").select("entity", "dimension", (F.col("score") / 2).alias("score")), single, c.where("score < 0.5"))


def precedence_merge(spark: SparkSession, d: str) -> DataFrame:
    return _merged(spark, d)


def pairwise_leader(spark: SparkSession, d: str) -> DataFrame:
    p = gap.pairs(cells(spark, d))
    return p.select("dimension", "entity_a", "entity_b", F.round("relative_gap", 6).alias("relative_gap"), "leader")


def entity_ranking(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d).select("entity", "score")
    r = gap.ranking(c)
    return r.select("entity", F.round("mean_score", 5).alias("mean_score"), "cells", "label")


def gap_passes(spark: SparkSession, d: str) -> DataFrame:
    """All cells through the three model passes of the stand-in; rows only."""
    c = cells(spark, d).withColumn("evidence", F.format_string("%d orders of %s", "commitments", "entity")).withColumn("benchmark", F.concat(F.lit("finished by now: "), F.col("dimension")))
    a = passes.analyse(c.select("entity", "position", "dimension", "evidence", "benchmark"), passes.stand_in)
    return a.select("entity", "dimension", "level", "score", "label", "severity_first", F.size("commitments").alias("n_commitments"), "status")


def worst_findings(spark: SparkSession, d: str) -> DataFrame:
    """Per order the largest line discount as a finding's score, beside the first finding's severity."""
    f = F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("severity"), F.col("l_discount").alias("severity_score"))))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(f.alias("f"))
    w = gap.worst_finding(F.col("f"))
    return rows.select("l_orderkey", w["score"].alias("score"), w["severity_first"].alias("severity_first"), w["severity_of_max"].alias("severity_of_max"))


def normalised_values(spark: SparkSession, d: str) -> DataFrame:
    """Dirty values read back: empty objects as missing, numbers from text, one spelling a type."""
    e = table(spark, d, "events")
    dirty = F.when(F.col("event_id") % 3 == 0, "{}").when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise("n/a")
    kind = F.when(F.col("event_id") % 2 == 0, F.concat(F.upper("event_type"), F.lit(" -Target"))).otherwise(F.lit("VAGUE vs MEASURABLE"))
    return e.select("event_id", dirty_null(dirty).alias("value"), safe_double(dirty_null(dirty), -1.0).alias("number"), canonical_gap_type(kind).alias("kind"))


# -- answers -------------------------------------------------------------------------------


def rouge_1_2(spark: SparkSession, d: str) -> DataFrame:
    r = evaluation.rouge(exchanges(spark, d))
    return r.groupBy("id").agg(*[F.round(F.max(F.when(F.col("n") == n, F.col(c))), 6).alias(f"{c[0]}{n}") for n in (1, 2) for c in ("precision", "recall", "f1")])


def rouge_l(spark: SparkSession, d: str) -> DataFrame:
    """By the longest common subsequence; rounded."""
    m = evaluation.rouge_l(exchanges(spark, d))
    return m.select("id", *[F.round(c, 6).alias(n) for c, n in (("precision", "p"), ("recall", "r"), ("f1", "f"))])


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Measures of each reply: overlap as ROUGE-1, its precision and recall as context measures."""
    ex = exchanges(spark, d)
    r = evaluation.rouge_n(ex, 1).select("id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("rouge1"))
    m = r.join(ex, "id")
    return m.select(
        "id", "precision", "recall", "rouge1", (F.col("recall") > 0.1).alias("hit"), F.round(1 - F.col("precision"), 6).alias("hallucination"),
        F.round(F.least(F.col("recall") * 2, F.lit(1.0)), 6).alias("grounding"), F.col("precision").alias("faithfulness"), (F.length("hyp") < 60).alias("insufficient"),
        (F.col("conv_id") % 3).alias("category"), F.length("hyp").alias("answer_length"), F.length("ref").alias("question_length"), "turn", F.col("ref").rlike("[0-9]").alias("numbers"),
    )


def failure_flags(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    c = {k: F.col(k) for k in ("precision", "recall", "faithfulness", "hallucination", "rouge1")} | {"hit": F.col("hit").cast("double")}
    return a.select("id", F.array_join(evaluation.failure_flags(c), "|").alias("flags"))


def failure_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.failure_taxonomy(_answers(spark, d))
    return t.select("id", F.array_join("modes", "|").alias("modes"), "primary_mode", evaluation.layer_of(F.col("primary_mode")).alias("layer"))


def layer_attribution(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.layer_attribution(evaluation.failure_taxonomy(_answers(spark, d))).select("layer", "n", F.round("pct", 4).alias("pct"))


def failure_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Each mode's count, share, mean overlap and worst three answers."""
    t = evaluation.failure_taxonomy(_answers(spark, d)).select("id", "rouge1", F.explode("modes").alias("mode"))
    # the three worst are limited in each task before the shuffle; counts and means combine there too
    worst = t.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy("rouge1", "id"))).where("place <= 3")
    named = worst.groupBy("mode").agg(F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), ",").alias("exemplars"))
    agg = t.groupBy("mode").agg(F.count("*").alias("n"), F.round(F.avg("rouge1"), 5).alias("mean_rouge1")).join(named, "mode")
    return agg.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 4))


def failure_predictors(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.failure_taxonomy(_answers(spark, d))
    p = {"factual": F.col("category") == 0, "comparative": F.col("category") == 1, "gap_detection": F.col("category") == 2, "insufficient": F.col("insufficient"), "long_question": F.col("question_length") > 250, "long_answer": F.col("answer_length") > 600, "numbers": F.col("numbers"), "later_turn": F.col("turn") > 2}
    fails = ~F.col("primary_mode").isin("NONE", "FM6_METRIC_MISMATCH", "FM7_CORPUS_GAP")
    return evaluation.failure_predictors(t, p, fails).select("property", "n", F.round("failure_rate", 5).alias("failure_rate"), F.round("delta", 5).alias("delta"), "note")


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    t = evaluation.failure_taxonomy(_answers(spark, d))
    fails = ~F.col("primary_mode").isin("NONE", "FM6_METRIC_MISMATCH", "FM7_CORPUS_GAP")
    return evaluation.failure_predictors(t, {"hard": F.col("turn") > 2, "numbers": F.col("numbers")}, fails)


def recommendations(spark: SparkSession, d: str) -> DataFrame:
    """Advice whose rule holds: modes that occur, a corpus gap of over a tenth, hard questions that fail more often by over a tenth."""
    t = evaluation.failure_taxonomy(_answers(spark, d))
    return evaluation.advise(evaluation.facts(t, evaluation.layer_attribution(t), _predicted(spark, d))).withColumn("value", F.round("value", 4))


def failure_cases(spark: SparkSession, d: str) -> DataFrame:
    """The three worst answers of over 20 characters of each mode as nested cases, one line a case."""
    t = evaluation.failure_taxonomy(_answers(spark, d)).where("answer_length > 20").join(exchanges(spark, d).select("id", F.substring("ref", 1, 300).alias("question"), F.substring("hyp", 1, 300).alias("answer")), "id")
    cases = t.select(F.explode("modes").alias("mode"), "id", "rouge1", "category", "hallucination", "question", "answer")
    nested = evaluation.exemplars(cases, "mode", 3, F.col("rouge1"), F.col("id"))
    return nested.select("mode", "n", F.explode("cases").alias("c")).select("mode", "n", F.col("c.place").cast("bigint").alias("place"), "c.id", "c.rouge1", "c.category", "c.hallucination", "c.question", "c.answer")


def category_extremes(spark: SparkSession, d: str) -> DataFrame:
    """Mean overlap of each category, the best and the worst marked."""
    return evaluation.extremes(_answers(spark, d), "category", "rouge1")


def common_leader(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of nations over the dimensions that both have (a quarter of the cells is left out), led by the smaller total."""
    c = cells(spark, d).where("commitments % 4 > 0")
    return gap.common_leader(c).select("entity_a", "entity_b", F.array_join("common", ",").alias("common"), "total_a", "total_b", "leader")


def metric_table(spark: SparkSession, d: str) -> DataFrame:
    """The models' measures as a long table with the best of each marked."""
    return evaluation.metric_table(model_summary(spark, d), "model", {"hallucination_rate": False, "unsupported_pct": False, "cost": False, "n": True})


def common_words(spark: SparkSession, d: str) -> DataFrame:
    """The ten most common words of each role, ties by word."""
    words = table(spark, d, "conversations").select("role", F.explode(overlap_tokens(F.coalesce("text", F.lit("")))).alias("word"))
    n = words.groupBy("role", "word").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "word")).cast("bigint")).where("place <= 10")


def model_summary(spark: SparkSession, d: str) -> DataFrame:
    """A model is a return flag, an answer a line: means, shares of sums, cost and a latency quantile."""
    li = table(spark, d, "lineitem")
    tokens = F.col("l_quantity") * 100
    return li.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("hallucination_rate"),
        F.round(F.sum("l_tax") * 100 / F.sum(F.col("l_tax") + F.col("l_discount")), 4).alias("unsupported_pct"),
        F.round(F.sum(cost(tokens, 0.005)), 2).alias("cost"), F.round(F.coalesce(F.avg(F.nanvl(F.col("l_extendedprice"), F.lit(None).cast("double"))), F.lit(0.0)), 3).alias("latency"),
    )


def model_advantage(spark: SparkSession, d: str) -> DataFrame:
    """Per category how often replies gain clearly, lose, or fail on both measures; zeros do not count."""
    a = _answers(spark, d).where("precision > 0 and recall > 0")
    delta = F.col("precision") - F.col("recall")
    return a.groupBy("category").agg(F.count_if(delta > 0.15).alias("gains"), F.count_if(delta < -0.05).alias("losses"), F.count_if(F.greatest("precision", "recall") < 0.15).alias("both_low"), F.count("*").alias("n"))


def argmax_by_group(spark: SparkSession, d: str) -> DataFrame:
    """The user with the largest total of each event type; ties to the smaller id."""
    t = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return t.groupBy("event_type").agg(F.max_by("user_id", F.struct("total", -F.col("user_id"))).alias("user_id"), F.max("total").alias("total"))


# -- resampling ----------------------------------------------------------------------------


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The mean quality of toxic and of other labels, with its interval."""
    labels = table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "toxic").otherwise("plain").alias("group"), F.col("quality").alias("value"))
    ci = resampling.intervals(labels)
    return ci.select("group", "n", *[F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper")])


def bootstrap_difference(spark: SparkSession, d: str) -> DataFrame:
    """Paired difference of two measures of a document: both sides of a resample are the same rows."""
    labels = table(spark, d, "labels").select(F.lit("quality-toxic").alias("group"), (F.col("quality") - F.col("toxic")).alias("value"))
    out = resampling.intervals(labels)
    return out.select("group", "n", *[F.round(c, 6).alias(c) for c in ("estimate", "lower", "upper", "p_value")], resampling.verdict(F.col("lower"), F.col("upper")).alias("verdict"))


# -- ingestion -----------------------------------------------------------------------------


def incremental_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the labelled ones do not hold yet."""
    return files.missing_from(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "n_chars")


def status_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total"))


def key_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows, distinct keys and repeats of the documents' sources and ids."""
    docs = table(spark, d, "documents")
    return docs.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), (F.count("*") - F.countDistinct("doc_id")).alias("repeats"), F.countDistinct("source").alias("sources"))


def alias_join(spark: SparkSession, d: str) -> DataFrame:
    """One document stands for several entities: counts by nation through an alias table."""
    pairs = [("fr", "FRANCE"), ("fr", "CANADA"), ("de", "GERMANY"), ("en", "UNITED KINGDOM"), ("en", "UNITED STATES"), ("en", "CANADA"), ("es", "ARGENTINA")]
    alias = F.broadcast(spark.createDataFrame(pairs, "lang string, entity string"))
    return table(spark, d, "documents").join(alias, "lang").groupBy("entity").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    w = windowed_counts(table(spark, d, "events"), width="1 hour")
    return w.select(F.unix_timestamp("window.start").alias("start_s"), "event_type", "n", F.round("total", 3).alias("total"))


def store_metadata(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("key"), "lang", F.when(F.col("n_chars") > 1000, F.col("n_chars")).alias("size"), F.substring("text", 1, 700).alias("snippet"))
    return files.sanitise(docs, ["lang"]).select("key", "lang", "size", F.length("snippet").cast("bigint").alias("snippet_chars"))


_ALL = (severity_labels, gap_matrix, precedence_merge, pairwise_leader, entity_ranking, gap_passes, worst_findings, normalised_values, rouge_1_2, rouge_l, failure_flags, failure_taxonomy, layer_attribution, failure_histogram, failure_predictors, recommendations, failure_cases, category_extremes, common_leader, metric_table, common_words, model_summary, model_advantage, argmax_by_group, bootstrap_ci, bootstrap_difference, incremental_anti_join, status_summary, key_report, alias_join, event_windows, store_metadata)
QUERIES = {f.__name__: f for f in _ALL}


def _rouge(n: int) -> str:
    grams = lambda c: sql_overlap(c) if n == 1 else f"list_transform(range(1, len({sql_overlap(c)})), lambda i: {sql_overlap(c)}[i] || ' ' || {sql_overlap(c)}[i + 1])"
    return f"""g{n} AS (SELECT id, g, sum(h) AS h, sum(r) AS r FROM (SELECT id, unnest({grams('hyp')}) AS g, 1 AS h, 0 AS r FROM ex UNION ALL SELECT id, unnest({grams('ref')}), 0, 1 FROM ex) GROUP BY ALL),
t{n} AS (SELECT ex.id, coalesce(sum(least(h, r)), 0) AS b, coalesce(sum(h), 0) AS h, coalesce(sum(r), 0) AS r FROM ex LEFT JOIN g{n} ON ex.id = g{n}.id GROUP BY ALL),
u{n} AS (SELECT id, CASE WHEN h = 0 THEN 0.0 ELSE b / h END AS p, CASE WHEN r = 0 THEN 0.0 ELSE b / r END AS r FROM t{n}),
rouge{n} AS (SELECT id, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6)::DOUBLE AS f FROM u{n})"""


_ANSWERS = f"""WITH {SQL_EXCHANGES}, {_rouge(1)}, a AS (SELECT id, p AS precision, rouge1.r AS recall, f AS rouge1, rouge1.r > 0.1 AS hit, round(1 - p, 6) AS hallucination, round(least(rouge1.r * 2, 1.0), 6) AS grounding,
  p AS faithfulness, length(hyp) < 60 AS insufficient, conv_id % 3 AS category, length(hyp) AS answer_length, length(ref) AS question_length, turn, regexp_matches(ref, '[0-9]') AS numbers FROM rouge1 JOIN ex USING (id))"""
_TAXONOMY = _ANSWERS + """, b1 AS (SELECT *, NOT hit AND rouge1 < 0.2 AS t1, precision > 0.01 OR recall > 0.01 AS valid FROM a),
b2 AS (SELECT *, valid AND precision < 0.35 AND NOT t1 AS t2, valid AND recall < 0.2 AND NOT t1 AS t3, (hallucination > 0.35 OR (faithfulness > 0.01 AND faithfulness < 0.45)) AND NOT t1 AS t4 FROM b1),
b3 AS (SELECT *, rouge1 < 0.15 AND grounding > 0.4 AND hallucination < 0.3 AND NOT t4 AND NOT t1 AS t5 FROM b2),
b4 AS (SELECT *, grounding > 0.55 AND rouge1 < 0.2 AND hallucination < 0.25 AND (faithfulness <= 0.01 OR faithfulness > 0.55) AND NOT t4 AND NOT t5 AND NOT t1 AS t6 FROM b3),
b5 AS (SELECT *, list_filter([CASE WHEN t1 THEN 'FM1_RETRIEVAL_MISS' END, CASE WHEN t3 THEN 'FM3_CONTEXT_RECALL' END, CASE WHEN t2 THEN 'FM2_CONTEXT_PRECISION' END, CASE WHEN t4 THEN 'FM4_HALLUCINATION' END, CASE WHEN t5 THEN 'FM5_OVER_CONSTRAINED' END, CASE WHEN t6 THEN 'FM6_METRIC_MISMATCH' END], lambda m: m IS NOT NULL) AS fired FROM b4),
t AS (SELECT *, CASE WHEN insufficient THEN ['FM7_CORPUS_GAP'] WHEN len(fired) > 0 THEN fired WHEN rouge1 > 0.25 AND hallucination < 0.3 THEN ['NONE'] WHEN hallucination > 0.2 AND rouge1 < 0.25 THEN ['FM4_HALLUCINATION'] WHEN rouge1 < 0.2 THEN ['FM5_OVER_CONSTRAINED'] ELSE ['FM6_METRIC_MISMATCH'] END AS modes FROM b5),
tt AS (SELECT *, modes[1] AS primary_mode FROM t)"""
_LAYER = "CASE " + " ".join(f"WHEN primary_mode = '{k}' THEN '{v}'" for k, v in evaluation.LAYERS.items()) + " ELSE 'other' END"
_INTERVAL = "quantile_cont(mean, 0.025) AS l, quantile_cont(mean, 0.975) AS u"
_BOOT = f"""WITH o AS (SELECT CASE WHEN toxic = 1 THEN 'toxic' ELSE 'plain' END AS grp, quality FROM labels),
h AS (SELECT grp, count(*) AS n, count(*) FILTER (quality = 0) AS zeros, avg(quality) AS seen FROM o GROUP BY grp),
d AS (SELECT grp, range AS resample, n AS m, zeros / n AS p FROM h, range(10000)), {resampling.sql_binomial('z', 'd', "'0'")},
q AS (SELECT grp, {_INTERVAL} FROM (SELECT z.grp, (n - k) / n AS mean FROM z JOIN h USING (grp)) GROUP BY grp)
SELECT grp AS "group", n, round(seen, 6) AS estimate, round(l, 6) AS lower, round(u, 6) AS upper FROM h JOIN q USING (grp)"""
# three values, -1, 0 and 1: the first by its share of all, the second by its share of what is left
_PAIRED = f"""WITH h AS (SELECT 'quality-toxic' AS grp, count(*) AS n, count(*) FILTER (quality < toxic) AS less, count(*) FILTER (quality = toxic) AS same, avg(quality - toxic) AS seen FROM labels),
d AS (SELECT grp, range AS resample, n AS m, less / n AS p FROM h, range(10000)), {resampling.sql_binomial('a', 'd', "'0'")},
e AS (SELECT grp, resample, n - k AS m, same / (n - less) AS p FROM a JOIN h USING (grp)), {resampling.sql_binomial('b', 'e', "CASE WHEN (SELECT less FROM h) > 0 THEN '1' ELSE '0' END")},
mean AS (SELECT grp, (n - a.k - b.k - a.k) / n AS mean FROM a JOIN b USING (grp, resample) JOIN h USING (grp)),
q AS (SELECT grp, {_INTERVAL}, avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END) AS below, avg(CASE WHEN mean >= 0 THEN 1.0 ELSE 0.0 END) AS above FROM mean GROUP BY grp)
SELECT grp AS "group", n, round(seen, 6) AS estimate, round(l, 6) AS lower, round(u, 6) AS upper, round(least(1.0, 2 * CASE WHEN seen >= 0 THEN below ELSE above END), 6)::DOUBLE AS p_value,
  CASE WHEN l > 0 THEN 'first higher' WHEN u < 0 THEN 'second higher' ELSE 'not significant' END AS verdict FROM h JOIN q USING (grp)"""
_PROPS = {"factual": "category = 0", "comparative": "category = 1", "gap_detection": "category = 2", "insufficient": "insufficient", "long_question": "question_length > 250", "long_answer": "answer_length > 600", "numbers": "numbers", "later_turn": "turn > 2"}

ORACLE_SQL = {
    "severity_labels": f"WITH {SQL_CELLS} SELECT entity, dimension, score::DOUBLE AS score, {sql_label('score')} AS label FROM cells",
    "gap_matrix": f"WITH {SQL_CELLS} SELECT entity, " + ", ".join(f"max(score) FILTER (dimension = '{x}')::DOUBLE AS dim_{x[0]}" for x in DIMENSIONS) + " FROM cells GROUP BY entity",
    "precedence_merge": f"""WITH {SQL_CELLS}, grid AS (SELECT n_name AS entity, unnest({DIMENSIONS}) AS dimension FROM nation),
      x AS (SELECT g.entity, g.dimension, c.score, c.commitments, c.n_regionkey, CASE c.commitments % 4 WHEN 0 THEN 'VAGUE' WHEN 1 THEN 'QUANTIFIED' WHEN 2 THEN 'ABSENT' WHEN 3 THEN 'QUALIFIED' END AS level FROM grid g LEFT JOIN cells c USING (entity, dimension)),
      y AS (SELECT entity, dimension, CASE WHEN n_regionkey = 2 THEN score / 2 WHEN commitments >= 100 AND score >= 0.48 THEN score WHEN commitments >= 100 THEN CASE level WHEN 'ABSENT' THEN 0.85 WHEN 'VAGUE' THEN 0.65 WHEN 'QUALIFIED' THEN 0.6 ELSE 0.55 END WHEN score < 0.5 THEN score END::DOUBLE AS score,
        CASE WHEN n_regionkey = 2 THEN 'override' WHEN commitments >= 100 AND score >= 0.48 THEN 'single' WHEN commitments >= 100 THEN 'heuristic' WHEN score < 0.5 THEN 'original' ELSE 'missing' END AS source FROM x)
      SELECT entity, dimension, score, {sql_label('score', 'MISSING')} AS label, source FROM y""",
    "pairwise_leader": f"WITH {SQL_CELLS} SELECT a.dimension, a.entity AS entity_a, b.entity AS entity_b, round(abs(a.score - b.score), 6)::DOUBLE AS relative_gap, CASE WHEN a.score < b.score THEN a.entity ELSE b.entity END AS leader FROM cells a JOIN cells b ON a.dimension = b.dimension AND a.position < b.position",
    "entity_ranking": f"WITH {SQL_CELLS} SELECT entity, round(avg(score), 5)::DOUBLE AS mean_score, count(*) AS cells, {sql_label('avg(score)')} AS label FROM cells GROUP BY entity",
    "worst_findings": "SELECT l_orderkey, max(l_discount) FILTER (l_discount > 0) AS score, arg_min(l_returnflag, struct_pack(a := l_linenumber, b := l_returnflag)) AS severity_first, max(struct_pack(s := l_discount, v := l_returnflag)) FILTER (l_discount > 0).v AS severity_of_max FROM lineitem GROUP BY l_orderkey",
    "normalised_values": r"""SELECT event_id, CASE event_id % 3 WHEN 1 THEN user_id::VARCHAR WHEN 2 THEN 'n/a' END AS value, CASE event_id % 3 WHEN 1 THEN user_id::DOUBLE ELSE -1.0 END AS number,
      CASE WHEN event_id % 2 = 0 THEN regexp_replace(lower(event_type || ' -Target'), '[^\p{L}\p{N}]+', '_', 'g') ELSE 'vague_target' END AS kind FROM events""",
    "rouge_1_2": f"WITH {SQL_EXCHANGES}, {_rouge(1)}, {_rouge(2)} SELECT id, rouge1.p AS p1, rouge1.r AS r1, rouge1.f AS f1, rouge2.p AS p2, rouge2.r AS r2, rouge2.f AS f2 FROM rouge1 JOIN rouge2 USING (id)",
    "failure_flags": _ANSWERS + """, f AS (SELECT id, list_filter([CASE WHEN NOT hit THEN 'RETRIEVAL_MISS' END, CASE WHEN precision < 0.3 THEN 'LOW_CONTEXT_PRECISION' END, CASE WHEN recall < 0.3 THEN 'LOW_CONTEXT_RECALL' END, CASE WHEN faithfulness < 0.5 THEN 'LOW_FAITHFULNESS' END,
      CASE WHEN hallucination > 0.3 THEN 'HIGH_HALLUCINATION' END, CASE WHEN rouge1 < 0.2 THEN 'LOW_LEXICAL_OVERLAP' END], lambda x: x IS NOT NULL) AS f FROM a) SELECT id, CASE WHEN len(f) = 0 THEN 'NO_FAILURE' ELSE list_aggregate(f, 'string_agg', '|') END AS flags FROM f""",
    "failure_taxonomy": f"{_TAXONOMY} SELECT id, list_aggregate(modes, 'string_agg', '|') AS modes, primary_mode, {_LAYER} AS layer FROM tt",
    "layer_attribution": f"{_TAXONOMY} SELECT {_LAYER} AS layer, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM tt), 4)::DOUBLE AS pct FROM tt GROUP BY 1",
    "failure_histogram": f"{_TAXONOMY}, e AS (SELECT id, rouge1, unnest(modes) AS mode FROM tt), r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY rouge1, id) AS place FROM e) SELECT mode, count(*) AS n, round(avg(rouge1), 5) AS mean_rouge1, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (place <= 3) AS exemplars, round(count(*) * 100.0 / (SELECT count(*) FROM e), 4)::DOUBLE AS pct FROM r GROUP BY mode",
    "failure_predictors": f"{_TAXONOMY}, x AS (SELECT CASE WHEN primary_mode IN ('NONE', 'FM6_METRIC_MISMATCH', 'FM7_CORPUS_GAP') THEN 0.0 ELSE 1.0 END AS fail, unnest(['baseline', " + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in _PROPS.items()) + "]) AS property FROM tt), y AS (SELECT property, count(*) AS n, avg(fail)::DOUBLE AS rate FROM x WHERE property IS NOT NULL GROUP BY 1), z AS (SELECT *, rate - (SELECT rate FROM y WHERE property = 'baseline') AS delta FROM y) SELECT property, n, round(rate, 5) AS failure_rate, round(delta, 5) AS delta, CASE WHEN delta > 0.05 THEN 'higher failure rate' WHEN delta < -0.05 THEN 'lower failure rate' ELSE 'similar to baseline' END AS note FROM z",
    "recommendations": f"""{_TAXONOMY}, y AS (SELECT avg(fail) FILTER (turn > 2) - avg(fail) AS delta FROM (SELECT turn, CASE WHEN primary_mode IN ('NONE', 'FM6_METRIC_MISMATCH', 'FM7_CORPUS_GAP') THEN 0.0 ELSE 1.0 END AS fail FROM tt)),
      f AS (SELECT 'count' AS kind, mode AS name, count(*)::DOUBLE AS value FROM (SELECT unnest(modes) AS mode FROM tt) GROUP BY mode UNION ALL SELECT 'pct', layer, count(*) * 100.0 / (SELECT count(*) FROM tt) FROM (SELECT {_LAYER} AS layer FROM tt) GROUP BY 2 UNION ALL SELECT 'delta', 'hard', delta FROM y),
      r(target, kind, name, above, priority, advice, place) AS (VALUES """ + ", ".join(str((*r, 100 * evaluation.PRIORITIES.index(r[4]) + i)) for i, r in enumerate(evaluation.RULES)) + """)
      SELECT target, priority, advice, round(value, 4)::DOUBLE AS value, place::BIGINT AS place FROM f JOIN r USING (kind, name) WHERE value > above""",
    "failure_cases": f"{_TAXONOMY}, e AS (SELECT tt.*, substr(ref, 1, 300) AS question, substr(hyp, 1, 300) AS answer, unnest(modes) AS mode FROM tt JOIN ex USING (id) WHERE answer_length > 20), r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY rouge1, id) AS place, count(*) OVER (PARTITION BY mode) AS n FROM e) SELECT mode, n, place, id, rouge1, category, hallucination, question, answer FROM r WHERE place <= 3",
    "category_extremes": _ANSWERS + " SELECT category, round(avg(rouge1), 5) AS mean, round(avg(rouge1), 5) = max(round(avg(rouge1), 5)) OVER () AS best, round(avg(rouge1), 5) = min(round(avg(rouge1), 5)) OVER () AS worst FROM a GROUP BY category",
    "common_leader": f"""WITH {SQL_CELLS}, c AS (SELECT * FROM cells WHERE commitments % 4 > 0), m AS (SELECT a.entity AS entity_a, b.entity AS entity_b, string_agg(a.dimension, ',' ORDER BY a.dimension) AS common, round(sum(a.score), 6)::DOUBLE AS total_a, round(sum(b.score), 6)::DOUBLE AS total_b
        FROM c a JOIN c b ON a.dimension = b.dimension AND a.position < b.position GROUP BY 1, 2) SELECT *, CASE WHEN total_a < total_b THEN entity_a WHEN total_b < total_a THEN entity_b END AS leader FROM m""",
    "metric_table": """WITH t AS (SELECT l_returnflag AS model, count(*)::DOUBLE AS n, round(avg(l_discount), 6) AS hallucination_rate, round(sum(l_tax) * 100 / sum(l_tax + l_discount), 4) AS unsupported_pct, round(sum(l_quantity * 100 * 0.000005), 2) AS cost FROM lineitem GROUP BY 1),
      u AS (SELECT unnest(['n', 'hallucination_rate', 'unsupported_pct', 'cost']) AS metric, model AS variant, unnest([n, hallucination_rate, unsupported_pct, cost]) AS value FROM t)
      SELECT metric, variant, value, value = CASE WHEN metric = 'n' THEN max(value) OVER (PARTITION BY metric) ELSE min(value) OVER (PARTITION BY metric) END AS best FROM u""",
    "common_words": f"WITH n AS (SELECT role, word, count(*) AS n FROM (SELECT role, unnest({sql_overlap('text')}) AS word FROM conversations) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, word) AS place FROM n) WHERE place <= 10",
    "rouge_l": f"""WITH {SQL_EXCHANGES}, w AS (SELECT id, {sql_overlap('hyp')} AS x, {sql_overlap('ref')} AS y FROM ex),
      l AS (SELECT id, len(x) AS h, len(y) AS r, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE list_reduce(list_transform(y, lambda t: {{'row': []::BIGINT[], 't': t}}),
        lambda a, e: {{'row': list_transform([list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] = e.t THEN CASE WHEN i = 1 THEN 0 ELSE a.row[i - 1] END + 1 ELSE a.row[i] END)], lambda t: list_transform(range(1, len(x) + 1), lambda j: list_max(list_slice(t, 1, j))))[1], 't': ''}},
        {{'row': list_transform(x, lambda t: 0::BIGINT), 't': ''}}).row[-1] END AS n FROM w),
      p AS (SELECT id, CASE WHEN h = 0 THEN 0.0 ELSE n / h END AS p, CASE WHEN r = 0 THEN 0.0 ELSE n / r END AS r FROM l)
      SELECT id, round(p, 6)::DOUBLE AS p, round(r, 6)::DOUBLE AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6)::DOUBLE AS f FROM p""",
    "model_summary": "SELECT l_returnflag AS model, count(*) AS n, round(avg(l_discount), 6) AS hallucination_rate, round(sum(l_tax) * 100 / sum(l_tax + l_discount), 4) AS unsupported_pct, round(sum(l_quantity * 100 * 0.000005), 2) AS cost, round(coalesce(avg(l_extendedprice), 0.0), 3) AS latency FROM lineitem GROUP BY 1",
    "model_advantage": _ANSWERS + " SELECT category, count(*) FILTER (precision - recall > 0.15) AS gains, count(*) FILTER (precision - recall < -0.05) AS losses, count(*) FILTER (greatest(precision, recall) < 0.15) AS both_low, count(*) AS n FROM a WHERE precision > 0 AND recall > 0 GROUP BY category",
    "argmax_by_group": "WITH t AS (SELECT event_type, user_id, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT event_type, user_id, total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) AS rn FROM t) WHERE rn = 1",
    "bootstrap_ci": _BOOT,
    "bootstrap_difference": _PAIRED,
    "incremental_anti_join": "SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "status_summary": "SELECT event_type, count(*) AS n, round(sum(coalesce(value, 0)), 2) AS total FROM events GROUP BY 1",
    "key_report": "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(*) - count(DISTINCT doc_id) AS repeats, count(DISTINCT source) AS sources FROM documents",
    "alias_join": "WITH a(lang, entity) AS (VALUES ('fr', 'FRANCE'), ('fr', 'CANADA'), ('de', 'GERMANY'), ('en', 'UNITED KINGDOM'), ('en', 'UNITED STATES'), ('en', 'CANADA'), ('es', 'ARGENTINA')) SELECT entity, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN a USING (lang) GROUP BY entity",
    "event_windows": "SELECT (floor(epoch(ts) / 3600) * 3600)::BIGINT AS start_s, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "store_metadata": "SELECT doc_id AS key, coalesce(lang, '') AS lang, CASE WHEN n_chars > 1000 THEN n_chars ELSE 0 END AS size, least(length(substr(text, 1, 700)), 500)::BIGINT AS snippet_chars FROM documents",
}
