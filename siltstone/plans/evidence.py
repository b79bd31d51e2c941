"""Evidence queries: values of several shapes, sources merged by precedence, claim lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.scores import severity_label
from siltstone.operators import evidence, gap
from siltstone.session import spread
from siltstone.sources import reports

from .common import DIMENSIONS, SQL_CELLS, cells, sql_label, sql_strip, table


def shaped_results(spark: SparkSession, d: str) -> DataFrame:
    """Event properties in the shapes of result files: a list, an object of lists, neither, no JSON; read back by one path."""
    e = spread(table(spark, d, "events").select("event_id", "event_type", "props"))
    item = lambda k: F.concat(F.lit('{"'), F.lit(k), F.lit('": "q'), F.col("event_id"), F.lit('", "props": '), "props", F.lit("}"))
    shape = F.col("event_id") % 4
    plain = F.concat(F.lit('{"per_query": ['), item("qid"), F.lit(', {"props": 1}, '), item("id"), F.lit("]}"))
    named = F.concat(F.lit('{"per_query": {"'), "event_type", F.lit('": ['), item("id"), F.lit('], "other": ['), item("qid"), F.lit('], "note": 7}}'))
    raw = F.when(shape == 0, plain).when(shape == 1, named).when(shape == 2, F.concat(F.lit('{"results": ['), item("qid"), F.lit("]}"))).otherwise(F.concat(F.lit("[broken "), item("id")))
    read = reports.keyed_items(e.select("event_id", F.try_parse_json(raw).alias("value")))
    return read.select("event_id", "name", "key", reports.at(F.col("item"), "$.props.k", "bigint").alias("k"))


def claim_lists(spark: SparkSession, d: str) -> DataFrame:
    """Claims of replies: fenced lists, plain lists, and replies that are none, where the answer's sentences stand in."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    listed = F.to_json(F.array(F.substring("text", 1, 30), F.lit("two"), F.col("turn").cast("string")))
    reply = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(F.col("turn") % 3 == 1, listed).otherwise(F.lit("I cannot list them."))
    return c.select("conv_id", "turn", F.posexplode(T.claim_list(reply, F.col("text"))).alias("i", "claim")).select("conv_id", "turn", F.col("i").cast("bigint").alias("i"), "claim")


def evidence_join(spark: SparkSession, d: str) -> DataFrame:
    """Documents as questions; labels as the table of metrics that goes before the one of pages; vectors as retrieval, events as models."""
    golden = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("lang").alias("category"), F.col("n_chars").alias("length"))
    csv = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("faithfulness"), (F.col("toxic") / 2).alias("rouge1"))
    js = table(spark, d, "pages").select(F.col("page_id").alias("qid"), (F.length("url") % 10 / 10).alias("faithfulness"), (F.length("url") % 7 / 10).alias("rouge1"), (F.length("url") % 5 / 5).alias("precision"))
    found = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.when(F.col("label") > 2, F.col("label") / 9).alias("hit_rate"))
    models = evidence.spread_models(table(spark, d, "events"), "user_id", "event_type", "value", {"click": "click_score", "view": "view_score"}).withColumnRenamed("user_id", "qid")
    met = evidence.merge(golden, [("csv", csv), ("json", js), ("retrieval", found), ("models", models)], "qid")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return met.select(
        "qid", "category", "length", zero("faithfulness"), zero("rouge1"), evidence.retrieval_hit(F.col("hit_rate"), F.col("precision")).alias("hit"), zero("click_score"), zero("view_score"),
        "from_csv", "from_json", "from_retrieval", "from_models",
    )


def summary_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The label of every cell of a summary: single report, else original report, else MISSING."""
    c = cells(spark, d)
    nations = table(spark, d, "nation").select(F.col("n_name").alias("entity"))
    grid = gap.grid(nations, spark.createDataFrame([(x,) for x in DIMENSIONS], "dimension string"))
    single = c.where("commitments % 3 = 0").select("entity", "dimension", "score", F.when(F.col("commitments") % 2 == 0, F.lit("OWN")).alias("label"))
    original = c.where("score < 0.5").select("entity", "dimension", (F.col("score") / 2).alias("score"))
    met = evidence.merge(grid.select("entity", "dimension"), [("single", single), ("original", original)], ["entity", "dimension"], whole=True)
    label = evidence.settle_label(F.col("label"), F.col("score"), F.col("from_single"), F.col("from_original"), severity_label)
    return met.select("entity", "dimension", "score", label.alias("label"))


_ALL = (shaped_results, claim_lists, evidence_join, summary_precedence)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    # what each shape holds, told without reading it back
    "shaped_results": """SELECT event_id, name, 'q' || event_id AS key, CAST(props->>'$.k' AS BIGINT) AS k FROM (
      SELECT event_id, props, NULL::VARCHAR AS name FROM events, range(2) WHERE event_id % 4 = 0
      UNION ALL SELECT event_id, props, unnest([event_type, 'other']) FROM events WHERE event_id % 4 = 1)""",
    "claim_lists": f"""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN [substr(text, 1, 30), 'two', turn::VARCHAR]
        ELSE list_slice(list_filter(list_transform(regexp_split_to_array(text, '[.!?]'), lambda p: {sql_strip('p')}), lambda p: length(p) > 20), 1, 8) END AS c FROM conversations WHERE role = 'assistant')
      SELECT conv_id, turn, generate_subscripts(c, 1) - 1 AS i, unnest(c) AS claim FROM r""",
    "evidence_join": """WITH m AS (SELECT user_id, max(value) FILTER (event_type = 'click') AS click_score, max(value) FILTER (event_type = 'view') AS view_score FROM events GROUP BY 1),
      x AS (SELECT d.doc_id AS qid, d.lang AS category, d.n_chars AS length, l.doc_id IS NOT NULL AS from_csv, p.page_id IS NOT NULL AS from_json, e.vec_id IS NOT NULL AS from_retrieval, m.user_id IS NOT NULL AS from_models,
        coalesce(CASE WHEN l.toxic = 0 THEN l.quality::DOUBLE END, length(p.url) % 10 / 10, 0.0) AS faithfulness, coalesce(l.toxic / 2, length(p.url) % 7 / 10, 0.0) AS rouge1,
        CASE WHEN e.label > 2 THEN e.label / 9 END AS rate, length(p.url) % 5 / 5 AS precision, coalesce(click_score, 0.0) AS click_score, coalesce(view_score, 0.0) AS view_score
      FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN m ON m.user_id = d.doc_id)
      SELECT qid, category, length, faithfulness, rouge1, CASE WHEN rate > 0 THEN rate > 0.5 ELSE coalesce(precision, 0.5) > 0.3 END AS hit, click_score, view_score, from_csv, from_json, from_retrieval, from_models FROM x""",
    "summary_precedence": f"""WITH {SQL_CELLS}, g AS (SELECT n_name AS entity, unnest({DIMENSIONS}) AS dimension FROM nation)
      SELECT g.entity, g.dimension, CASE WHEN c.commitments % 3 = 0 THEN score WHEN score < 0.5 THEN score / 2 END::DOUBLE AS score,
        CASE WHEN c.commitments % 3 = 0 THEN CASE WHEN c.commitments % 2 = 0 THEN 'OWN' ELSE {sql_label('score')} END WHEN score < 0.5 THEN {sql_label('score / 2')} ELSE 'MISSING' END AS label
      FROM g LEFT JOIN cells c USING (entity, dimension)""",
}
