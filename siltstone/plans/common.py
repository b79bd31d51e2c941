"""Fixture views and SQL fragments that the registered queries share."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import ARROWS, STOP_WORDS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; also lets Python workers find this package where the driver found it."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(spark: SparkSession) -> str:
    """A folder that all executors see, for what queries keep: the checkpoint folder; a temporary one only in a local session without it."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not hasattr(store, "place"):
            store.place = tempfile.mkdtemp(prefix="siltstone-")
        place = store.place
    return f"{place.rstrip('/')}/siltstone-store"


def exchanges(spark: SparkSession, d: str) -> DataFrame:
    """A user's turn and the assistant's next: id, conv_id, turn, ref, hyp."""
    c = table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", F.col("turn").alias("t"), F.col("text").alias("ref"))
    bot = c.where("role = 'assistant'").select("conv_id", "turn", (F.col("turn") - 1).alias("t"), F.col("text").alias("hyp"))
    return bot.join(user, ["conv_id", "t"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "ref", "hyp")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Scores of a nation (entity) and order priority (dimension): the share of finished orders."""
    n = F.broadcast(table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity"), F.col("n_nationkey").alias("position"), "n_regionkey"))
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("dimension"), (F.col("o_orderstatus") == "F").cast("double").alias("f"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    met = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return met.groupBy("entity", "position", "n_regionkey", "dimension").agg(F.round(F.avg("f"), 6).alias("score"), F.count("*").alias("commitments"))


DIMENSIONS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

WS = r"[\x09-\x0D\x20]"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"


def sql_tokenise(x: str) -> str:
    bare = rf"list_transform({sql_split(x)}, lambda w: lower(regexp_replace(w, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')))"
    return f"list_filter({bare}, lambda w: length(w) > 1 AND NOT list_contains([{STOPS}], w))"


def sql_overlap(x: str) -> str:
    return sql_split(rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]', ' ', 'g')")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_garbled(x: str) -> str:
    t = sql_split(x)
    arrows = lambda s: f"(length({s}) - length(translate({s}, '{ARROWS}', '')))"
    letters = lambda s: rf"length(regexp_replace({s}, '[^\p{{L}}]', '', 'g'))"
    w = f"substr({x}, 1, 150)"
    top = f"list_max(map_values(list_aggregate({t}, 'histogram')))"
    return rf"""CASE WHEN {x} IS NULL OR length({sql_strip(x)}) < 20 THEN TRUE WHEN {arrows(w)} >= 2 THEN TRUE
      WHEN length({w}) > 30 AND {letters(w)} / length({w}) < 0.25 THEN TRUE WHEN {arrows(x)} >= 4 THEN TRUE
      WHEN {letters(x)} / length({x}) < 0.35 THEN TRUE
      WHEN len({t}) = 0 OR len(list_filter({t}, lambda w: regexp_matches(translate(w, '.%-', ''), '^\p{{Nd}}+$'))) / len({t}) > 0.55 THEN TRUE
      WHEN len({t}) >= 6 AND {top} / len({t}) > 0.20 AND {top} >= 5 THEN TRUE
      WHEN len({t}) > 10 AND len(list_filter({t}, lambda w: length(w) > 3 AND regexp_matches(w, '^\p{{L}}+$'))) < 8 THEN TRUE ELSE FALSE END"""


SQL_CELLS = """cells AS (SELECT n_name AS entity, n_nationkey AS position, n_regionkey, o_orderpriority AS dimension,
    round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS score, count(*) AS commitments
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
SQL_EXCHANGES = """ex AS (SELECT b.conv_id * 1000 + b.turn AS id, b.conv_id, b.turn, u.text AS ref, b.text AS hyp
  FROM conversations b JOIN conversations u ON u.conv_id = b.conv_id AND u.turn = b.turn - 1 WHERE b.role = 'assistant' AND u.role = 'user')"""


def sql_label(x: str, missing: str = "ABSENT") -> str:
    return f"CASE WHEN {x} IS NULL THEN '{missing}' WHEN {x} >= 0.8 THEN 'CRITICAL' WHEN {x} >= 0.5 THEN 'SIGNIFICANT' WHEN {x} >= 0.2 THEN 'PARTIAL' ELSE 'ALIGNED' END"


def sql_bm25(queries: str, k1: str = "1.6") -> str:
    """CTEs up to ``sc`` (query_id, doc_id, score) for a query table (query_id, text) named by ``queries``."""
    return f"""d AS (SELECT doc_id, {sql_tokenise("coalesce(text, '')")} AS t FROM documents),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, avg(len(t)) AS avgdl FROM d),
raw AS (SELECT term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
idf AS (SELECT term, CASE WHEN w < 0 THEN 0.25 * (SELECT avg(w) FROM raw) ELSE w END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql_tokenise('text')}) AS term FROM {queries}) GROUP BY ALL),
sc AS (SELECT query_id, doc_id, round(sum(times * idf * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term), s GROUP BY ALL)"""


def sql_sparse(n: int) -> str:
    """CTE ``sparse``: top n with zero scores, for queries ``q``."""
    return f"""sparse AS (SELECT * FROM (SELECT q.query_id, a.doc_id, coalesce(sc.score, 0.0) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY coalesce(sc.score, 0.0) DESC, a.doc_id) AS rank
  FROM q CROSS JOIN documents a LEFT JOIN sc ON sc.query_id = q.query_id AND sc.doc_id = a.doc_id) WHERE rank <= {n})"""
