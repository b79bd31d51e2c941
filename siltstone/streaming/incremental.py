"""Incremental ingestion: new files are cleaned, gated and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.functions.text import clean_page, is_garbled
from siltstone.sources.upsert import upsert


def ingest(spark: SparkSession, source: str, target: str, state: str, schema, key: str = "doc_id", name: str = "ingest") -> StreamingQuery:
    """Starts a run over the files that came since the last one, and stops by itself.

    The checkpoint in ``state`` remembers the files; a batch is committed under its number, and keys that the
    target has are left out, so a batch that runs again after a failure adds nothing twice.  Read the
    target with ``upsert.read``.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("text", clean_page(F.coalesce("text", F.lit("")))).withColumn("garbled", is_garbled(F.col("text")))
        upsert(rows, target, key, f"{name}-{number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events a window and type, batch or stream; late rows beyond the watermark are dropped by the engine."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
