"""What goes out: JSON lines, samples, tables for spreadsheets, response records, evaluation bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls kept, in as many files as there are tasks."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_sample(df: DataFrame, path: str, n: int, *order: Column) -> None:
    """The first ``n`` rows by ``order`` as one file of JSON lines."""
    write_jsonl(df.orderBy(*order).limit(n).coalesce(1), path, "overwrite")


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV files that spreadsheets read as UTF-8: each begins with a byte-order mark; line breaks and quotes are quoted."""
    first, *rest = df.columns
    df.toDF(BOM + first, *rest).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def newest(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, modified, size) of the files below a folder, newest first, ties by name; their contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size")).orderBy(F.desc("modified"), "file")


def response_record(chunks: str = "retrieved_chunks", preview: int = 300) -> Column:
    """A response row as one JSON object: its answer, citations, flags and figures, and its chunks with their texts cut."""
    cut = F.transform(F.col(chunks), lambda c: c.withField("text", F.substring(c["text"], 1, preview)))
    fields = ["query", "answer", "citations", "insufficient", "query_type", "model_used", "latency_sec"]
    return F.to_json(F.struct(*fields, F.size("citations").alias("n_citations"), cut.alias(chunks)), {"ignoreNullFields": "false"})


def write_bundle(path: str, summary: DataFrame, per_query: DataFrame, variant: str = "variant") -> None:
    """An evaluation as JSON lines: means, and the rows they come from in a folder a variant."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    per_query.write.mode("overwrite").partitionBy(variant).json(f"{path}/per_query")


def read_bundle(spark: SparkSession, path: str, summary: str, per_query: str) -> tuple[DataFrame, DataFrame]:
    """What ``write_bundle`` wrote, by schemas."""
    return spark.read.schema(summary).json(f"{path}/summary"), spark.read.schema(per_query).json(f"{path}/per_query")
