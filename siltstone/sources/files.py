"""Sources and sinks: JSON lines, CSV with a byte-order mark, binary documents, reports, upserts."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file; malformed lines fail (``strict``) or are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    both = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.schema(both).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def malformed_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """The lines that are no JSON objects, for a warning."""
    return spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())


def read_json_array(spark: SparkSession, *paths: str, schema: T.StructType | None = None) -> DataFrame:
    """The first of ``paths`` that exists."""
    found = [p for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {paths}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(found[0])


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON file's rows, or none of the same schema."""
    return read_json_array(spark, path, schema=schema) if exists(spark, path) else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A headed CSV with quoted line breaks; a byte-order mark before the first name goes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, stem, kind, content, valid, md5, size) of binary documents below a folder.

    ``valid`` tells a PDF by its first bytes; ``kind`` comes from the path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    stem = F.regexp_extract("path", r"([^/]+?)\.[^./]*$", 1)
    kind = F.when(F.lower("path").contains("/ndc"), "ndc").when(F.lower("path").contains("/ipcc"), "ipcc").otherwise("other")
    return files.select("path", stem.alias("stem"), kind.alias("kind"), "content", is_pdf(F.col("content")).alias("valid"), F.md5("content").alias("md5"), F.col("length").alias("size"))


def is_pdf(content: Column) -> Column:
    return F.coalesce(F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit(False))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Cell reports, one JSON object a file, keyed by name ``DIMENSION__ENTITY``; one scan for all cells."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return df.withColumn("report_dimension", F.split(name, "__")[0]).withColumn("report_entity", F.replace(F.split(name, "__")[1], F.lit("_"), F.lit(" ")))


# Answers after which a download is tried again, how often, and the first wait in seconds, which doubles.
RETRY_ON, ATTEMPTS, FIRST_WAIT = (429, 500, 502, 503, 504), 4, 1.5


class Refused(Exception):
    """A server's answer other than success; ``after``: the seconds it asks to wait."""

    def __init__(self, status: int, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


def retrying(fetch, attempts: int = ATTEMPTS, retry_on: tuple[int, ...] = RETRY_ON, first_wait: float = FIRST_WAIT, wait=time.sleep):
    """``fetch`` that waits and tries again after refusals that may pass (and broken connections), longer each time or as long as the server asks."""

    def run(url: str) -> bytes:
        for i in range(attempts):
            try:
                return fetch(url)
            except (Refused, ConnectionError, TimeoutError) as e:
                if i == attempts - 1 or (isinstance(e, Refused) and e.status not in retry_on):
                    raise
                wait(getattr(e, "after", None) or first_wait * 2**i)
        raise AssertionError("no attempts")

    return run


def download(manifest: DataFrame, fetch, partitions: int = 4) -> DataFrame:
    """(label, url, status, size, md5, error): the first of each row's ``urls`` whose bytes are a PDF.

    ``fetch`` takes a url and returns bytes; what it raises becomes the status.  ``partitions``
    bounds the connections.
    """
    import hashlib

    import pandas as pd

    def one(label: str, urls) -> tuple:
        error = None
        for url in urls if urls is not None else []:
            try:
                data = fetch(url)
            except Exception as e:  # noqa: BLE001 - recorded, the next url is tried
                error = f"{type(e).__name__}: {e}"
                continue
            if data[:5] == b"%PDF-":
                return label, url, "ok", len(data), hashlib.md5(data).hexdigest(), None
            error = "not a PDF"
        return label, None, "failed", None, None, error

    def run(batches):
        for b in batches:
            yield pd.DataFrame([one(x, u) for x, u in zip(b["label"], b["urls"], strict=True)], columns=["label", "url", "status", "size", "md5", "error"]).astype({"size": "Int64"})

    return manifest.select("label", "urls").coalesce(partitions).mapInPandas(run, "label string, url string, status string, size bigint, md5 string, error string")


def missing_from(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return rows.join(existing.select(key), key, "left_anti")


def sanitise(df: DataFrame, strings: list[str], drop: tuple[str, ...] = ("text", "chunk_id", "doc_id"), most: int = 500) -> DataFrame:
    """Metadata as a store without nulls wants it: empty text, 0, long text cut, nested values as JSON."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name in drop:
            continue
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            out.append(F.substring(F.to_json(c), 1, most).alias(f.name))
        elif f.name in strings or isinstance(f.dataType, T.StringType):
            out.append(F.substring(F.coalesce(c, F.lit("")), 1, most).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.coalesce(c, F.lit(False)).alias(f.name))
        else:
            out.append(F.coalesce(c, F.lit(0)).alias(f.name))
    return df.select(*out)
