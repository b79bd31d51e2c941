"""Keyed appends to a folder of Parquet files that happen wholly or not at all.

A batch is written to a folder of its own, and becomes visible when its manifest does: a small numbered
file, made without overwriting.  Of writers that run at once one makes a number; the
others look again at what has come, leave out its keys, and try the next number.  A batch is named, so one
that runs again (a stream after a failure) changes nothing.  A folder without a manifest, as a killed writer
leaves it, is never read; ``clean`` removes it.

A manifest is as atomic as the file system's creation without overwriting.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.gap import keep_first

REPORT = "version long, batch string, rows long, inserted long, known long, repeats long, without_key long, folder string, at_ms long"
#: Times that a writer looks again after another one was first.
TRIES = 20


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listed(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """What has been committed, in order, since the last reset."""
    names = [n for n in _listed(spark, f"{path}/_manifests") if n.endswith(".json")]
    if not names:
        return []
    rows = spark.read.text([f"{path}/_manifests/{n}" for n in names], wholetext=True).collect()
    found = sorted((json.loads(r.value) for r in rows), key=lambda m: m["version"])
    last = max((i for i, m in enumerate(found) if m["folder"] is None and m["batch"] is None), default=-1)
    return found[last + 1 :]


def _version(spark: SparkSession, path: str) -> int:
    return max((int(n[:-5]) for n in _listed(spark, f"{path}/_manifests") if n.endswith(".json")), default=-1) + 1


def _commit(spark: SparkSession, path: str, version: int, entry: dict) -> bool:
    """Makes a manifest; False if another writer has made this number."""
    fs, target = _fs(spark, f"{path}/_manifests/{version:012d}.json")
    text = json.dumps(entry | {"version": version, "at_ms": int(time.time() * 1000)})
    try:
        out = fs.create(target, False)
    except Exception as e:  # a Java exception of the file system's own kind
        if fs.exists(target):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The committed rows; none of ``schema`` where nothing is."""
    folders = [f"{path}/{m['folder']}" for m in manifests(spark, path) if m["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert(rows: DataFrame, path: str, key: str, batch: str, *order: Column, between=lambda: None) -> dict:
    """Appends the rows whose keys are new, as one batch; the report of what happened.

    Of rows of one key the first by ``order`` goes in (by all other columns' hash, if none is given).  Rows
    with a null key stay out.  A batch of a name that is there already changes nothing and gives its first
    report.  ``between`` runs after the data and before the manifest.
    """
    spark = rows.sparkSession
    done = [m for m in manifests(spark, path) if m["batch"] == batch]
    if done:
        return done[0]
    order = order or (F.xxhash64(*rows.columns),)
    total, without = rows.agg(F.count("*"), F.count_if(F.col(key).isNull())).first()
    unique = keep_first(rows.where(F.col(key).isNotNull()), [key], *order)
    seen = [m["folder"] for m in manifests(spark, path) if m["folder"]]
    version = _version(spark, path)
    have = [f"{path}/{f}" for f in seen]
    fresh = unique.join(spark.read.schema(rows.schema).parquet(*have).select(key), key, "left_anti").select(*rows.columns) if have else unique
    folder = f"data-{uuid.uuid4().hex}"
    fresh.write.parquet(f"{path}/{folder}")
    distinct = unique.count()
    for _ in range(TRIES):
        written = spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
        inserted = written.count()
        between()
        entry = {"batch": batch, "rows": total, "inserted": inserted, "known": distinct - inserted, "repeats": total - without - distinct, "without_key": without, "folder": folder if inserted else None}
        if _commit(spark, path, version, entry):
            return entry | {"version": version}
        # another writer was first: leave out what it has brought
        now = manifests(spark, path)
        if again := [m for m in now if m["batch"] == batch]:
            return again[0]
        more = [f"{path}/{m['folder']}" for m in now if m["folder"] and m["folder"] not in seen]
        seen, version = [m["folder"] for m in now if m["folder"]], _version(spark, path)
        if more:
            kept = written.join(spark.read.schema(rows.schema).parquet(*more).select(key), key, "left_anti").select(*rows.columns)
            folder = f"data-{uuid.uuid4().hex}"
            kept.write.parquet(f"{path}/{folder}")
    raise RuntimeError(f"{path}: other writers were first {TRIES} times")


def reset(spark: SparkSession, path: str) -> None:
    """From now on nothing counts as committed; ``clean`` then removes the files."""
    while not _commit(spark, path, _version(spark, path), {"batch": None, "rows": 0, "inserted": 0, "known": 0, "repeats": 0, "without_key": 0, "folder": None}):
        pass


def clean(spark: SparkSession, path: str) -> int:
    """Removes data folders that no manifest names; how many.  No writer may be at work."""
    live = {m["folder"] for m in manifests(spark, path)}
    gone = [n for n in _listed(spark, path) if n.startswith("data-") and n not in live]
    for n in gone:
        fs, p = _fs(spark, f"{path}/{n}")
        fs.delete(p, True)
    return len(gone)


def ingest_report(spark: SparkSession, path: str) -> DataFrame:
    """One row a committed batch: rows that came, went in, were known, repeated a key, had none."""
    names = T._parse_datatype_string(REPORT).names
    return spark.createDataFrame([tuple(m.get(n) for n in names) for m in manifests(spark, path)], REPORT)
