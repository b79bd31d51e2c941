"""Shared helpers of the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of two or three numbers that may be broadcast; about 100 MB in a JVM hash table.
BROADCAST_ROWS = 2_000_000


#: For Python workers: arrays of a quarter of a megabyte or more go back to the system as soon as they are free.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(1 << 18), "MALLOC_TRIM_THRESHOLD_": str(1 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow``, with what a partition has freed given back to the system at its end, for workers live on."""

    def whole(batches):
        yield from run(batches)
        given_back()

    return df.mapInArrow(whole, schema)


def given_back() -> None:
    """Gives what this Python process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column of strings without nulls, and where each text begins and the last ends."""
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[off[0] : off[-1]], off - off[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory, through Spark's own reader, whatever the file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession, records: int = 1000, size: str = "2m") -> None:
    """Sets a session up for Python workers.

    Arrow batches are bounded by bytes, since texts may be very long, and workers started
    from here on find this package where the driver found it.  Results do not depend on the
    size of batches; sizes that the session was started with stay.
    """
    given = spark.sparkContext.getConf()
    for key, value in (("maxRecordsPerBatch", str(records)), ("maxBytesPerBatch", size)):
        if not given.contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a temporary folder
    serves a local session, as in tests; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        place = sc.getConf().get("spark.checkpoint.dir")
        if not place and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Rows of a few numbers that a file of a checkpoint is meant to hold.
FILE_ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder.

    With a known bound on ``rows`` it has no more files than those need: small steps of a long
    loop would else write a file a partition each.
    """
    shared_folder(df.sparkSession)
    return (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).checkpoint(eager=True)


def handed_over(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, for steps that scan it more than once."""
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place, compression=compression)
    return spark.read.parquet(place)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so as the driver collects its garbage.

    The driver's Python and its JVM also give what they have freed outside the heap back to the system: the C library would
    keep it, some 200 MB of the JVM's after four small runs, most likely of its many threads and its compiler.
    """
    given_back()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    with contextlib.suppress(Py4JError):  # from Java 17.0.9 on, on Linux
        # by reflection, as the server's own class is closed to callers
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any spelling."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns of these names, in any spelling."""
    gone = {n.lower() for n in names}
    return df.select(*[df[quoted(c)] for c in df.columns if c.lower() not in gone])


def aliased(df: DataFrame, *names: str) -> tuple[list[Column], list[Column]]:
    """The columns of ``df`` but those of these names (in any spelling) as ``c0``, ``c1`` and so on, and the way back.

    So no column of a user's meets an operator's own, and Python sees plain names.
    """
    gone = {n.lower() for n in names}
    own = [c for c in df.columns if c.lower() not in gone]
    return [df[quoted(c)].alias(f"c{i}") for i, c in enumerate(own)], [F.col(f"c{i}").alias(c) for i, c in enumerate(own)]


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if its counted rows are within ``limit``.

    Beyond the limit the mark is left out and Spark shuffles both sides.  ``df`` must be
    cheap to count and hold a few fixed-size columns.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row; equal rows have equal hashes."""
    return F.xxhash64(*[F.col(quoted(c)) for c in df.columns])


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text as a string, null as the empty string."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
