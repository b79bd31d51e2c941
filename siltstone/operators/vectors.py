"""A stored vector index: inverted lists with one-byte codes, searched exactly, kept up row by row.

A coarse quantiser (centres of a bounded sample) gives every row a list.  A row is stored twice: as one
byte a component with the length of what rounding left out, and in full.  A search reads the codes of
the lists that may matter: by a list's radius no row of it can score above q.c + radius, and by a
row's remainder its score lies within remainder of its code's.  So the rows that may be among the first
k are known for certain, and only these are read in full: nothing is missed.

New rows go to their lists in files of their own; a batch is written once under its name, so a repeated
batch changes nothing.  ``drift`` tells when the lists no longer fit the rows, and ``rebuild`` makes new ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .retrieval import _matrix
from .sparse import _names, ranked

#: Rows of the sample that gives centres, most lists, moves of the centres; rows of a batch compared at once.
SAMPLE_ROWS, LISTS, MOVES, BATCH = 16_384, 4_096, 8, 4_096
#: Queries of one search, in bytes: they go to every task.
QUERY_BYTES = 64 << 20
#: A list this many times larger than the mean, or rows this many times farther from their centres than at first, ask for new lists.
CROWDED, FARTHER = 8.0, 1.25


@dataclass(frozen=True)
class VectorIndex:
    """``codes`` (id, list, code, step, off), ``full`` (id, list, x) and the ``centres`` of a stored index, with the mean distance at first."""

    place: str
    codes: DataFrame
    full: DataFrame
    centres: np.ndarray
    distance: float

    def count(self) -> int:
        return self.codes.count()

    def ids(self) -> DataFrame:
        return self.codes.select("id")


def _centres(sample: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Means of the sample's rows nearest to each centre, moved a few times from random rows."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(MOVES):
        near = _nearest(sample, c)[0]
        sums, many = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(sums, near, sample)
        c = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T
    near = square.argmin(axis=1)
    return near, np.sqrt(((x - centres[near]) ** 2).sum(axis=1))


def _coded(shared):
    """Rows (id, list, far, code, step, off, x): the list, the distance to its centre, the code and what it leaves out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            near, far = _nearest(x, shared.value)
            step = np.maximum(np.abs(x).max(axis=1) / 127, 1e-300)
            code = np.rint(x / step[:, None]).astype(np.int8)
            off = np.sqrt(((x - code * step[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(far), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(step), pa.array(off), b.column(1)], names=["id", "list", "far", "code", "step", "off", "x"])

    return run


def _usable(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col(id_column).cast("long").alias("id"), x.alias("x"))


def _write(rows: DataFrame, at: str, centres: np.ndarray, batch: str) -> None:
    spark = rows.sparkSession
    made = rows.mapInArrow(_coded(spark.sparkContext.broadcast(centres)), "id long, list int, far double, code binary, step double, off double, x array<double>")
    sorted_ = made.repartitionByRange("list", "id").sortWithinPartitions("list", "id")
    sorted_.select("id", "list", "far", "code", "step", "off", "x").write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")


def build(vectors: DataFrame, place: str, lists: int | None = None, id_column: str = "vec_id", vector: str = "embedding", seed: int = 5) -> VectorIndex:
    """Writes an index of the rows with an id and a finite vector under ``place``; about the root of their number as lists.

    Each build has a folder of its own and is named by a file written last, so a search never sees half of one.
    Of rows of one id any one is kept.
    """
    spark, rows = vectors.sparkSession, _usable(vectors, id_column, vector).dropDuplicates(["id"])
    total = rows.count()
    sample = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE_ROWS).select("x").toArrow()
    points = _matrix(sample.column("x")) if total else np.zeros((1, 1))
    centres = _centres(points, lists or int(min(LISTS, max(1, round(total**0.5)))), seed)
    at = f"{place}/{uuid.uuid4().hex}"
    _write(rows, at, centres, "0")
    distance = spark.read.parquet(f"{at}/rows").agg(F.avg("far")).first()[0] or 0.0
    spark.createDataFrame([(i, c.tolist(), float(distance)) for i, c in enumerate(centres)], "list int, centre array<double>, distance double").coalesce(1).write.parquet(f"{at}/centres")
    return opened(spark, place)


def opened(spark: SparkSession, place: str) -> VectorIndex:
    """The last complete build under ``place``."""
    done = [n for n in _names(spark, place) if "_SUCCESS" in _names(spark, f"{place}/{n}/centres")]
    if not done:
        raise FileNotFoundError(f"no complete vector index in {place}")
    at = max((spark.read.parquet(f"{place}/{n}/centres").select(F.max("_metadata.file_modification_time")).first()[0], n) for n in done)[1]
    held = spark.read.parquet(f"{place}/{at}/centres").orderBy("list").toArrow()
    rows = spark.read.parquet(f"{place}/{at}/rows")
    return VectorIndex(f"{place}/{at}", rows.select("id", "list", "far", "code", "step", "off"), rows.select("id", "list", "x"), _matrix(held.column("centre")), held.column("distance")[0].as_py())


def add(index: VectorIndex, vectors: DataFrame, batch: str, id_column: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """The index with the rows whose ids it does not have yet, each in its list.

    A batch of a name is written once; one that was not written to its end is written again.
    """
    spark = vectors.sparkSession
    if "_SUCCESS" in _names(spark, f"{index.place}/rows/batch={batch}"):
        return index
    before = spark.read.parquet(f"{index.place}/rows").where(F.col("batch").cast("string") != batch).select("id")
    fresh = _usable(vectors, id_column, vector).dropDuplicates(["id"]).join(before, "id", "left_anti")
    _write(fresh, index.place, index.centres, batch)
    return opened(spark, index.place.rsplit("/", 1)[0])


def drift(index: VectorIndex) -> dict[str, float]:
    """How much larger the largest list is than the mean, and how much farther rows lie from their centres than at first."""
    sizes = index.codes.groupBy("list").agg(F.count("*").alias("n"), F.sum("far").alias("far"))
    most, total, far = sizes.agg(F.max("n"), F.sum("n"), F.sum("far")).first()
    mean = (total or 0) / max(len(index.centres), 1)
    return {"crowded": (most or 0) / max(mean, 1e-9), "farther": (far or 0.0) / max(total or 1, 1) / max(index.distance, 1e-12)}


def rebuilt(index: VectorIndex) -> VectorIndex:
    """The index itself, or a new one over its rows if its lists have drifted."""
    now = drift(index)
    if now["crowded"] <= CROWDED and now["farther"] <= FARTHER:
        return index
    return build(index.full.select(F.col("id").alias("vec_id"), F.col("x").alias("embedding")), index.place.rsplit("/", 1)[0])


def _probed(shared, k: int, places: int):
    """(query_id, id, list, low, high): rows of a batch that may be among a query's first ``k``, with bounds of their scores."""
    slack = 10.0**-places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, centres, radius = shared.value
        length, reach = np.sqrt((queries**2).sum(axis=1)), queries @ centres.T
        least = np.full(len(ids), -np.inf)
        for whole in batches:
            for i in range(0, whole.num_rows, BATCH):
                b = whole.slice(i, BATCH)
                row, list_ = b.column(0).to_numpy(), b.column(1).to_numpy()
                code = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int8).reshape(len(row), -1).astype(np.float64) * b.column(3).to_numpy()[:, None]
                off = b.column(4).to_numpy()
                for j in range(0, len(ids), 512):
                    s = slice(j, j + 512)
                    wanted = reach[s] + length[s, None] * radius >= least[s, None] - slack  # lists that may hold a score as high
                    middle, within = queries[s] @ code.T, length[s, None] * off + slack
                    low = middle - within
                    if len(row) >= k:
                        least[s] = np.maximum(least[s], np.partition(low, len(row) - k, axis=1)[:, len(row) - k])
                    q, r = np.nonzero((middle + within >= least[s, None]) & wanted[:, list_])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s][q]), pa.array(row[r]), pa.array(list_[r]), pa.array(low[q, r]), pa.array((middle + within)[q, r])], names=["query_id", "id", "list", "low", "high"])

    return run


def candidates(index: VectorIndex, queries: DataFrame, k: int = 10, places: int = 6) -> DataFrame:
    """(query_id, id, list): the rows that may be among the first ``k`` of a query by their codes; no other can be."""
    spark = queries.sparkSession
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("x"))
    many, size = asked.agg(F.count("*"), F.max(F.size("x"))).first()
    if many * (size or 0) * 8 > QUERY_BYTES:
        raise ValueError("more queries than one search takes; ask in several")
    t = asked.toArrow()
    radius = np.zeros(len(index.centres))
    for r in index.codes.groupBy("list").agg(F.max("far").alias("r")).collect():  # one number a list
        radius[r["list"]] = r["r"]
    held = (t.column("query_id").to_numpy(), _matrix(t.column("x")) if t.num_rows else np.zeros((0, index.centres.shape[1])), index.centres, radius)
    met = index.codes.select("id", "list", "code", "step", "off").mapInArrow(_probed(spark.sparkContext.broadcast(held), k, places), "query_id long, id long, list int, low double, high double")
    least = ranked(met, k, F.desc("low")).where(F.col("rank") == k).select("query_id", F.col("low").alias("least"))
    return met.join(least, "query_id", "left").where("least is null or high >= least").select("query_id", "id", "list")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, places: int = 6) -> DataFrame:
    """(query_id, doc_id, score, rank): the ``k`` rows of largest inner product with each query (query_id, embedding), ties by smaller id.

    Exact: what an exact scan gives, with only the candidates read in full.
    """
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").cast("array<double>").alias("q"))
    met = candidates(index, queries, k, places).join(index.full, ["list", "id"]).join(asked, "query_id")
    score = F.round(F.aggregate(F.zip_with("q", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), places)
    return ranked(met.select("query_id", F.col("id").alias("doc_id"), score.alias("score")), k, F.desc("score"), F.col("doc_id"))
