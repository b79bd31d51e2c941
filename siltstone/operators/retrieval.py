"""Batch retrieval: BM25, dense search, rank fusion, hybrid search behind a quality gate.

Every operator takes a table of queries and carries ``query_id``.  Ranked lists are rows
(query_id, doc_id, score, rank) with ranks from 1 and the id as the last tie-break.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import is_garbled

from .sparse import SparseIndex, bm25_topk, ranked

#: Bytes of queries that every task may hold; bytes of a block of queries and of a slice of vectors beyond that.
SHARED_BYTES, BLOCK_BYTES = 64 << 20, 4 << 20
#: Scores that a task holds at once.
SCORE_NUMBERS = 1 << 21


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def first_columns(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the ``n`` largest of each line, by score and then by smaller id; only what may be among them is sorted."""
    if scores.shape[1] > n:
        edge = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]
        line, column = np.nonzero(scores >= edge[:, None])
    else:
        line, column = (x.ravel() for x in np.indices(scores.shape))
    order = np.lexsort((ids[column], -scores[line, column], line))
    line, column = line[order], column[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    return line[place < n], column[place < n]


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def compared(ids: np.ndarray, queries: np.ndarray, only: list[str | None], docs: np.ndarray, vectors: np.ndarray, keys: list[list[str] | None] | None, n: int, places: int) -> Iterator[pa.RecordBatch]:
    """The first ``n`` of some vectors for each query, in blocks of queries whose scores fit ``SCORE_NUMBERS``; of those with the query's key, if it has one."""
    step = max(1, SCORE_NUMBERS // max(len(docs), 1))
    asked = sorted({k for k in only if k is not None})
    code = np.array([0 if k is None else 1 + asked.index(k) for k in only], np.int64)
    has = np.array([[True] * len(docs), *[[k in (own or ()) for own in keys or [None] * len(docs)] for k in asked]])
    for i in range(0, len(ids) if len(docs) else 0, step):
        scores = np.round(queries[i : i + step] @ vectors.T, places)
        scores = np.where(has[code[i : i + step]], scores, -np.inf) if asked else scores
        line, column = first_columns(scores, docs, n)
        fits = scores[line, column] > -np.inf
        line, column = line[fits], column[fits]
        yield pa.RecordBatch.from_arrays([pa.array(ids[i + line]), pa.array(docs[column]), pa.array(scores[line, column])], names=["query_id", "doc_id", "score"])


def _scan(shared, n: int, places: int):
    """Each batch of vectors against all queries, which the task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, only = shared.value
        for batch in batches:
            keep = batch.filter(batch.column(1).is_valid())
            if keep.num_rows:
                yield from compared(ids, queries, only, keep.column(0).to_numpy(), _matrix(keep.column(1)), keep.column(2).to_pylist() if keep.num_columns > 2 else None, n, places)

    return run


def _meet(n: int, places: int):
    """A block of queries against a slice of vectors."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])
        if not (left.num_rows and right.num_rows):
            return schema.empty_table()
        only, keys = left.column("only").to_pylist(), right.column("keys").to_pylist() if "keys" in right.column_names else None
        return pa.Table.from_batches(compared(left.column("query_id").to_numpy(), _matrix(left.column("embedding")), only, right.column("doc_id").to_numpy(), _matrix(right.column("embedding")), keys, n, places), schema)

    return run


def dense_topk(queries: DataFrame, vectors: DataFrame, n: int = 10, where: Column | None = None, exclude_self: bool = False, places: int = 6, shared_bytes: int = SHARED_BYTES) -> DataFrame:
    """Top ``n`` by cosine of unit vectors: exact, filter first, in one pass over the vectors.

    A stated set of queries is compared with all rows in blocks.  Queries of up to ``shared_bytes``
    (counted) go to every task, and each batch of rows is a few matrix products that leave its best
    ``n`` a query.  More queries are dealt to blocks and the rows to slices, and every block meets every
    slice in one stage; no query then passes through the driver.

    A query with a key in ``only`` (a column that may be left out) meets the rows that have it among
    their ``keys``: filters that differ from query to query are still one search.
    """
    routed = "only" in queries.columns
    rows = (vectors.where(where) if where is not None else vectors).select("doc_id", "embedding", *(["keys"] if routed else []))
    asked = queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding", F.col("only") if routed else F.lit(None).cast("string").alias("only"))
    spark, schema, take = rows.sparkSession, "query_id bigint, doc_id bigint, score double", n + 1 if exclude_self else n
    many, size = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if many * (size or 0) * 8 <= shared_bytes:
        t = asked.toArrow()
        held = (t.column("query_id").to_numpy(), _matrix(t.column("embedding")) if t.num_rows else np.zeros((0, 0)), t.column("only").to_pylist())
        found = rows.mapInArrow(_scan(spark.sparkContext.broadcast(held), take, places), schema)
    else:
        blocks = -(-many * size * 8 // BLOCK_BYTES)
        known = rows.where(F.col("embedding").isNotNull())
        slices = max(1, -(-known.count() * size * 8 // BLOCK_BYTES))
        every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(int(k - 1))))
        left = asked.select("query_id", "embedding", "only", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), every(slices).alias("slice"))
        right = known.select(*known.columns, every(blocks).alias("block"), F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int").alias("slice"))
        found = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice")).applyInArrow(_meet(take, places), schema)
    found = found.where("query_id <> doc_id") if exclude_self else found
    return ranked(found, n, F.desc("score"), F.col("doc_id"))


def fuse(dense: DataFrame, sparse: DataFrame, k: float | Column = 60.0, dense_weight: float = 1.0, sparse_weight: float = 1.0, places: int = 6) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: Σ weight / (k + rank); absent rows add nothing.

    Ties: first the dense list in its order, then rows of the sparse list only.
    """
    k = F.lit(k) if isinstance(k, float) else k
    d = dense.select("query_id", "doc_id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "doc_id", F.col("score").alias("sparse_score"), F.col("rank").alias("sparse_rank"))
    both = d.join(s, ["query_id", "doc_id"], "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (k + F.col(r)), F.lit(0.0))
    mode = F.when(F.col("sparse_rank").isNull(), "dense_only").when(F.col("dense_rank").isNull(), "sparse_only").otherwise("hybrid")
    return both.withColumn("rrf_score", F.round(part("dense_rank", dense_weight) + part("sparse_rank", sparse_weight), places)).withColumn("retrieval_mode", mode)


FUSED_ORDER = (F.desc, "rrf_score"), (F.asc_nulls_last, "dense_rank"), (F.asc_nulls_last, "sparse_rank")


def fused_order() -> list[Column]:
    return [f(c) for f, c in FUSED_ORDER]


def _dealt(candidates: DataFrame) -> DataFrame:
    """Candidates in tasks of their own: reading their texts costs more than moving them, and a join of small sides ends in one task."""
    return candidates.repartition(candidates.sparkSession.sparkContext.defaultParallelism, "query_id", "doc_id")


def gated(lists: DataFrame, docs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each list whose texts pass the quality gate; only the listed texts are read."""
    met = _dealt(lists.join(docs.select("doc_id", "text"), "doc_id")).withColumn("garbled", is_garbled(F.col("text")))
    return ranked(met.where(~F.col("garbled")).drop("text", "garbled", "rank"), k, *order)


def dense_only(queries: DataFrame, docs: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The dense list alone, ``3 * k`` rows deep behind the gate."""
    return gated(dense_topk(queries, docs, 3 * k, where), docs, k, F.desc("score"), F.col("doc_id"))


def sparse_only(queries: DataFrame, docs: DataFrame, index: SparseIndex, k: int = 10, where: Column | None = None, **bm25) -> DataFrame:
    """The sparse list alone, filtered after ranking, ``3 * k`` rows deep behind the gate."""
    top = bm25_topk(queries, docs, index, 6 * k, **bm25)
    if where is not None:
        top = top.join(docs.where(where).select("doc_id"), "doc_id", "left_semi")
    return gated(ranked(top.drop("rank"), 3 * k, F.desc("score"), F.col("doc_id")), docs, k, F.desc("score"), F.col("doc_id"))


def hybrid(queries: DataFrame, docs: DataFrame, index: SparseIndex, k: int = 10, pool: int = 4, where: Column | None = None, rrf_k: float = 60.0, gate: bool = True, debug: bool = False, **bm25) -> DataFrame:
    """Dense and sparse candidates fused, gated by text quality, the first ``k`` of each query.

    ``queries``: query_id, text, embedding; ``docs``: doc_id, text, embedding (may be null) and
    filter columns; ``index``: of the same documents.  The dense side filters before it ranks; the
    sparse side ranks ``2 * pool * k`` rows, filters, and keeps ``pool * k``.  The gate looks at the
    first ``3 * k`` fused rows.  With ``debug`` all fused rows come back, with ``garbled`` and their
    fused rank.
    """
    depth = pool * k
    dense = dense_topk(queries, docs, depth, where)
    sparse = bm25_topk(queries, docs, index, 2 * depth, **bm25)
    if where is not None:
        sparse = sparse.join(docs.where(where).select("doc_id"), "doc_id", "left_semi")
    sparse = ranked(sparse.drop("rank"), depth, F.desc("score"), F.col("doc_id"))
    fused = ranked(fuse(dense, sparse, rrf_k), 2 * depth if debug else 3 * k, *fused_order()).withColumnRenamed("rank", "fused_rank")
    # few candidates are left: the gate reads only their texts
    met = _dealt(fused.join(docs.select("doc_id", "text"), "doc_id")).withColumn("garbled", is_garbled(F.col("text"))).drop("text")
    if debug:
        return met
    kept = met.where(~F.col("garbled")) if gate else met
    return ranked(kept.drop("garbled"), k, F.col("fused_rank"))
