"""What the two classifiers share: hashed tokens, labels of documents, logistic pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, quoted, small_side, without


def hashed(text: Column, pattern: str) -> Column:
    """The XXH64 hashes of all matches of ``pattern``, in order, computed by the JVM."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.xxhash64(w))


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list column without nulls; offsets start at 0."""
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    return values, (off - off[0]).astype(np.int64)


def label_table(labels: DataFrame, label: str, train: Column, id_column: str = "doc_id") -> DataFrame:
    """``id``, ``label`` (0 or 1) of the rows that ``train`` (on column ``id``) admits.

    Null ids and labels are left out; of contradictory labels of one id the mean decides,
    a half counting as 1.
    """
    rows = labels.select(F.col(id_column).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    return rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("label")).where(train)


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` (with a column ``id``) that have a label.

    The labels, two numbers a row, are broadcast if there are at most two million of them;
    beyond that both sides are shuffled.
    """
    return docs.join(small_side(labels), "id")


def bounded_sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labels, those whose ids hash lowest."""
    return F.broadcast(labels.orderBy(F.xxhash64("id"), "id").limit(rows))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method.

    ``ridge`` is the penalty on the weights of columns scaled to a deviation of 1.
    """
    scale = x.std(axis=0) + 1e-12
    z = np.column_stack([x / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def mapped(df: DataFrame, tokens: str, function, fields: dict[str, tuple[str, pa.DataType]], also: str | None = None) -> DataFrame:
    """``df`` without ``tokens``, with columns that ``function(values, offsets)`` makes, one value a row.

    An own column of a made one's name is replaced.  With ``also``, the values of that column
    are a third argument.
    """
    df = without(df.select(*[c for c in map(quoted, df.columns) if c != quoted(tokens)], df[tokens].alias("0tokens")), *fields)
    keep = df.columns[:-1]
    at = keep.index(also) if also else None
    schema = without(df, "0tokens").withColumns({k: F.lit(None).cast(t) for k, (t, _) in fields.items()}).schema
    kinds = [t for _, t in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = () if at is None else (b.column(at).to_numpy(),)
            made = function(*lists(b.column(b.num_columns - 1)), *more)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(m, t) for m, t in zip(made, kinds, strict=True)]], names=[*keep, *fields])

    return in_arrow(df, run, schema)
