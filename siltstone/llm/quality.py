"""Quality by random-indexing word vectors and a small calibrated network.

Every token bucket has a sparse random *index vector*, computed from its number.  A pass over
all documents adds to each bucket's *context vector* the index vectors of the tokens up to two
places away.  The sums are fixed-size blocks, combined by a reduction tree, so the table
(about 3 MB) is the same size for any corpus.  Centred, scaled context vectors are pooled
into one vector a document (means, mean squares, likeness of neighbours), and a two-layer numpy network turns that into a probability
whose temperature is set on rows that the training leaves out.

The network is fitted on at most ``TRAINING_ROWS`` labelled rows; the word vectors come from
all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aliased, freed, in_arrow, prepare, text_of
from .labelled import bounded_sample, hashed, label_table, lists, mapped

BUCKETS, DIMS, FILLED, BLOCK = 1 << 14, 48, 4, 256
TRAINING_ROWS = 20_000
#: Letters, digits, and runs of one other character class; case is kept.
PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+"


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs (BUCKETS, FILLED) of the index vectors."""
    x = np.arange(BUCKETS * FILLED, dtype=np.uint64).reshape(BUCKETS, FILLED) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    return (x % np.uint64(DIMS)).astype(np.int64), np.where(x >> np.uint64(40) & np.uint64(1), 1.0, -1.0)


def buckets(values: np.ndarray) -> np.ndarray:
    return (values.view(np.uint64) % np.uint64(BUCKETS)).astype(np.int64)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition's context-vector sums and token counts, as blocks of buckets."""
    from pyspark import TaskContext

    place, sign = _index_vectors()
    total, count = np.zeros(BUCKETS * DIMS), np.zeros(BUCKETS)
    for b in batches:
        values, offsets = lists(b.column(0))
        w, doc = buckets(values), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        count += np.bincount(w, minlength=BUCKETS)
        for step in (1, 2):
            same = np.flatnonzero(doc[step:] == doc[:-step])
            for i in range(0, len(same), 200_000):
                a = same[i : i + 200_000]
                for one, other in ((w[a], w[a + step]), (w[a + step], w[a])):
                    total += np.bincount((one[:, None] * DIMS + place[other]).ravel(), weights=sign[other].ravel(), minlength=BUCKETS * DIMS)
    if count.any():
        part = TaskContext.get().partitionId()
        table = np.concatenate([total.reshape(BUCKETS, DIMS), count[:, None]], axis=1)
        blocks = [table[i : i + BLOCK].tobytes() for i in range(0, BUCKETS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], names=["block", "part", "sums"])


def _add(table: pa.Table) -> pa.Table:
    """Adds the blocks of one group; in the order of their parts, so that reruns agree."""
    table = table.sort_by("part")
    total = sum(np.frombuffer(x.as_py()) for x in table.column("sums"))
    return pa.table({"block": table.column("block").slice(0, 1), "part": pa.array([table.column("part")[0].as_py() // 64], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """(BUCKETS, DIMS) float32 vectors from all texts; zeros where nothing was seen."""
    prepare(docs.sparkSession)
    tokens = docs.select(hashed(text_of(docs, text), PATTERN).alias("h"))
    schema = "block int, part int, sums binary"
    sums, parts = in_arrow(tokens, _context_sums, schema), max(1, tokens.rdd.getNumPartitions())
    for _ in range(max(1, math.ceil(math.log(parts, 64)))):  # a tree with a fan-in of 64
        sums = sums.groupBy("block", F.expr("part div 64").alias("of")).applyInArrow(_add, schema)
    table = np.zeros((BUCKETS, DIMS + 1))
    for row in sums.collect():  # BUCKETS / BLOCK rows
        table[row.block * BLOCK : (row.block + 1) * BLOCK] += np.frombuffer(row.sums).reshape(BLOCK, DIMS + 1)
    vectors, count = table[:, :DIMS], table[:, DIMS]
    seen = count > 0
    if seen.any():
        vectors = vectors / np.maximum(count, 1)[:, None]
        vectors[seen] -= np.average(vectors[seen], axis=0, weights=count[seen])
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 0.05
    vectors[~seen] = 0
    return vectors.astype(np.float32)


#: Pooled statistics of a text: mean and mean square a dimension, and how alike neighbours are.
POOLED = 2 * DIMS + 2


def pool(vectors: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, POOLED): means of the token vectors, of their squares, and of neighbours' products one and two places apart."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1, POOLED))
    w = buckets(values)
    for i in range(n):
        a, b = offsets[i], offsets[i + 1]
        for k in range(a, b, 65536):  # long texts in steps
            v = vectors[w[k : min(b, k + 65536)]]
            out[i, :DIMS] += v.sum(axis=0)
            out[i, DIMS : 2 * DIMS] += np.einsum("ij,ij->j", v, v)
            for step in (1, 2):
                out[i, 2 * DIMS + step - 1] += np.einsum("ij,ij->", v[step:], v[:-step])
    return out / (np.diff(offsets)[:, None] + 2.0)


@dataclass
class Network:
    """Two layers: tanh units, then one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log-loss, from a grid."""
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(y == 1, -z, z) / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, rate: float = 0.01, decay: float = 1e-3, seed: int = 1) -> Network:
    """Fits a network by Adam on four fifths of the rows and its temperature on the rest."""
    rng = np.random.default_rng(seed)
    if len(y) < 10 or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        d = x.shape[1]
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share)))
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
    p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    z = (x - mean) / scale
    size = max(32, min(256, len(fit) // 20))
    for _ in range(epochs):
        order = rng.permutation(fit)
        for i in range(0, len(order), size):
            xb, yb = z[order[i : i + size]], y[order[i : i + size]]
            h = np.tanh(xb @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - yb) / len(yb)
            back = err[:, None] * p[2] * (1 - h * h)
            grads = [xb.T @ back + decay * p[0], back.sum(axis=0), h.T @ err + decay * p[2], np.array([err.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    net.temperature = _temperature(net.logits(x[held]), y[held])
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network

    def score(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.network.probabilities(pool(self.vectors, values, offsets))


def fit(docs: DataFrame, labels: DataFrame, train_on: Column, id_column: str = "doc_id", text: str = "text", label: str = "quality", training_rows: int = TRAINING_ROWS) -> Model:
    """Word vectors of all ``docs`` and a network for the labels that ``train_on`` (over ``id``) admits.

    Without rows of both classes every score is the share of label 1, or a half without any; so with an
    empty table.  Contradictory labels of one id count by their mean (a half as 1), and every row of a repeated
    document id is one of training.
    """
    prepare(docs.sparkSession)
    vectors = word_vectors(docs, text)
    known = label_table(labels, label, train_on, id_column)
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text).alias("text"))
    sample = rows.join(bounded_sample(known, training_rows), "id").select(F.xxhash64("id", "text").alias("o"), "label", hashed(F.col("text"), PATTERN).alias("h"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    pooled = mapped(sample, "h", lambda v, o: (list(pool(sent.value, v, o)),), {"x": ("array<double>", pa.list_(pa.float64()))})
    got = pooled.orderBy("o").limit(training_rows).toArrow()
    freed(docs.sparkSession)
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, POOLED)
    return Model(vectors, train(x, got.column("label").to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability ``out`` (double, 0 to 1) that a text is good.

    The text column goes unless ``keep_text``; an own column called ``out`` is replaced.  Null
    and empty texts get the score of a zero vector.  Texts are scored whole; rows stay one to one, and
    repeated ones score alike.  The caller sets the threshold; a score equal to it counts as reaching it in
    the registered query and in the pipeline.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given, back = aliased(docs, out, *([] if keep_text else [text]))
    df = docs.select(*given, hashed(text_of(docs, text), PATTERN).alias("h"))
    made = mapped(df, "h", lambda v, o: (sent.value.score(v, o),), {"p": ("double", pa.float64())})
    return made.select(*back, F.col("p").alias(out))
