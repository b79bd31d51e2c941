"""Approximate nearest neighbours by a forest of random-projection trees.

Trees are built on a bounded sample: each node splits its part of the sample at the median of
its projection onto the line between two centres, which start as random rows of the node and
move a few times to the means of what lies nearer to them.  Every row is then sent down
every tree; a query is searched in all trees together through one priority queue of branches,
ordered by how far the query lies on the wrong side of the splits, until the opened leaves
hold enough rows.  How many that is, as a share of the index, falls with its size (see
``opened_share``).  The rows of those leaves are compared exactly, in double precision on the
original vectors.

Equal vectors are indexed once, with their smallest ``k + 1`` ids: no more of one vector can be
among the nearest ``k`` of a query.  A leaf hands on the first ``k + 1`` vectors by distance
and then by smallest id; what it leaves out comes after as many rows, so no tie is lost.

Neighbouring leaves meet in one group, so that a query travels once a group and not once a
leaf; a leaf with too many rows, or queries, is cut into chunks that all meet each other.  The forest
(its size bounded by the sample's) is what is broadcast.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, in_arrow, prepare
from .labelled import lists

#: Rows of the sample, trees, rows of a leaf, least rows of the sample in a leaf.
SAMPLE_ROWS, TREES, LEAF_ROWS, LEAF_SAMPLE = 32_768, 6, 32, 8
#: Rows that a group of leaves, and queries that one group of queries, is meant to hold.
GROUP_ROWS, GROUP_QUERIES = 4_096, 16_384
#: Rows of a node that choose its direction, and times that its two centres move.
NODE_ROWS, MOVES = 256, 4
#: Of an index of ``OPEN_AT`` rows the opened leaves hold ``OPEN_SHARE``, over all trees and with repeats.
OPEN_SHARE, OPEN_AT, OPEN_POWER = 0.9, 10_000, 0.2


def opened_share(rows: int) -> float:
    """The share of ``rows`` indexed rows that the leaves opened for a query hold."""
    return OPEN_SHARE * (max(rows, 1) / OPEN_AT) ** -OPEN_POWER


@dataclass
class Tree:
    """Complete binary tree: node i splits ``vector @ directions[i]`` at ``cuts[i]``; children 2i+1, 2i+2."""

    directions: np.ndarray
    cuts: np.ndarray
    depth: int
    weight: np.ndarray  # the share of the sample in each leaf


def _direction(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The unit vector between two centres of some of ``rows``; any, where all are alike."""
    x = rows if len(rows) <= NODE_ROWS else rows[rng.choice(len(rows), NODE_ROWS, replace=False)]
    d = rng.normal(size=rows.shape[1])
    if len(x) > 1:
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(MOVES):
            nearer = x @ (a - b) > (a @ a - b @ b) / 2
            if nearer.all() or not nearer.any():
                break
            a, b = x[nearer].mean(axis=0), x[~nearer].mean(axis=0)
        d = a - b if np.linalg.norm(a - b) > 1e-12 * (1 + np.linalg.norm(a)) else d
    return d / max(np.linalg.norm(d), 1e-300)


def grow(sample: np.ndarray, depth: int, seed: int) -> Tree:
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    directions, cuts = np.zeros((nodes, sample.shape[1])), np.zeros(nodes)
    parts: dict[int, np.ndarray] = {0: np.arange(len(sample))}
    for i in range(nodes):
        rows = parts.pop(i)
        directions[i] = _direction(sample[rows], rng)
        x = sample[rows] @ directions[i]
        cuts[i] = np.median(x) if len(x) else 0.0
        right = x > cuts[i]
        parts[2 * i + 1], parts[2 * i + 2] = rows[~right], rows[right]
    leaves = np.array([len(parts[nodes + k]) for k in range(nodes + 1)], dtype=float)
    return Tree(directions, cuts, depth, leaves / max(leaves.sum(), 1))


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf (from 0) that each row of ``x`` belongs to."""
    at = np.zeros(len(x), np.int64)
    for _ in range(tree.depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, tree.directions[at]) > tree.cuts[at])
    return at - ((1 << tree.depth) - 1)


def search(forest: list[Tree], q: np.ndarray, share: float) -> list[tuple[int, int]]:
    """(tree, leaf) pairs in the order in which one queue over all trees opens them.

    A branch's priority is the sum of squared distances between the query and the splits that
    it crosses to the wrong side.  Opening ends when the leaves hold ``share`` of all rows.
    """
    side = [t.directions @ q - t.cuts for t in forest]
    queue = [(0.0, t, 0) for t in range(len(forest))]
    found, held = [], 0.0
    while queue and held < share:
        far, t, i = heapq.heappop(queue)
        tree = forest[t]
        inner = len(tree.cuts)
        while i < inner:
            x = side[t][i]
            near, other = (2 * i + 2, 2 * i + 1) if x > 0 else (2 * i + 1, 2 * i + 2)
            heapq.heappush(queue, (far + float(x) ** 2, t, other))
            i = near
        found.append((t, i - inner))
        held += tree.weight[i - inner]
    return found


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and all its components are finite numbers."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values, off = lists(column)
    return values.astype(np.float64).reshape(len(off) - 1, -1) if len(off) > 1 else np.zeros((0, 0))


def _batches(tree, group, leaf, cells, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, group, leaf, ...) in batches of bounded size; ``cells(at)`` gives the other columns."""
    for i in range(0, len(tree), 10_000):
        s = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(tree[s], pa.int32()), pa.array(group[s], pa.int32()), leaf[s], *cells(s)], names=names)


def _members(forest, shift: int):
    """Rows (tree, group, leaf, v, least, x): each vector's leaf in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, trees = _matrix(b.column(2)), forest.value
            if not len(x):
                continue
            row, tree = np.tile(np.arange(len(x)), len(trees)), np.repeat(np.arange(len(trees)), len(x))
            leaf = np.concatenate([leaves_of(t, x) for t in trees])
            yield from _batches(tree, leaf >> shift, pa.array(leaf, pa.int32()), lambda s, b=b, row=row: [c.take(pa.array(row[s])) for c in b.columns], ["tree", "group", "leaf", "v", "least", "x"])

    return run


def _probes(forest, shift: int, share: float):
    """Rows (tree, group, leaves, v, x): the leaves that a query opens, by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, tree, group, leaves = [], [], [], []
            for i, x in enumerate(_matrix(b.column(1))):
                opened: dict[tuple[int, int], list[int]] = {}
                for t, leaf in search(forest.value, x, share):
                    opened.setdefault((t, leaf >> shift), []).append(leaf)
                for (t, g), some in opened.items():
                    row.append(i), tree.append(t), group.append(g), leaves.append(some)
            at = np.array(row, np.int64)
            yield from _batches(tree, group, pa.array(leaves, pa.list_(pa.int32())), lambda s, b=b, at=at: [c.take(pa.array(at[s])) for c in b.columns], ["tree", "group", "leaves", "v", "x"])

    return run


def first_rows(q: np.ndarray, score: np.ndarray, least: np.ndarray, n: int) -> np.ndarray:
    """Places of the first ``n`` rows of each ``q``, by score and then by ``least``."""
    order = np.lexsort((least, score, q))
    start = np.flatnonzero(np.concatenate([[True], q[order][1:] != q[order][:-1]])) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < n]


def nearest(a: np.ndarray, b: np.ndarray, least: np.ndarray, n: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``n`` rows of ``b`` for each row of ``a``, by exact distance and then by ``least``: (row of a, row of b, distance).

    Products of matrices find rows that may be among them, with a margin far above their
    rounding; distances are then taken component by component.
    """
    out = []
    own, other = (a**2).sum(axis=1), (b**2).sum(axis=1)
    for i in range(0, len(a), block):
        near = own[i : i + block, None] + other - 2 * a[i : i + block] @ b.T
        if len(b) > n:
            edge = np.partition(near, n - 1, axis=1)[:, n - 1]
            q, v = np.nonzero(near <= (edge + 1e-10 * (own[i : i + block] + other.max()))[:, None])
        else:
            q, v = (x.ravel() for x in np.indices(near.shape))
        exact = np.concatenate([np.sqrt(((b[v[j : j + 65_536]] - a[q[j : j + 65_536] + i]) ** 2).sum(axis=1)) for j in range(0, len(q), 65_536)] or [np.zeros(0)])
        keep = first_rows(q, exact, least[v], n)
        out.append((q[keep] + i, v[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)


def _rank(n: int):
    """The first ``n`` vectors of each query over the leaves of a group that it opens: q, v, least, score."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            a, b = (_matrix(t.column("x").combine_chunks()) for t in (left, right))
            leaf, least = right.column("leaf").to_numpy(), right.column("least").to_numpy()
            opened, off = lists(left.column("leaves").combine_chunks())
            asking = np.repeat(np.arange(len(a)), np.diff(off))
            by_leaf, by_opened = np.argsort(leaf, kind="stable"), np.argsort(opened, kind="stable")
            for one in np.unique(leaf):
                mine = by_leaf[slice(*np.searchsorted(leaf, (one, one + 1), sorter=by_leaf))]
                q = asking[by_opened[slice(*np.searchsorted(opened, (one, one + 1), sorter=by_opened))]]
                i, j, score = nearest(a[q], b[mine], least[mine], n)
                got.append((q[i], mine[j], score))
        q, v, score = (np.concatenate(x) for x in zip(*got, strict=True))
        if len(q):
            keep = first_rows(q, score, least[v], n)
            q, v, score = q[keep], v[keep], score[keep]
            return pa.table([left.column("v").take(pa.array(q)), right.column("v").take(pa.array(v)), right.column("least").take(pa.array(v)), pa.array(score)], names=["q", "v", "least", "score"])
        return pa.table([pa.array([], pa.int64())] * 3 + [pa.array([], pa.float64())], names=["q", "v", "least", "score"])

    return run


def neighbours(vectors: DataFrame, queries: Column, k: int = 10, id_column: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, group_rows: int = GROUP_ROWS, group_queries: int = GROUP_QUERIES, open_share: float | None = None, seed: int = 11) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each query row.

    ``queries`` (a condition on ``vectors``) names the queries; candidates are all rows but
    those with the query's own id.  Score is the Euclidean distance of the original vectors; ties go to the
    smaller id.  Rows with a null id or an unusable vector (see ``usable``) take no part.
    Vectors of unequal length are an error.  Of repeated ids every row is a candidate; a query id that
    repeats with one vector asks once.  Other columns of ``vectors`` are ignored, whatever
    their names.  No usable rows, or no queries, give no rows.  ``open_share`` replaces what
    ``opened_share`` says.
    """
    spark = vectors.sparkSession
    prepare(spark)
    kind = vectors.schema[vector].dataType.simpleString()
    if kind not in ("array<float>", "array<double>"):
        raise ValueError(f"{vector} must be an array of floats or doubles")
    rows = vectors.where(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("x"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # adding zero makes -0.0 and 0.0 one vector; the hash only spreads rows, the vector itself names them
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0).cast(kind[6:-1]))).withColumn("h", F.xxhash64("x"))
    order = Window.partitionBy("h", "x").orderBy("id")
    few = rows.select("h", "x", "id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    unique = few.groupBy("h", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    unique = cut(unique.withColumn("v", F.monotonically_increasing_id()).withColumn("least", F.col("ids")[0]))
    asking = cut(rows.where("asks").select("h", "x", "id").distinct().join(unique.select("h", "x", "v"), ["h", "x"]).select("v", "id"))
    total, short, long_ = unique.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if total and short != long_:
        raise ValueError(f"vectors have from {short} to {long_} components; all must have as many")
    asked_rows = asking.select("v").distinct().count()
    sample = unique.orderBy(F.xxhash64("h", F.lit(seed)), "x").limit(sample_rows).select("x").toArrow()
    points = _matrix(sample.column("x").combine_chunks()) if sample.num_rows else np.zeros((0, 1))
    depth = max(0, min(int(np.ceil(np.log2(max(total / leaf_rows, 1)))), int(np.log2(max(len(points) / LEAF_SAMPLE, 1)))))
    forest = spark.sparkContext.broadcast([grow(points, depth, seed + t) for t in range(trees)])
    share = max(opened_share(total) if open_share is None else open_share, 4 * (k + 1) / max(total, 1))
    # leaves of a group, and chunks of one: as many as the mean leaf needs, for leaves hold like shares of the sample
    shift = max(0, min(depth, int(np.floor(np.log2(max(group_rows / max(total / 2**depth, 1), 1))))))
    chunks = max(1, int(np.ceil(total / 2 ** (depth - shift) / group_rows / 2)))
    askers = max(1, int(np.ceil(asked_rows * min(1.0, share * 2**shift) / group_queries)))
    members = in_arrow(unique.select("v", "least", "x"), _members(forest, shift), f"tree int, group int, leaf int, v long, least long, x {kind}")
    asked = asking.select("v").distinct().join(unique.select("v", "x"), "v").select("v", "x")
    probes = in_arrow(asked, _probes(forest, shift, share), f"tree int, group int, leaves array<int>, v long, x {kind}")
    part = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    members = members.withColumn("chunk", part(chunks)).withColumn("asker", every(askers))
    probes = probes.withColumn("chunk", every(chunks)).withColumn("asker", part(askers))
    keys = ("tree", "group", "chunk", "asker")
    near = probes.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_rank(k + 1), "q long, v long, least long, score double").distinct()
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "least", "v"))).where(F.col("n") <= k + 1).drop("n", "least")
    listed = near.join(unique.select("v", "ids"), "v").select("q", "score", F.explode("ids").alias("vec_id"))
    listed = listed.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).where(F.col("n") <= k + 1).drop("n")
    found = asking.select(F.col("v").alias("q"), F.col("id").alias("query_id")).join(listed, "q").where("vec_id <> query_id")
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return found.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
