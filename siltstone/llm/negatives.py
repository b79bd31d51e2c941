"""Hard negatives by exact inner product, bracketed by a table of distances to pivots.

Vectors are scaled to integers.  One more component, the root of what a vector's squared length
lacks to the longest one's, turns inner products into Euclidean distances: for an anchor q (whose
own further component is 0) and a row x, |q - x|^2 = |q|^2 + M - 2 <q, x>, with M the largest squared
length.  The pivot table stores each row's distances to a few pivots; by the triangle inequality an
anchor's distances to the same pivots bracket its distance to the row, and so the row's score.

Rows are grouped by their nearest pivot and by rings around it.  A group's smallest and largest
distances to every pivot bracket all its scores at once: an anchor travels to the groups that may
hold a score it looks for, and to no other.  There each row's own bracket is tested, and only what
survives is multiplied out, exactly.  Groups are cut into slices of bounded size, and the anchors of a
group into parts, so that no task holds more than a slice and a part whatever repeats.  Both
searches (positives, then negatives within a share of their scores) are this one step; bounds
start from a bounded sample's scores and tighten as a slice is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ann import first_rows
from .common import handed_over, in_arrow, prepare
from .labelled import lists

#: Rows of the sample that gives pivots, rings and first bounds; pivots; most groups.
SAMPLE_ROWS, PIVOTS, GROUPS = 4_096, 16, 4_096
#: Least and most rows of a slice, anchors of a part; rows and anchors compared at once.
SLICE_ROWS, PART_ANCHORS, TILE_ROWS, TILE_ANCHORS = (512, 16_384), 8_192, 2_048, 256
#: Share of the largest squared distance that rounding of stored distances may be off.
SLACK = 1e-5


@dataclass
class Pivots:
    """``x`` (one pivot a row) with its further component ``more``; ``longest``: the largest squared length of any row;
    ``rings``: cuts of the distance to the nearest pivot, one line a pivot."""

    x: np.ndarray
    more: np.ndarray
    longest: float
    rings: np.ndarray

    def distances(self, v: np.ndarray, more: np.ndarray) -> np.ndarray:
        square = ((v**2).sum(axis=1) + more**2)[:, None] + ((self.x**2).sum(axis=1) + self.more**2) - 2 * (v @ self.x.T + more[:, None] * self.more)
        return np.sqrt(np.maximum(square, 0))

    def of_rows(self, v: np.ndarray) -> np.ndarray:
        return self.distances(v, np.sqrt(np.maximum(self.longest - (v**2).sum(axis=1), 0)))

    def of_anchors(self, v: np.ndarray) -> np.ndarray:
        return self.distances(v, np.zeros(len(v)))

    def groups(self, far: np.ndarray) -> np.ndarray:
        """The nearest pivot and the ring around it, as one number."""
        cell = far.argmin(axis=1)
        ring = (far[np.arange(len(far)), cell][:, None] > self.rings[cell]).sum(axis=1) if len(far) else cell
        return cell * (self.rings.shape[1] + 1) + ring


def choose(sample: np.ndarray, longest: float, pivots: int, rings: int) -> Pivots:
    """Pivots far from each other (each the farthest of the sample from those before), and rings that share a cell's sample evenly."""
    more = np.sqrt(np.maximum(longest - (sample**2).sum(axis=1), 0))
    at, near = [0], np.full(len(sample), np.inf)
    while len(at) < min(pivots, len(sample)):
        one = Pivots(sample[at[-1:]], more[at[-1:]], longest, np.zeros((1, 0)))
        near = np.minimum(near, one.distances(sample, more)[:, 0])
        if near.max() <= 1e-6:
            break
        at.append(int(near.argmax()))
    made = Pivots(sample[at], more[at], longest, np.zeros((len(at), 0)))
    far = made.distances(sample, more)
    cell, cuts = far.argmin(axis=1), np.linspace(0, 1, rings + 1)[1:-1]
    made.rings = np.array([np.quantile(far[cell == c, c], cuts) if (cell == c).any() else np.zeros(rings - 1) for c in range(len(at))]).reshape(len(at), rings - 1)
    return made


def bracket(own: np.ndarray, least: np.ndarray, most: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores: ``own`` an anchor's distances to the pivots, ``least`` and ``most`` those of a row (or of all rows of a group),
    ``whole`` the anchor's squared length plus the longest."""
    gap, reach = np.zeros((len(own), len(least)), own.dtype), np.full((len(own), len(least)), np.inf, own.dtype)
    for j in range(own.shape[1]):
        a = own[:, j, None]
        if least is most:
            np.maximum(gap, np.abs(a - least[:, j]), out=gap)
        else:
            np.maximum(gap, np.maximum(a - most[:, j], least[:, j] - a), out=gap)
        np.minimum(reach, a + most[:, j], out=reach)
    slack = (SLACK * whole + 1)[:, None]
    return (whole[:, None] - reach.astype(np.float64) ** 2) / 2 - slack, (whole[:, None] - gap.astype(np.float64) ** 2) / 2 + slack


def _matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, off = lists(column)
    return values.astype(kind).reshape(len(off) - 1, -1) if len(off) > 1 else np.zeros((0, 0), kind)


def _stored(pivots):
    """Rows (id, label, asks, v, far, grp) of the pivot table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                far = pivots.value.of_rows(_matrix(b.column(3)))
                lines = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1) * far.shape[1], pa.int32()), pa.array(far.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, lines, pa.array(pivots.value.groups(far).astype(np.int32))], names=["id", "label", "asks", "v", "far", "grp"])

    return run


def _allowed(a_id, a_label, id_, label, same: bool) -> np.ndarray:
    """Which rows may answer which anchors."""
    alike = a_label[:, None] == label
    return alike & (a_id[:, None] != id_) if same else ~alike


def _nth(scores: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each line, -inf where there are fewer."""
    if scores.shape[1] < n:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n]


def _sent(shared, same: bool, n: int, parts: int):
    """Rows (grp, slice, part, a, id, label, v, near, ps, lo, hi): an anchor at each slice of the groups that may hold what it looks for.

    ``lo`` rises to the n-th best score of the sample within the band: no worse row is needed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, groups, slices, least, most, (s_id, s_label, s_v) = shared.value
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, TILE_ANCHORS):
                b = whole_batch.slice(start, TILE_ANCHORS)
                a, id_, label, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(3))
                lo, hi = _matrix(b.column(5)), _matrix(b.column(6))
                near = pivots.of_anchors(v)
                known = np.where(_allowed(id_, label, s_id, s_label, same), v @ s_v.T, -np.inf)
                for k in range(lo.shape[1]):
                    inside = np.where((known >= lo[:, k, None]) & (known <= hi[:, k, None]), known, -np.inf)
                    lo[:, k] = np.maximum(lo[:, k], _nth(inside, n))
                lower, upper = bracket(near, least, most, (v**2).sum(axis=1) + pivots.longest)
                wanted = np.zeros(lower.shape, bool)
                for k in range(lo.shape[1]):
                    wanted |= (upper >= lo[:, k, None]) & (lower <= hi[:, k, None]) & (lo[:, k] <= hi[:, k])[:, None]
                row, g = np.nonzero(wanted)
                times = slices[g]
                at, which = np.repeat(row, times), np.repeat(g, times)
                piece = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                lines = lambda m, kind: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.astype(kind).ravel()))
                kept = [b.column(0), b.column(1), b.column(2), b.column(3), lines(near, np.float32), b.column(4), lines(lo, np.float64), b.column(6)]
                for i in range(0, len(at), 4_096):
                    s = slice(i, i + 4_096)
                    take = pa.array(at[s])
                    place = [pa.array(groups[which[s]].astype(np.int32)), pa.array(piece[s].astype(np.int32)), pa.array((a[at[s]] % parts).astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*place, *[c.take(take) for c in kept]], names=["grp", "slice", "part", "a", "id", "label", "v", "near", "ps", "lo", "hi"])

    return run


def search_slice(v, near, a_id, a_label, lo, hi, x, far, id_, label, longest: float, same: bool, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, band, row, score) of the first ``n`` rows of each anchor and band within [lo, hi]: brackets first, then exact products."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
    bands = lo.shape[1]
    for i in range(0, len(v), TILE_ANCHORS):
        s = slice(i, i + TILE_ANCHORS)
        whole, low, held = (v[s] ** 2).sum(axis=1) + longest, lo[s].copy(), np.full((len(v[s]), bands, n), -np.inf)
        for j in range(0, len(x), TILE_ROWS):
            t = slice(j, j + TILE_ROWS)
            stored = far[t]
            lower, upper = bracket(near[s], stored, stored, whole)
            may = np.zeros(lower.shape, bool)
            for k in range(bands):
                may |= (upper >= low[:, k, None]) & (lower <= hi[s][:, k, None])
            may &= _allowed(a_id[s], a_label[s], id_[t], label[t], same)
            p, q = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
            if not len(p):
                continue
            score = np.where(may[np.ix_(p, q)], v[s][p] @ x[t][q].T, -np.inf)
            for k in range(bands):
                inside = np.where((score >= low[p, k, None]) & (score <= hi[s][p, k, None]), score, -np.inf)
                best, r = np.nonzero((inside >= _nth(inside, n)[:, None]) & (inside > -np.inf))
                got = inside[best, r]
                keep = first_rows(best, -got, id_[t][q[r]], n)
                best, r, got = best[keep], r[keep], got[keep]
                found.append((i + p[best], np.full(len(best), k), j + q[r], got))
                # the n-th best so far is a bound for what comes
                place = np.arange(len(best)) - np.searchsorted(best, best)
                new = np.full((len(p), n), -np.inf)
                new[best, place] = got
                held[p, k] = -np.sort(-np.concatenate([held[p, k], new], axis=1), axis=1)[:, :n]
                low[p, k] = np.maximum(low[p, k], held[p, k, n - 1])
    a, k, r, score = (np.concatenate(c) for c in zip(*found, strict=True))
    keep = first_rows(a * bands + k, -score, id_[r], n)
    return a[keep], k[keep], r[keep], score[keep]


def _met(longest: float, same: bool, n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["a", "ps", "id", "score"]
        if not (left.num_rows and right.num_rows):
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        num = lambda t, c: t.column(c).to_numpy()
        v, near, lo, hi, ps = (_matrix(left.column(c), kind) for c, kind in (("v", np.float64), ("near", np.float32), ("lo", np.float64), ("hi", np.float64), ("ps", np.int64)))
        x, far = _matrix(right.column("v")), _matrix(right.column("far"), np.float32)
        a, k, r, score = search_slice(v, near, num(left, "id"), num(left, "label"), lo, hi, x, far, num(right, "id"), num(right, "label"), longest, same, n)
        return pa.table([pa.array(num(left, "a")[a]), pa.array(ps[a, k]), pa.array(num(right, "id")[r]), pa.array(score.astype(np.int64))], names=names)

    return run


def _integers(vector: Column, scale: float) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(scale * x).cast("double"))


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not empty, and all its components are finite numbers."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def mine(vectors: DataFrame, anchors: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 3, shares: tuple[int, int] = (50, 95), scale: float = 256.0, pivots: int = PIVOTS, sample_rows: int = SAMPLE_ROWS, slice_rows: tuple[int, int] = SLICE_ROWS) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (int, from 1), ``negative_id``, ``positive_score``, ``negative_score``.

    A component x becomes floor(scale * x); a score is the integer inner product; higher comes first, ties
    by smaller id.  An anchor's positives are its first ``positives`` rows of its label and another id; a
    positive's negatives are the first ``negatives`` rows of another label whose score is, in
    percent of the positive's, within ``shares`` (compared in integers; so none if it is negative).

    Rows with a null id, a null label, a null or empty vector or a component that is null or not finite take
    no part.  Vectors of unequal length, and components too large for exact sums in double precision, are
    errors.  Rows that repeat an id are candidates of their own; equal anchor rows ask once.  Anchors
    without positives, and positives without negatives, have no rows.  Other columns are ignored,
    whatever their names.  Empty tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), _integers(F.col(vector), scale).alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, short, long_, longest = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v")), F.max(square)).first()
    if total and short != long_:
        raise ValueError(f"vectors have from {short} to {long_} components; all must have as many")
    if total and longest >= 2.0**53:
        raise ValueError("components are too large for exact scores; choose a smaller scale")
    rows = rows.withColumn("v", F.col("v").cast("array<int>"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not total:
        return spark.createDataFrame([], schema)
    size = min(max(total // 64, slice_rows[0]), slice_rows[1])
    rings = max(1, min(GROUPS, total // size) // pivots)
    sample = rows.orderBy(F.xxhash64("id", "v"), "id").limit(sample_rows).select("id", "label", "v").toArrow()
    known = (sample.column("id").to_numpy(), sample.column("label").to_numpy(), _matrix(sample.column("v")))
    chosen = choose(known[2], longest, pivots, rings)
    table = handed_over(in_arrow(rows, _stored(spark.sparkContext.broadcast(chosen)), "id long, label long, asks boolean, v array<int>, far array<float>, grp int"))
    of = range(len(chosen.x))
    facts = table.groupBy("grp").agg(F.count("*").alias("n"), *[f(F.col("far")[j]).alias(f"{f.__name__}{j}") for f in (F.min, F.max) for j in of]).orderBy("grp").toArrow()
    bound = lambda f: np.stack([facts.column(f"{f}{j}").to_numpy() for j in of], axis=1).astype(np.float64)
    groups, counts = facts.column("grp").to_numpy(), facts.column("n").to_numpy()
    slices = -(-counts // size)
    shared = spark.sparkContext.broadcast((chosen, groups, slices, bound("min"), bound("max"), known))
    cut = F.broadcast(spark.createDataFrame([(int(g), int(s)) for g, s in zip(groups, slices, strict=True)], "grp int, slices int"))  # at most GROUPS rows
    asking = table.where("asks").select("id", "label", "v").distinct().select(F.monotonically_increasing_id().alias("a"), "id", "label", "v")
    asking = handed_over(asking)
    parts = max(1, -(-asking.count() // PART_ANCHORS))
    held = table.withColumn("salt", F.monotonically_increasing_id()).join(cut, "grp").select("grp", F.pmod("salt", "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "label", "v", "far")
    keys = ("grp", "slice", "part")
    kind = "grp int, slice int, part int, a long, id long, label long, v array<int>, near array<float>, ps array<long>, lo array<double>, hi array<double>"

    def first(asked: DataFrame, same: bool, n: int) -> DataFrame:
        """(a, ps, id, score, place): the first ``n`` rows of each anchor and band."""
        sent = in_arrow(asked.select("a", "id", "label", "v", "ps", "lo", "hi"), _sent(shared, same, n, parts), kind)
        met = sent.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_met(longest, same, n), "a long, ps long, id long, score long")
        place = F.row_number().over(Window.partitionBy("a", "ps").orderBy(F.desc("score"), "id"))
        return met.withColumn("place", place).where(F.col("place") <= n)

    every = asking.select("*", F.array(F.lit(0).cast("long")).alias("ps"), F.array(F.lit(float("-inf"))).alias("lo"), F.array(F.lit(float("inf"))).alias("hi"))
    near = handed_over(first(every, True, positives).select("a", F.col("id").alias("positive_id"), F.col("score").alias("ps")))
    bands = near.groupBy("a").agg(F.sort_array(F.collect_set("ps"), False).alias("ps"))  # at most ``positives`` scores
    down = lambda x: ((x - F.pmod(x, F.lit(100))) / 100).cast("double")  # exact: a multiple of 100 is divided
    pad = lambda f, rest: F.concat(F.transform("ps", f), F.array_repeat(F.lit(rest), F.lit(positives) - F.size("ps")))
    lo, hi = pad(lambda p: -down(-p * shares[0]), float("inf")), pad(lambda p: down(p * shares[1]), float("-inf"))
    asked = asking.join(bands, "a").withColumns({"lo": lo, "hi": hi}).withColumn("ps", F.concat("ps", F.array_repeat(F.lit(0).cast("long"), F.lit(positives) - F.size("ps"))))
    far = first(asked, False, negatives).select("a", "ps", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(asking.select("a", F.col("id").alias("anchor_id")), "a").join(far, ["a", "ps"])
    return named.select("anchor_id", "positive_id", "rank", "negative_id", F.col("ps").alias("positive_score"), "negative_score")


ORACLE_SQL = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
