"""Bootstrap by exact multinomial counts over the histogram of values.

A resample of n observed rows holds each distinct value a number of times, and those numbers are
multinomial.  They are drawn value by value, each as a binomial of what is left, by inversion of its
distribution at a uniform number.  So the work is resamples x distinct values whatever the number of
rows, no row is numbered, and every row can be drawn any number of times.

Uniform numbers are digits of an MD5 over (seed, group, resample, block, value's place): any engine
makes the same ones, and a lost task draws them again.  Values are dealt to blocks by
hash; a first multinomial gives each block its share of a resample's rows, a second one the
values of a block, so that no task holds all the values of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Resamples of a task, distinct values that a block is meant to hold, numbers of a slab of distributions.
CHUNK, BLOCK_VALUES, SLAB = 256, 2_048, 1 << 21
#: Hex digits of a uniform number; standard deviations around its mean that a binomial's distribution is written out for.
DIGITS, REACH = 13, 9


def uniforms(seed: int, group, resamples: np.ndarray, block: int, place: int) -> np.ndarray:
    """One number inside (0, 1) for each resample."""
    name = "" if group is None else group
    made = [int(hashlib.md5(f"{seed}|{name}|{r}|{block}|{place}".encode(), usedforsecurity=False).hexdigest()[:DIGITS], 16) for r in resamples.tolist()]
    return (np.array(made, dtype=np.float64) + 0.5) / 16.0**DIGITS


def binomial(u: np.ndarray, m: np.ndarray, p: float) -> np.ndarray:
    """The smallest k whose binomial distribution function (``m`` trials, share ``p``) reaches ``u``, for each pair of ``u`` and ``m``.

    The distribution is the running sum of ratios of neighbouring terms, in logarithms, within
    ``REACH`` standard deviations (and 12) of the mean: beyond lies less than double precision tells.
    """
    if p <= 0 or p >= 1:
        return m * (p >= 1)
    out = np.zeros(len(u), np.int64)
    trials, of = np.unique(m, return_inverse=True)
    reach = REACH * np.sqrt(trials * p * (1 - p)) + 12
    first = np.maximum(0, np.floor(trials * p - reach)).astype(np.int64)
    wide = (np.minimum(trials, np.ceil(trials * p + reach)).astype(np.int64) - first).max() if len(trials) else 0
    odds, order = np.log(p / (1 - p)), np.argsort(of, kind="stable")
    begin = np.searchsorted(of[order], np.arange(len(trials) + 1))
    step = max(1, SLAB // (wide + 1))
    for i in range(0, len(trials), step):
        t, low = trials[i : i + step, None], first[i : i + step, None]
        j = low + np.arange(1, wide + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(j <= t, np.log((t - j + 1) / j) + odds, -np.inf)
        log = np.concatenate([np.zeros((len(t), 1)), np.cumsum(gain, axis=1)], axis=1)
        cdf = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
        cdf /= cdf[:, -1:]
        for k in range(len(t)):
            rows = order[begin[i + k] : begin[i + k + 1]]
            out[rows] = first[i + k] + np.searchsorted(cdf[k], u[rows], side="left")
    return np.minimum(out, m)


def multinomial(m: np.ndarray, counts: np.ndarray, draw) -> Iterator[np.ndarray]:
    """How often each cell of ``counts`` occurs among ``m`` draws (one number a resample); ``draw(j)`` gives the j-th cell's uniform numbers."""
    left, rest = m.copy(), counts.sum()
    for j, c in enumerate(counts.tolist()):
        got = left.copy() if j == len(counts) - 1 else binomial(draw(j), left, c / rest)
        yield got
        left, rest = left - got, rest - c


def histogram(observed: DataFrame, group: str = "group", value: str = "value") -> DataFrame:
    """(group, value, n) of the values that are neither null nor NaN."""
    v = F.col(value).cast("double")
    return observed.select(F.col(group).cast("string").alias("group"), (v + F.lit(0.0)).alias("value")).where(F.col("value").isNotNull() & ~F.isnan("value")).groupBy("group", "value").agg(F.count("*").alias("n"))


def bootstrap_means(counts: DataFrame, resamples: int = 10_000, seed: int = 42, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(group, resample, mean): means of samples with replacement, as many rows as the group has, from a histogram (group, value, n).

    Groups without values have no rows; a null group is one of its own (named as the empty one for its draws).
    """
    named = lambda df: df.withColumnRenamed("group", "g")
    same = F.col("group").eqNullSafe(F.col("g"))
    sizes = named(counts.groupBy("group").agg(F.ceil(F.count("*") / block_values).alias("blocks")))
    dealt = counts.join(sizes, same).select("group", "value", "n", F.pmod(F.xxhash64("value"), F.col("blocks")).alias("block"))
    blocks = dealt.groupBy("group", "block").agg(F.sort_array(F.collect_list(F.struct("value", "n"))).alias("cells"), F.sum("n").alias("total"))
    blocks = blocks.select("group", "block", F.col("cells.value").alias("values"), F.col("cells.n").alias("counts"), "total")
    roots = blocks.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("block", "total"))).alias("b"))
    roots = roots.select("group", F.col("b.block").alias("blocks"), F.col("b.total").alias("totals"), F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // CHUNK) - 1))).alias("chunk"))
    roots = roots.repartition("group", "chunk")
    of = lambda chunk: np.arange(chunk * CHUNK, min((chunk + 1) * CHUNK, resamples))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, ids, totals, chunk in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows, totals = of(chunk), np.array(totals)
                drawn = multinomial(np.full(len(rows), totals.sum()), totals, lambda j, g=group, r=rows: uniforms(seed, g, r, -1, j))
                made = [(i, x) for i, x in zip(ids, drawn, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(made), pa.string()), pa.array([i for i, _ in made], pa.int64()), pa.array([chunk] * len(made), pa.int32()), pa.array([x.tolist() for _, x in made], pa.list_(pa.int64())), pa.array([int(totals.sum())] * len(made), pa.int64())], names=["group", "block", "chunk", "m", "size"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, block, chunk, m, size, values, counts_ in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                rows = of(chunk)
                total = np.zeros(len(rows))
                for v, got in zip(values, multinomial(np.array(m), np.array(counts_), lambda j, g=group, r=rows, k=block: uniforms(seed, g, r, k, j)), strict=True):
                    total += v * got
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(rows), pa.string()), pa.array(rows), pa.array([size] * len(rows), pa.int64()), pa.array(total)], names=["group", "resample", "size", "total"])

    drawn = roots.mapInArrow(shares, "group string, block long, chunk int, m array<long>, size long")
    cells = named(blocks).select("g", F.col("block").alias("k"), "values", "counts")
    met = drawn.join(cells, same & (F.col("block") == F.col("k"))).select("group", "block", "chunk", "m", "size", "values", "counts")
    parts = met.repartition("group", "block", "chunk").mapInArrow(sums, "group string, resample long, size long, total double")
    return parts.groupBy("group", "resample", "size").agg(F.sum("total").alias("total")).select("group", "resample", (F.col("total") / F.col("size")).alias("mean"))


def intervals(observed: DataFrame, group: str = "group", value: str = "value", resamples: int = 10_000, seed: int = 42, level: float = 0.95, block_values: int = BLOCK_VALUES) -> DataFrame:
    """(group, n, estimate, lower, upper, p_value): each group's observed mean, the interval of its resampled means (linear
    interpolation), and twice the share of them on the other side of zero or at it, at most 1.

    For the paired difference of two measures, ``value`` is the difference within a row: both sides then
    have the same rows in every resample.
    """
    counts = histogram(observed, group, value)
    seen = counts.groupBy("group").agg(F.sum("n").alias("n"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("estimate"))
    tail = (1 - level) / 2
    means = bootstrap_means(counts, resamples, seed, block_values)
    q = means.groupBy("group").agg(F.percentile("mean", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"), F.avg((F.col("mean") <= 0).cast("double")).alias("below"), F.avg((F.col("mean") >= 0).cast("double")).alias("above"))
    other = F.when(F.col("estimate") >= 0, F.col("below")).otherwise(F.col("above"))
    return seen.join(q.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g"))).select("group", "n", "estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), F.least(F.lit(1.0), 2 * other).alias("p_value"))


def verdict(lower: Column, upper: Column) -> Column:
    """What an interval of a difference says."""
    return F.when(lower > 0, "first higher").when(upper < 0, "second higher").otherwise("not significant")


def sql_binomial(name: str, draws: str, seed_place: str) -> str:
    """CTE ``name`` (grp, resample, k) for ``draws`` (grp, resample, m, p): the same draws in DuckDB SQL."""
    reach = f"({REACH} * sqrt(m * p * (1 - p)) + 12)"
    return f"""{name}_t AS (SELECT grp, m, p, greatest(0, floor(m * p - {reach}))::BIGINT AS low, least(m, ceil(m * p + {reach}))::BIGINT AS high FROM (SELECT DISTINCT grp, m, p FROM {draws}) WHERE p > 0 AND p < 1),
{name}_j AS (SELECT *, unnest(range(low, high + 1)) AS j FROM {name}_t),
{name}_l AS (SELECT *, sum(CASE WHEN j = low THEN 0.0 ELSE ln((m - j + 1)::DOUBLE / j) + ln(p / (1 - p)) END) OVER (PARTITION BY grp, m ORDER BY j) AS l FROM {name}_j),
{name}_w AS (SELECT *, exp(l - max(l) OVER (PARTITION BY grp, m)) AS w FROM {name}_l),
{name}_c AS (SELECT grp, m, j, sum(w) OVER (PARTITION BY grp, m ORDER BY j) / sum(w) OVER (PARTITION BY grp, m) AS c FROM {name}_w),
{name}_u AS (SELECT *, (('0x' || substr(md5('42|' || grp || '|' || resample || '|0|' || {seed_place}), 1, {DIGITS}))::BIGINT + 0.5) / pow(16.0, {DIGITS}) AS u FROM {draws}),
{name} AS (SELECT a.grp, a.resample, CASE WHEN a.p <= 0 THEN 0 WHEN a.p >= 1 THEN a.m ELSE (SELECT min(j) FROM {name}_c c WHERE c.grp = a.grp AND c.m = a.m AND c.c >= a.u) END::BIGINT AS k FROM {name}_u a)"""
