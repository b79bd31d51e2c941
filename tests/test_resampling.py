"""The bootstrap against theory: spread, shares, distinct rows; its pieces against exact distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import resampling


def test_binomial_is_the_exact_inverse():
    rng = np.random.default_rng(1)
    u, m = rng.uniform(size=600), rng.integers(0, 40, 600)
    for p in (0.03, 0.5, 0.91):
        for x, n, k in zip(u, m, resampling.binomial(u, m, p), strict=True):
            cdf = np.cumsum([math.comb(int(n), i) * p**i * (1 - p) ** (int(n) - i) for i in range(int(n) + 1)])
            assert cdf[k] >= x - 1e-12 and (k == 0 or cdf[k - 1] <= x + 1e-12)
    assert resampling.binomial(u, m, 0.0).tolist() == [0] * 600 and (resampling.binomial(u, m, 1.0) == m).all()
    big = resampling.binomial(u, np.full(600, 10**9), 0.25)
    assert abs(big.mean() / 2.5e8 - 1) < 1e-5 and len(set(big.tolist())) > 590


def test_slabs_do_not_matter(monkeypatch):
    rng = np.random.default_rng(2)
    u, m = rng.uniform(size=300), rng.integers(0, 500, 300)
    whole = resampling.binomial(u, m, 0.3)
    monkeypatch.setattr(resampling, "SLAB", 100)
    assert (resampling.binomial(u, m, 0.3) == whole).all()


@pytest.mark.parametrize("n", [80, 1_000, 100_000, 10_000_000])
def test_spread_is_the_theory(spark, n):
    """A measure that is 1 in three of ten rows: the standard error of its mean, and an interval as wide as theory says."""
    rows = spark.range(n).select(F.lit("g").alias("group"), (F.col("id") % 10 < 3).cast("int").alias("value"))
    counts = resampling.histogram(rows)
    means = np.array([r["mean"] for r in resampling.bootstrap_means(counts).collect()])
    error = math.sqrt(0.3 * 0.7 / n)
    assert len(means) == 10_000 and abs(means.std() / error - 1) < 0.03 and abs(means.mean() - 0.3) < 4 * error / 100
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs((high - low) / (2 * 1.96 * error) - 1) < 0.06


def test_every_value_is_drawn_as_often_as_theory_says(spark):
    """As many values as rows, over several blocks: each resample holds n rows, and .632 of them distinct."""
    n, resamples = 600, 300
    values = [float(3**0.5 * i) for i in range(n)]
    counts = resampling.histogram(spark.createDataFrame([("g", v) for v in values], "group string, value double"))
    means = np.array([r["mean"] for r in resampling.bootstrap_means(counts, resamples, block_values=64).collect()])
    assert abs(means.std() / (np.std(values) / math.sqrt(n)) - 1) < 0.15
    cells = np.ones(n, np.int64)
    u = np.random.default_rng(3).uniform(size=(n, 50))
    drawn = np.array(list(resampling.multinomial(np.full(50, n), cells, lambda j: u[j])))
    assert (drawn.sum(axis=0) == n).all() and abs((drawn > 0).mean() - (1 - (1 - 1 / n) ** n)) < 0.01
    assert abs(drawn.var() - (1 - 1 / n)) < 0.05


def test_paired_differences_share_their_rows(spark):
    """Measures that differ in one row of a hundred: the paired interval is far narrower than that of either."""
    rows = spark.range(1000).select(F.lit("d").alias("group"), (F.col("id") % 2).alias("a"), F.when(F.col("id") % 100 == 0, 1 - F.col("id") % 2).otherwise(F.col("id") % 2).alias("b"))
    paired = resampling.intervals(rows.withColumn("value", F.col("a") - F.col("b")), resamples=2000).first()
    alone = resampling.intervals(rows.withColumn("value", F.col("a")), resamples=2000).first()
    assert paired.upper - paired.lower < 0.3 * (alone.upper - alone.lower)
    assert paired.estimate == -0.01 and paired.upper < 0 and paired.p_value < 0.01
    error = math.sqrt(0.01 * 0.99 / 1000)
    assert abs((paired.upper - paired.lower) / (3.92 * error) - 1) < 0.1


def test_odd_rows(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), (None, 2.0), (None, 4.0), ("c", None), ("a", 1.0)], "group string, value double")
    got = {r["group"]: (r.n, r.estimate, r.lower, r.upper) for r in resampling.intervals(rows, resamples=500).collect()}
    assert got["a"] == (2, 1.0, 1.0, 1.0) and got[None][:2] == (2, 3.0) and got[None][2:] == (2.0, 4.0) and set(got) == {"a", None}
    assert resampling.intervals(rows.where("false"), resamples=10).count() == 0
    again = {r["group"]: (r.n, r.estimate, r.lower, r.upper) for r in resampling.intervals(rows.repartition(3), resamples=500).collect()}
    assert again == got
