"""Hard negatives: brackets hold, slices equal plain search, odd rows, the whole against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import negatives


def plain(rows, every=5, n_pos=5, n_neg=3):
    """What ``mine`` gives, by loops; rows (id, label, vector) that take part."""
    v = {i: [int(np.floor(256 * float(x))) for x in r[2]] for i, r in enumerate(rows)}
    out = []
    for a in {(r[0], r[1], tuple(v[i])) for i, r in enumerate(rows) if r[0] % every == 0}:
        scored = [(sum(x * y for x, y in zip(a[2], v[i], strict=True)), r[0], r[1]) for i, r in enumerate(rows)]
        order = sorted(scored, key=lambda s: (-s[0], s[1]))
        for p in [s for s in order if s[2] == a[1] and s[1] != a[0]][:n_pos]:
            near = [s for s in order if s[2] != a[1] and 50 * p[0] <= 100 * s[0] <= 95 * p[0]][:n_neg]
            out += [(a[0], p[1], k + 1, s[1], p[0], s[0]) for k, s in enumerate(near)]
    return sorted(out)


def test_brackets_hold():
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(400, 12)) * rng.uniform(0.1, 3, (400, 1)))
    longest = float((x**2).sum(axis=1).max())
    p = negatives.choose(x[:100], longest, 9, 3)
    far, near = p.of_rows(x).astype(np.float32), p.of_anchors(x[:40])
    whole = (x[:40] ** 2).sum(axis=1) + longest
    lower, upper = negatives.bracket(near, far, far, whole)
    score = x[:40] @ x.T
    assert (lower <= score).all() and (score <= upper).all()
    exact = np.sqrt(((x[:40, None] - p.x) ** 2).sum(axis=2) + p.more**2)
    assert np.allclose(near, exact)
    g = p.groups(p.of_rows(x))
    for one in np.unique(g):
        low, high = negatives.bracket(near, far[g == one].min(axis=0)[None], far[g == one].max(axis=0)[None], whole)
        assert (low <= score[:, g == one]).all() and (score[:, g == one] <= high).all()


def test_clustered_rows_are_ruled_out():
    """Where vectors lie in clusters, most groups need no anchor."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 32)) * 100
    x = np.floor(np.repeat(centres, 60, axis=0) + rng.normal(size=(960, 32)) * 3)
    longest = float((x**2).sum(axis=1).max())
    p = negatives.choose(x, longest, 16, 1)
    g, far, near = p.groups(p.of_rows(x)), p.of_rows(x), p.of_anchors(x[::60])
    ids = np.unique(g)
    low, high = (np.stack([f(far[g == i], axis=0) for i in ids]) for f in (np.min, np.max))
    fifth = np.sort(x[::60] @ x.T, axis=1)[:, -5]
    upper = negatives.bracket(near, low, high, (x[::60] ** 2).sum(axis=1) + longest)[1]
    assert (upper >= fifth[:, None]).mean() < 0.3


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, grp string, a int").repartition(3)


@pytest.mark.parametrize("slices", [(512, 16_384), (7, 7)])
def test_mine_equals_plain_search(spark, slices):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-6, 7, 6) / 16).tolist()) for i in range(180)]
    rows += [(200, 1, rows[0][2]), (205, 1, rows[0][2]), (205, 1, rows[0][2]), (11, 2, [0.0] * 6)] + [(300 + i, 0, rows[5][2]) for i in range(60)]
    odd = [(None, 1, rows[1][2]), (400, None, rows[1][2]), (405, 1, None), (410, 1, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (415, 1, [float("nan")] * 6), (420, 1, [float("inf")] * 6), (425, 1, [])]
    df = make(spark, [(*r, "x", 1) for r in rows + odd])
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, slice_rows=slices, sample_rows=40, pivots=5)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_few_rows_and_errors(spark):
    one = make(spark, [(0, 1, [0.5, 0.5], "", 0)])
    assert negatives.mine(one, F.col("vec_id") % 5 == 0).collect() == []
    assert negatives.mine(one.where("false"), F.lit(True)).collect() == []
    two = make(spark, [(0, 1, [0.5, 0.5], "", 0), (1, 1, [0.5, 0.25], "", 0), (2, 2, [0.25, 0.25], "", 0), (3, 2, [-0.5, 0.0], "", 0)])
    assert [tuple(r) for r in negatives.mine(two, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 2, 24576, 16384)]
    assert negatives.mine(two, F.lit(None).cast("boolean")).collect() == []
    with pytest.raises(ValueError, match="components"):
        negatives.mine(make(spark, [(0, 1, [0.5], "", 0), (1, 1, [0.5, 1.0], "", 0)]), F.lit(True))
    with pytest.raises(ValueError, match="too large"):
        negatives.mine(make(spark, [(0, 1, [1e9], "", 0)]), F.lit(True))
