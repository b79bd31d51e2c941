import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import mixing


def water(sizes, weights, share=1.5, most=2.0):
    """Targets by resharing until none is above its limit."""
    total, full, level = share * sum(sizes), set(), 0.0
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        if not rest:
            break
        level = (total - sum(most * sizes[i] for i in full)) / sum(weights[i] for i in rest)
        over = [i for i in rest if level * weights[i] > most * sizes[i] * (1 + 1e-12)]
        if not over:
            break
        full |= set(over)
    return [most * s if i in full else level * w for i, (s, w) in enumerate(zip(sizes, weights, strict=True))]


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_resharing(spark, seed):
    rng = np.random.default_rng(seed)
    names = sorted({f"s{i}" for i in rng.integers(0, 60, 17)}) + [None]
    sizes = rng.integers(1, 5000, len(names)).tolist()
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert np.allclose([got[n] for n in names], want)
    assert abs(sum(got.values()) - 1.5 * sum(sizes)) < 1e-6 * sum(sizes)


def test_pair_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    for _ in range(200):
        f, g = rng.random(2) * 0.98 + 0.01
        a, b = rng.integers(1, 50, 2)
        draws = (np.arange(400) + 0.5) / 400
        out = np.array([mixing.pair(f, a, g, b, d) for d in draws])
        assert np.allclose(out @ [a, b], f * a + g * b)
        assert (np.isclose(out, 0) | np.isclose(out, 1)).any(axis=1).all()
        assert np.allclose(out.mean(axis=0), [f, g], atol=0.01)


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("w" * 1 for _ in range(int(rng.integers(0, 30)))), f"s{i % 7}" if i % 3 else "hot", 1) for i in range(900)]
    rows += [(1000, None, "s1", 1), (1001, "", None, 1), (1002, "a b c", None, 1), (None, "x y", "s2", 1), (None, "x y", "s2", 1), (None, "x y", "s2", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies_size int")
    got = mixing.mix(df, groups=128)
    assert got.columns == ["doc_id", "text", "source", "copies_size", "copies", "copies_size_", "copies_source_size", "copies_target"]
    out = got.collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, target, most = {}, {}, {}
    for r in out:
        assert r.copies in (0, 1, 2) and (size(r.text) or r.copies == 0)
        taken[r.source] = taken.get(r.source, 0) + r.copies * size(r.text)
        target[r.source], most[r.source] = r.copies_target, max(most.get(r.source, 0), size(r.text))
    for s in taken:
        assert abs(taken[s] - target[s]) <= most[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(7), groups=128)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))
    assert mixing.mix(df.where("false")).count() == 0
    assert {r.copies for r in mixing.mix(df.where(F.length(F.coalesce("text", F.lit(""))) == 0)).collect()} == {0}


def test_query_on_all_documents(spark, data):
    from siltstone.llm.queries import op5_mixing

    out = op5_mixing(spark, data).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(out) == len(docs)
    sizes, taken, target = {}, {}, {}
    for r in out:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and r.taken in (0, r.size, 2 * r.size)
        for x, n in ((sizes, r.size), (taken, r.taken)):
            x[d.source] = x.get(d.source, 0) + n
        target[d.source] = r.target
    names = sorted(n for n in sizes if n is not None) + [n for n in sizes if n is None]
    want = water([sizes[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert np.allclose([target[n] for n in names], want) and all(r.source_size == sizes[docs[r.doc_id].source] for r in out)
    most = max(r.size for r in out)
    assert all(abs(taken[n] - target[n]) <= most / 2 for n in names)


def test_streams_follow_the_rows():
    assert mixing._groups(0) == 64 and 10**9 / 2048 <= mixing._groups(10**9) <= 10**9 / 1024
