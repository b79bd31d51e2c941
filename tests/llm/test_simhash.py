import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def parts(fps, radius=2):
    left, out = set(fps), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            edge += near
        out.append(sorted(group))
    return sorted(out)


def joined(links, fps):
    at = {f: f for f in fps}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        at[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), []).append(f)
    return sorted(map(sorted, groups.values()))


def clustered(n, seed, flips=4):
    rng, out = np.random.default_rng(seed), set()
    base = rng.integers(-(2**63), 2**63, max(1, n // 8), dtype=np.int64)
    while len(out) < n:
        x = int(base[rng.integers(len(base))])
        for b in rng.integers(0, 63, rng.integers(0, flips + 1)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


TEXTS = ["", None, "  \n", "One", "one TWO", "a b c", "A  b\tC d É é", "x " * 5000, "  nbsp is no space", "ÀB àb"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("n", [2, 63, 64, 65, 300])
def test_bit_sliced_blocks(n):
    fps = clustered(n, n)
    want = [[f] if len(g) == 1 else g for g in parts([f & (2**64 - 1) for f in fps]) for f in g[:1]]
    signed = sorted(sorted(x - 2**64 if x >= 2**63 else x for x in g) for g in want)
    a = np.array(fps, dtype=np.int64)
    assert joined(simhash.compare_block(a, step=17), fps) == signed
    if n <= 64:
        assert joined(simhash.compare_small([a, a[:1], a[:2]]), fps) == signed


@pytest.mark.parametrize("cap", [4096, 3])
def test_links_lose_nothing_even_when_blocks_are_cut(spark, cap):
    fps = clustered(150, 5, 3)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), cap=cap).collect()]
    want = sorted(sorted(x - 2**64 if x >= 2**63 else x for x in g) for g in parts([f & (2**64 - 1) for f in fps]))
    assert joined(got, fps) == want


def test_documents(spark):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice([f"v{i}" for i in range(400)], 300)) for _ in range(6)]
    rows = [(i, base[i % 6] + (" more" if i % 4 == 0 else ""), "z") for i in range(40)] + [(50 + i, t, None) for i, t in enumerate(TEXTS)] + [(None, base[0], "n"), (None, "alone here now", "n"), (7, base[1], "z"), (7, base[1], "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    docs = df.withColumnRenamed("fp", "least")
    out = simhash.near_duplicates(docs).collect()
    fp = {(i, t): plain_fingerprint(t) for i, t, _ in rows}
    group = {f: g[0] for g in parts(set(fp.values())) for f in g}
    least = {}
    for (i, t), f in fp.items():
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    want = [(i, fp[i, t], least.get(group[fp[i, t]])) for i, t, _ in rows]
    assert sorted(map(str, ((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out))) == sorted(map(str, want))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert len(got) == len(set(group.values()))
    assert {r.doc_id for r in got if r.doc_id is not None} == set(least.values())
    assert simhash.keep_one(df.where("false")).count() == 0
    assert simhash.keep_one(df.where(F.col("doc_id") == 7)).count() == 1
