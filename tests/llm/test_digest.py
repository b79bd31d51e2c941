"""Fingerprints of improbable windows: parts against plain loops, edits against brute force, odd rows."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siltstone.llm import digest, queries
from siltstone.llm.common import bytes_of


def plain_entropy(x: bytes) -> float:
    p = np.bincount(np.frombuffer(x, np.uint8)) / len(x)
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / np.log2(len(x)) * digest.STEPS)


def plain_features(x: bytes, ranks) -> list[tuple[int, int]]:
    """(start, length), by loops over one text."""
    w, (neighbours, points) = digest.WINDOW, next((n, p) for least, n, p in digest.RUNS if len(x) >= least)
    if not x:
        return []
    if len(x) < w:
        return [(0, len(x))]
    e = digest.entropies(np.frombuffer(x, np.uint8))
    key = [(int(ranks[v]), i) for i, v in enumerate(e)]
    if len(x) < w + 7:
        return [(min(key)[1], w)]
    won: dict[bytes, tuple[int, int]] = {}
    for i in range(len(key) - neighbours + 1):
        at = min(key[i : i + neighbours])[1]
        same = x[at : at + w]
        first, n = won.get(same, (at, 0))
        won[same] = (min(first, at), n + 1)
    return sorted((i, w) for i, n in won.values() if n >= points)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9))) for _ in range(300)] + ["ünï", "日本"]
    some = [" ".join(rng.choice(words, n)) for n in (400, 3, 1, 60, 0, 5, 2000, 8, 4, 30, 0, 120)]
    return [*some, some[0], "a" * 500, "xy"]


def test_windows_and_features_equal_plain_loops(texts):
    data, off = bytes_of(pa.array(texts))
    e = digest.entropies(data)
    raw = data.tobytes()
    assert all(abs(e[i] - plain_entropy(raw[i : i + digest.WINDOW])) <= 1 for i in range(0, len(e), 7))
    ranks = digest.rarity(np.bincount(e[digest._inside(off, digest.WINDOW, len(e))], minlength=digest.STEPS + 1))
    t, at, size, h = digest.features(data, off, ranks)
    for i, x in enumerate(texts):
        mine = t == i
        assert list(zip((at[mine] - off[i]).tolist(), size[mine].tolist(), strict=True)) == plain_features(x.encode(), ranks), i


def test_blocks_do_not_matter(texts, monkeypatch):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    whole = digest.entropies(data)
    monkeypatch.setattr(digest, "BLOCK", 97)
    assert (digest.entropies(data) == whole).all()


def test_filters_hold_every_feature_and_chain(texts):
    data, off = bytes_of(pa.array(texts))
    ranks = digest.rarity(np.ones(digest.STEPS + 1, np.int64))
    t, at, size, h = digest.features(data, off, ranks)
    chains = digest.digests(data, off, ranks)
    for i, chain in enumerate(chains):
        mine = h[t == i]
        assert len(chain) == -(-len(mine) // digest.FEATURES) and len(set(mine.tolist())) == len(mine)
        bits = np.zeros((len(chain), digest.BITS), bool)
        for k, x in enumerate(mine.tolist()):
            for j in range(digest.HASHES):
                bits[k // digest.FEATURES, (x >> 11 * j) % digest.BITS] = True
        assert (np.unpackbits(chain, axis=1, bitorder="little").astype(bool) == bits).all()
    assert max(map(len, chains)) > 1


def test_likeness(texts):
    ranks = digest.rarity(np.ones(digest.STEPS + 1, np.int64))
    make = lambda *x: digest.digests(*bytes_of(pa.array(x)), ranks)
    long_, other = texts[6], " ".join(reversed(texts[6].split()))
    a, b, half, none, none2 = make(long_, other, long_[: len(long_) // 2] + other[: len(long_) // 2], "", "")
    assert digest.likeness(a, a) == 1 and digest.likeness(none, none2) == 1 and digest.likeness(a, none) == 0
    assert digest.likeness(a, half) == digest.likeness(half, a) and 0.35 < digest.likeness(a, half) < 0.75
    assert digest.likeness(a, b) < 0.1
    assert digest.likeness(*make(long_, long_[: len(long_) // 4])) > 0.6  # contained in the longer one


def test_edits_over_odd_rows(spark, texts):
    rows = [(i * 3, x, 0) for i, x in enumerate(texts)] + [(None, "without an id " * 9, 1), (None, None, 2), (6, "again " * 40, 3), (6, "again " * 40, 4), (7, "\U0001f600é" * 31, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near_next int").repartition(5)
    got = digest.with_edits(docs).collect()
    order = sorted(((k is not None, k or 0, x or "") for k, x, _ in rows), key=lambda r: (r[0], r[1], np.int64(np.uint64(xxhash.xxh64(r[2].encode(), seed=42).intdigest()).astype(np.int64)), r[2]))
    want = []
    for i, (_, k, x) in enumerate(order):
        y, h = order[(i + 1) % len(order)][2], len(x) // 2
        want.append((k if order[i][0] else None, len(x), hashlib.sha256((x[: len(x) - h] + y[:h]).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.n_chars, r.edited_sha256)) for r in got)
    by: dict = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by.setdefault((r.doc_id, r.n_chars), set()).add(bytes(r.fingerprint))
    assert by[(0, len(texts[0]))] == by[(36, len(texts[0]))]  # equal texts
    assert digest.with_edits(docs.where("false")).collect() == []
    one = digest.with_edits(spark.createDataFrame([(1, "alone " * 50)], "doc_id int, text string")).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 300)]


def test_fingerprint_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 80, 7), (1, "word " * 80, 7), (2, None, 8)], "doc_id int, text string, Fingerprint int")
    got = digest.fingerprint(docs).orderBy("doc_id").collect()
    assert got[0].asDict() == got[1].asDict() and set(got[0].asDict()) == {"doc_id", "text", "fingerprint"} and bytes(got[2].fingerprint) == b""
    assert digest.fingerprint(docs.where("false")).count() == 0


def test_query(spark, data):
    """The half that stays is found again; the next document is not."""
    rows = queries.op11_improbable_digest(spark, data).collect()
    counts = digest.count_entropies(spark.read.parquet(f"{data}/documents.parquet"))
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    ranks, got = digest.rarity(counts), {r.doc_id: r for r in rows}
    assert len(rows) == len(docs)
    for i, (k, x) in enumerate(docs):
        y = docs[(i + 1) % len(docs)][1]
        edited = digest.halves(x, y)
        a, b, c = digest.digests(*bytes_of(pa.array([x, edited, y])), ranks)
        r = got[k]
        assert (r.fingerprint, r.edited_fingerprint, r.n_chars) == (a.tobytes().hex(), b.tobytes().hex(), len(x))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == digest.likeness(a, b) and r.near_next == digest.likeness(a, c)
        if len(x.encode()) > 200 and x != y:
            assert r.near_edited > 0.2 > r.near_next
