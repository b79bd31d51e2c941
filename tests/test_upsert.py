"""Keyed appends: whole or not at all, once a batch, whoever else writes."""

import pytest
from pyspark.sql import functions as F

from siltstone.sources import files, upsert

SCHEMA = "k long, v string"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(spark, path):
    return sorted((r.k, r.v) for r in upsert.read(spark, path, SCHEMA).collect())


def test_first_of_repeats_and_report(spark, tmp_path):
    p = str(tmp_path / "t")
    assert held(spark, p) == []
    got = upsert.upsert(rows(spark, (1, "b"), (1, "a"), (2, "x"), (None, "n")), p, "k", "one", F.col("v"))
    assert held(spark, p) == [(1, "a"), (2, "x")] and (got["rows"], got["inserted"], got["known"], got["repeats"], got["without_key"]) == (4, 2, 0, 1, 1)
    upsert.upsert(rows(spark, (2, "y"), (3, "z")), p, "k", "two")
    assert held(spark, p) == [(1, "a"), (2, "x"), (3, "z")]
    upsert.upsert(rows(spark, (2, "y")), p, "k", "three")
    assert [(r.batch, r.inserted, r.known) for r in upsert.ingest_report(spark, p).collect()] == [("one", 2, 0), ("two", 1, 1), ("three", 0, 1)]


def test_killed_between_data_and_manifest(spark, tmp_path):
    p = str(tmp_path / "t")
    upsert.upsert(rows(spark, (1, "a")), p, "k", "one")

    def killed():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        upsert.upsert(rows(spark, (2, "b")), p, "k", "two", between=killed)
    assert held(spark, p) == [(1, "a")]
    for _ in range(2):  # the batch runs again, and once more
        upsert.upsert(rows(spark, (2, "b")), p, "k", "two")
        assert held(spark, p) == [(1, "a"), (2, "b")]
    assert upsert.clean(spark, p) >= 1 and held(spark, p) == [(1, "a"), (2, "b")] and upsert.clean(spark, p) == 0


def test_two_writers_never_add_a_key_twice(spark, tmp_path):
    p, once = str(tmp_path / "t"), []

    def other():
        if not once:
            once.append(upsert.upsert(rows(spark, (2, "other"), (3, "other")), p, "k", "two"))

    got = upsert.upsert(rows(spark, (1, "mine"), (2, "mine")), p, "k", "one", between=other)
    assert held(spark, p) == [(1, "mine"), (2, "other"), (3, "other")]
    assert (got["version"], got["inserted"], got["known"]) == (1, 1, 1)
    twice = []

    def same():
        if not twice:
            twice.append(upsert.upsert(rows(spark, (9, "first")), p, "k", "same"))

    assert upsert.upsert(rows(spark, (9, "second")), p, "k", "same", between=same) == twice[0] | {"at_ms": upsert.manifests(spark, p)[-1]["at_ms"]}
    assert held(spark, p)[-1] == (9, "first")


def test_reset(spark, tmp_path):
    p = str(tmp_path / "t")
    upsert.upsert(rows(spark, (1, "a")), p, "k", "one")
    upsert.reset(spark, p)
    assert held(spark, p) == [] and upsert.ingest_report(spark, p).count() == 0
    upsert.upsert(rows(spark, (1, "again")), p, "k", "one")
    assert held(spark, p) == [(1, "again")] and upsert.clean(spark, p) == 1 and held(spark, p) == [(1, "again")]


def test_downloads_wait_and_try_again(spark):
    calls, waits = [], []

    def fetch(url):
        calls.append(url)
        if len(calls) < 3:
            raise files.Refused(503)
        return b"%PDF-"

    assert files.retrying(fetch, wait=waits.append)("u") == b"%PDF-" and len(calls) == 3 and waits == [1.5, 3.0]

    def gone(url):
        raise files.Refused(404)

    with pytest.raises(files.Refused):
        files.retrying(gone, wait=waits.append)("u")
    assert len(waits) == 2
    calls.clear()
    late = files.Refused(429, after=7.0)

    def limited(url):
        calls.append(url)
        if len(calls) == 1:
            raise late
        return b"x"

    assert files.retrying(limited, wait=waits.append)("u") == b"x" and waits[-1] == 7.0
