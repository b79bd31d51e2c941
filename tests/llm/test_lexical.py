"""Lexical search: terms, postings and both ways of meeting them against plain loops; odd rows."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from siltstone.llm import lexical


def plain_terms(text):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)


def plain(docs, items, k=10):
    texts = [(i, Counter(plain_terms(x))) for i, x in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    asked: dict = {}
    for i, x in items:
        asked.setdefault(i, set()).update(plain_terms(x))
    out = []
    for i, terms in asked.items():
        scored = []
        for doc, c, n in texts:
            m = 10 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, doc is not None, doc or 0))
        out += [(i, r + 1, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


DOCS = [
    (1, "The cat sat; THE cat ran."), (2, "Ärger mit Ähre, dog42 dog"), (3, None), (4, ""), (5, "... !!"), (6, "cat " * 3000 + "dog"), (7, "cat dog cat"), (8, "cat dog cat"), (8, "cat dog cat"),
    (9, "日本 cat\x00dog\x7fß_x"), (None, "cat with no id"), (None, None), (10, "é É E e"), (11, "zzz"), (12, "\U0001f600 smile\U0001f600 dog"),
]
ITEMS = [(100, "cat and dog"), (101, "É e ähre"), (102, None), (103, "?!"), (104, "nowhere found"), (105, "dog42"), (105, "zzz cat CAT"), (106, "the the the"), (None, "\U0001f600 smile")]


@pytest.mark.parametrize("limit", [1000, 0])
def test_search_equals_plain_loops(spark, limit):
    docs = spark.createDataFrame([(i, x, 1, "t") for i, x in DOCS], "doc_id long, text string, n int, term string").repartition(3)
    items = spark.createDataFrame([(i, x, 2) for i, x in ITEMS], "item_id long, text string, tf int")
    got = lexical.search(docs, items, k=4, broadcast_terms=limit, slice_rows=2)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(DOCS, ITEMS, 4)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for limit in (1000, 0):
        assert lexical.search(docs.where("false"), items, broadcast_terms=limit).collect() == []
        assert lexical.search(docs, items.where("false"), broadcast_terms=limit).collect() == []


def test_terms_of_a_batch():
    texts = [x or "" for _, x in DOCS] + ["a", "b", "", "C"]
    for column in (pa.array(texts), pa.array(["no", *texts])[1:], pa.array([], pa.string())):
        made, of = lexical.split(column)
        assert list(zip(of.tolist(), made.to_pylist(), strict=True)) == [(i, t) for i, x in enumerate(column.to_pylist()) for t in plain_terms(x)]


def test_postings(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    rows = {(r.id, r.term, r.n): r.tf for r in lexical.postings(docs).where("id in (1, 6)").collect()}
    assert rows == {(1, "", 6): 6, (1, "the", 6): 2, (1, "cat", 6): 2, (1, "sat", 6): 1, (1, "ran", 6): 1, (6, "", 3001): 3001, (6, "cat", 3001): 3000, (6, "dog", 3001): 1}
    assert {r.term for r in lexical.postings(docs, known=["cat"]).collect()} == {"", "cat"}
