from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import quality, toxicity
from siltstone.llm.common import handed_over

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(300)])
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(words, 40))
        toxic, junk = i % 8 == 0, i % 5 == 0
        for _ in range(6 * toxic):
            w[rng.integers(40)] = rng.choice(["nasty", "vile", "foul"])
        if junk:
            w = [x + "***" for x in w]
        rows.append((i, " ".join(w), "h"))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, h string"), spark.createDataFrame(labels, LABELS)


def held_out_accuracy(scored, labels, label, threshold=0.3):
    met = scored.join(labels, "doc_id").where("doc_id % 4 = 1")
    return met.agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(label)).cast("double"))).first()[0]


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_rows_and_odd_texts(spark, corpus, module, label):
    docs, labels = corpus
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (10**9, 1, 1)], LABELS))
    model = module.fit(docs, labels, F.col("id") % 4 != 1)
    scored = module.score(docs, model)
    assert scored.columns == ["doc_id", "h", "score"]
    assert held_out_accuracy(scored, labels, label) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "..."), (3, "nasty " * 30000), (3, "w1"), (3, "w1")], "doc_id long, text string")
    got = module.score(odd, model, keep_text=True).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    by = {(r.doc_id, r.text): r.score for r in got}
    assert by[1, None] == by[2, ""]
    assert module.score(odd.where("false"), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_documents(spark, corpus, module):
    docs, labels = corpus
    for d, few in ((docs, labels.where("false")), (docs.where("false"), labels), (docs, labels.where("quality = 1 and toxic = 0"))):
        model = module.fit(d, few, F.lit(True))
        assert all(0 <= r.score <= 1 for r in module.score(docs.limit(5), model).collect())


def test_short_outburst_in_a_long_text(corpus, spark):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.lit(True))
    calm = " ".join(f"w{i % 300}" for i in range(6000))
    angry = calm + " nasty w1 vile w2 foul w3 nasty w5 vile w9 foul vile nasty foul w2 nasty w7 vile w8 foul"
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([(1, calm), (2, angry)], "doc_id long, text string"), model).collect()}
    assert got[2] > got[1]


def test_context_vectors_equal_a_plain_sum(spark):
    texts = [("a b c a",), ("b b",), (None,), ("",)]
    df = spark.createDataFrame(texts, "text string")
    got = quality.word_vectors(df)
    place, sign = quality._index_vectors()
    ids = {r.w: int(np.uint64(np.int64(r.h)) % np.uint64(quality.BUCKETS)) for r in spark.sql("select w, xxhash64(w) h from values ('a'), ('b'), ('c') t(w)").collect()}
    sums, count = np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros(quality.BUCKETS)
    for (t,) in texts:
        w = [ids[x] for x in (t or "").split()]
        for i, a in enumerate(w):
            count[a] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    np.add.at(sums[a], place[w[j]], sign[w[j]])
    seen = count > 0
    v = sums / np.maximum(count, 1)[:, None]
    v[seen] -= np.average(v[seen], axis=0, weights=count[seen])
    v /= np.linalg.norm(v, axis=1, keepdims=True) + 0.05
    v[~seen] = 0
    assert np.allclose(got, v, atol=1e-5)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(2)
    z = rng.normal(size=2000) * 6
    y = (rng.random(2000) < 1 / (1 + np.exp(-z / 3))).astype(float)
    assert 2.4 < quality._temperature(z, y) < 3.7


SMALL = [
    ("vile nasty vile dog saw a vile nasty cat", 1), ("the dog saw a cat", 0), ("the dog saw the dog", 0), ("a vile nasty dog", 1), ("vile nasty vile cat", 1), ("the vile nasty cat saw", 1),
    ("vile nasty", 1), ("a dog saw a cat", 0), ("the cat saw the dog", 0), ("the dog saw the cat saw a dog", 0), ("the dog", 0), (None, 0), ("", 1), ("nasty cat nasty dog nasty nasty saw nasty a nasty", 1), ("Vilest nastiest", 1),
]


def plain_ratios(rows, text):
    """The log-ratio of each distinct pair of ``text``: two Kneser-Ney models, from their definition."""
    pairs_of = lambda t: list(dict.fromkeys(zip([None, *(t or "").lower().split()], (t or "").lower().split(), strict=False)))
    n = [{}, {}]
    for t, y in rows:
        for pair in pairs_of(t):
            n[y][pair] = n[y].get(pair, 0) + 1
    both = set(n[0]) | set(n[1])
    total = sum(sum(x.values()) for x in n)
    out = []
    for u, w in pairs_of(text):
        p = []
        for x in n:
            follows = {}
            for _, b in x:
                follows[b] = follows.get(b, 0) + 1
            shared = (sum(b == w for _, b in both) + 0.5) / (len(both) + 0.5 * len({b for _, b in both}))
            of = lambda x: max(sum(k for (_, b), k in x.items() if b[:4] == w[:4]) - 1, 0)  # noqa: B023, E731
            share = sum(x.values()) / total
            weight = (of(x) + share * 30) / (share * (of(n[0]) + of(n[1]) + 30))
            word = (max(follows.get(w, 0) - 3, 0) + sum(min(f, 3) for f in follows.values()) * shared * weight) / len(x)
            after = {b: k for (a, b), k in x.items() if a == u}
            if after:
                word = (max(after.get(w, 0) - 2, 0) + sum(min(k, 2) for k in after.values()) * word) / sum(after.values())
            p.append(word)
        out.append(np.clip(np.log(p[1] / p[0]), -6, 6))
    return out


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SMALL)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(SMALL)], LABELS)
    return docs, labels


def hashes(spark, text):
    h = spark.createDataFrame([(text,)], "t string").select(toxicity._tokens(F.col("t"))).first()[0]
    return np.array(h, np.int64), np.array([0, len(h)])


def test_toxicity_equals_two_plain_kneser_ney_models(spark, small):
    model = toxicity.fit(*small, F.lit(True))
    for text in ["vile nasty vile dog saw", "the dog saw a cat", "new words the vilely cat a nasty nasty", "nasty"]:
        p = toxicity.Pairs.of(*hashes(spark, text))
        got = toxicity.ratios(model.sums, model.tables, p)
        assert np.allclose(got, plain_ratios(SMALL, text), rtol=0, atol=1e-9)
        assert np.abs(got).max() > 0.05
        mean = np.sum(plain_ratios(SMALL, text)) / (len(got) + toxicity.PRIOR_WORDS)
        assert abs(toxicity._evidence(model.sums, model.tables, *hashes(spark, text))[0, 0] - mean) < 1e-9
    # continuation counts and discounts decide the scores
    p = toxicity.Pairs.of(*hashes(spark, "the nasty dog saw a vile nasty cat"))
    before = toxicity.ratios(model.sums, model.tables, p)
    follows = model.tables.columns[toxicity.WORD]
    model.tables.columns[toxicity.WORD] = follows + 2 * (follows > 0)
    assert not np.allclose(toxicity.ratios(model.sums, model.tables, p), before)
    model.tables.columns[toxicity.WORD] = follows
    assert not np.allclose(toxicity.ratios(replace(model.sums, freed=model.sums.freed / 2), model.tables, p), before)


def test_own_counts_are_taken_out(spark, small):
    docs, labels = small
    every = toxicity.fit(docs, labels, F.lit(True))
    # a text whose pairs are all frequent: leaving it out is the same as never having counted it, but for sums over all words
    text = "vile nasty"
    found = toxicity._evidence(every.sums, every.tables, *hashes(spark, text), np.array([1]))
    less = toxicity.fit(docs.where("doc_id <> 6"), labels, F.lit(True))
    want = toxicity._evidence(every.sums, less.tables, *hashes(spark, text))
    assert np.allclose(found, want, atol=0.05) and not np.allclose(found, toxicity._evidence(every.sums, every.tables, *hashes(spark, text)))


def test_a_model_too_large_to_broadcast_gives_the_same_scores(spark, corpus):
    docs, labels = corpus
    docs = docs.limit(200).unionByName(spark.createDataFrame([(None, None, "x"), (3, "", "y"), (3, "nasty " * 3000, "y"), (3, "nasty " * 3000, "y")], "doc_id long, text string, h string"))
    one, two = (toxicity.fit(docs, labels, F.lit(True), model_rows=n) for n in (10**6, 0))
    assert one.tables is not None and two.tables is None
    assert np.allclose(one.weights, two.weights, rtol=1e-6)
    a, b = (sorted((str(r.doc_id), r.h, round(r.score, 9)) for r in toxicity.score(docs, m).collect()) for m in (one, two))
    assert a == b and len(a) == docs.count()


def test_a_model_too_large_to_broadcast_moves_texts_once_and_few_keys(spark, corpus, monkeypatch):
    docs, labels = corpus
    whole = toxicity.fit(docs, labels, F.lit(True))
    rows = sum(len(k) - 1 for k in whole.tables.keys.values())
    stored = []
    monkeypatch.setattr(toxicity, "handed_over", lambda df, *a: stored.append(df.columns) or handed_over(df, *a))
    part = toxicity.fit(docs, labels, F.lit(True), model_rows=rows // 2)
    near = sum(len(k) - 1 for k in part.near.keys.values())
    # the frequent rows are broadcast, no row is lost or twice
    assert part.tables is None and 0 < near <= rows // 2 and near + part.frame.count() == rows
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score(docs, m).collect()) for m in (whole, part))
    assert a == b
    # tokens of texts are never written
    assert stored and all("h" not in x for x in stored)
    # keys without a row are hardly asked for
    marks = toxicity._marks(part.frame.select("key"), part.rows)
    keys = part.frame.select("key").toArrow().column(0).to_numpy()
    assert toxicity._marked(marks, keys).all() and toxicity._marked(marks, np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 10_000)).mean() < 0.2


def test_no_counted_row_or_pair_is_left_out(spark, corpus):
    docs, labels = corpus
    # a pair that occurs in each text is counted once a labelled row, whatever the bound on calibration
    every = docs.withColumn("text", F.concat(F.col("text"), F.lit(" same pair")))
    n, toxic = labels.agg(F.count("*"), F.sum("toxic")).first()
    for rows in (20_000, 10):
        model = toxicity.fit(every, labels, F.lit(True), calibration_rows=rows)
        p = toxicity.Pairs.of(*hashes(spark, "same pair"))
        assert model.tables.find(toxicity.PAIR, toxicity._mix(p.context, p.word))[:, 1].tolist() == [n - toxic, toxic]
    # all pairs above the discount are there
    counts = [{}, {}]
    for r in every.join(labels, "doc_id").collect():
        w = r.text.replace("*", "").split()
        for pair in set(zip([None, *w], w, strict=False)):
            counts[r.toxic][pair] = counts[r.toxic].get(pair, 0) + 1
    assert len(model.tables.keys[toxicity.PAIR]) - 1 == len({p for x in counts for p, k in x.items() if k > 2})


@pytest.mark.parametrize("module", [toxicity, quality])
def test_clashing_names_and_other_id_columns(spark, small, module):
    docs, labels = small
    odd = docs.selectExpr("doc_id as key", "text", "1 as e0", "2 as h", "3 as Score", "4 as row", "5 as r", "6 as c0", "7 as `a.b`", "8 as x")
    for options in ({}, {"model_rows": 0}) if module is toxicity else ({},):
        model = module.fit(odd, labels.withColumnRenamed("doc_id", "key"), F.lit(True), id_column="key", **options)
        got = module.score(odd, model, keep_text=True)
        assert got.columns == ["key", "text", "e0", "h", "row", "r", "c0", "a.b", "x", "score"]
        rows = got.collect()
        assert len(rows) == len(SMALL) and {(r.e0, r.h, r.row, r["a.b"]) for r in rows} == {(1, 2, 4, 7)} and all(0 <= r.score <= 1 for r in rows)


def test_batch_size_does_not_matter(spark, corpus):
    docs, labels = corpus
    model = toxicity.fit(docs, labels, F.lit(True))
    seen, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    for size in ("10000", "7"):
        scored = toxicity.score(docs, model)
        spark.conf.set(key, size)
        seen.append(sorted((r.doc_id, round(r.score, 12)) for r in scored.collect()))
    assert seen[0] == seen[1]
