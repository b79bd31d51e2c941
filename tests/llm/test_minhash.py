import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import minhash, simhash


def plain(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def components(texts):
    sets = {t: plain(t) for t in texts}
    left, out = set(texts), []
    while left:
        group, edge = set(), [left.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            near = {y for y in left if len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.8}
            left -= near
            edge += near
        out.append(group)
    return out


def edited(rng, words, n):
    w = list(words)
    for i in rng.integers(0, len(w), n):
        w[i] = f"e{rng.integers(10**6)}"
    return " ".join(w)


def test_the_stage_keeps_one_of_each_group_by_exact_similarity(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e"]
    for base in (rng.choice([f"v{i}" for i in range(5000)], 200) for _ in range(12)):
        # two to six edits of 200 words: similarities around 0.8, and chains over them
        texts += [" ".join(base)] + [edited(rng, base, int(n)) for n in rng.integers(1, 7, 12)]
        chain = list(base)
        for i in range(5):
            chain[20 + 35 * i : 22 + 35 * i] = [f"c{i}", f"d{i}"]
            texts.append(" ".join(chain))
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, texts[7]), (None, texts[7]), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    groups = components({t or "" for _, t in rows})
    want = [min((i for i, t in rows if (t or "") in g and i is not None), default=None) for g in groups]
    assert got.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(map(str, want))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_a_large_group_of_near_copies_costs_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.choice([f"v{i}" for i in range(5000)], 300)
    docs = spark.createDataFrame([(i, edited(rng, base, 2)) for i in range(200)], "doc_id long, text string")
    tested, test = [], minhash._tested
    monkeypatch.setattr(minhash, "_tested", lambda pairs, sets: tested.append(pairs.count()) or test(pairs, sets))
    assert [r.component_id for r in minhash.near_duplicates(docs).select("component_id").distinct().collect()] == [0]
    assert sum(tested) < 200 * 32


def test_copies_of_unlike_quality_cost_few_pairs(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.choice([f"v{i}" for i in range(5000)], 150)
    # most of those with many edits are like no other, some have one partner
    texts = [edited(rng, base, int(n)) for n in rng.integers(0, 12, 260)]
    texts += [t + " last" for t in texts[::20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tested, test = [], minhash._tested
    monkeypatch.setattr(minhash, "_tested", lambda pairs, sets: tested.append(pairs.count()) or test(pairs, sets))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    of = {t: min(i for i, x in enumerate(texts) if x in g) for g in components(set(texts)) for t in g}
    assert got == {i: of[t] for i, t in enumerate(texts)}
    assert sum(tested) < 260 * 32


def test_known_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where(F.col("doc_id").isin(2, 547, 1, 9622, 1866, 7528, 4474, 6578, 6218, 6398))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 2, 1866, 4474, 6218]


def test_the_stage_goes_by_fingerprints_first(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = list(rng.choice([f"v{i}" for i in range(5000)], 100))
    texts = [" ".join(base), " ".join(base) + " last", "first " + " ".join(base)]
    texts += [" ".join(base[:50]) + " " + " ".join(base[50:]).upper()]
    # three edits leave too few five-word shingles, yet some fingerprints stay near
    f = simhash.fingerprint(texts[0])
    apart = lambda t: len(plain(t) & plain(texts[0])) / len(plain(t) | plain(texts[0])) < 0.8
    texts.append(next(t for t in (edited(rng, base, 3) for _ in range(3000)) if (simhash.fingerprint(t) ^ f).bit_count() <= 2 and apart(t)))
    docs = spark.createDataFrame([*enumerate(texts), (90, "x y z")], "doc_id long, text string")
    asked, link, tested, test = [], simhash.links, [], minhash._tested
    monkeypatch.setattr(simhash, "links", lambda *a: asked.append(a[1:]) or link(*a))
    monkeypatch.setattr(minhash, "_tested", lambda pairs, sets: tested.append({tuple(r) for r in pairs.collect()}) or test(pairs, sets))
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert asked == [(2, 4, 4096)]  # op9's radius, bands and blocks
    assert tested[0]  # its links come first, and are checked exactly
    of = {t: min(i for i, x in enumerate(texts) if x in g) for g in components(set(texts)) for t in g}
    assert sorted(r.doc_id for r in got.collect()) == [*sorted(set(of.values())), 90] and len(set(of.values())) == 2


def test_fingerprints_and_bands_take_one_pass(spark, monkeypatch):
    texts = [None, "", "one", "a b c d e f", "A B C D E F g"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made, cut = [], minhash.cut
    monkeypatch.setattr(minhash, "cut", lambda df, *a: made.append(df) or cut(df, *a))
    minhash.near_duplicates(docs, fingerprints=True)
    # two passes in a task would keep two Python workers a core, which a later stage fills as well
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.id: r for r in made[0].collect()}
    for i, t in enumerate(texts):
        s = minhash.shingles(t)
        assert (got[i].print % 2**64, got[i].n, got[i].bands) == (simhash.fingerprint(t), len(s), minhash.bands([s])[0].tolist())
