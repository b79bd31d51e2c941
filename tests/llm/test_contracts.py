"""The registered queries' own columns, the quality model against plain loops, odd tables through chat and the pipeline."""

import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import ann, chat, quality, queries
from siltstone.llm.common import table

KINDS = {
    "op3_token_counts": {"doc_id": "bigint", "n_tokens": "bigint"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op7_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9_simhash_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op11_improbable_digest": {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
    "op12_hard_negatives": {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"},
    "op13_lexical": {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"},
}


@pytest.mark.parametrize("name", ["op3_token_counts", "op4_quality", "op7_toxicity", "op9_simhash_dedup"])
def test_columns_and_digests(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert dict(df.dtypes) == KINDS[name]
    rows, ids = df.collect(), {r.doc_id for r in table(spark, data, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    for r in rows:
        if "held_out" in KINDS[name]:
            modulus, held = (5, 0) if name == "op4_quality" else (4, 2)
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if name == "op9_simhash_dedup":
            assert re.fullmatch("[0-9a-f]{16}", r.fingerprint) and r.component_id in ids and r.component_id <= r.doc_id


def test_types_of_the_new_queries(spark, data):
    for name in ("op11_improbable_digest", "op12_hard_negatives", "op13_lexical"):
        assert dict(queries.QUERIES[name](spark, data).dtypes) == KINDS[name], name


def signed(text: str) -> int:
    return int(np.uint64(xxhash.xxh64(text.encode(), seed=42).intdigest()).astype(np.int64))


def test_quality_query_equals_plain_pooling(spark, data):
    """Tokens, pooling, both layers and the temperature by loops over the fitted model's numbers."""
    docs = table(spark, data, "documents").select("doc_id", "text")
    train = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0
    model = quality.fit(docs, table(spark, data, "labels"), train)
    got = {r.doc_id: r.score for r in queries.op4_quality(spark, data).collect()}
    import regex

    net = model.network
    for r in docs.orderBy(F.length("text")).limit(60).collect():
        v = [model.vectors[(signed(w) % 2**64) % quality.BUCKETS].astype(float) for w in regex.findall(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+", r.text or "")]
        x = np.zeros(quality.POOLED)
        for i, a in enumerate(v):
            x[: quality.DIMS] += a
            x[quality.DIMS : 2 * quality.DIMS] += a * a
            for step in (1, 2):
                if i >= step:
                    x[2 * quality.DIMS + step - 1] += a @ v[i - step]
        x /= len(v) + 2
        hidden = [np.tanh(sum((x[j] - net.mean[j]) / net.scale[j] * net.w1[j, k] for j in range(len(x))) + net.b1[k]) for k in range(len(net.b1))]
        z = sum(h * w for h, w in zip(hidden, net.w2, strict=True)) + net.b2
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z / net.temperature))) < 1e-4


def test_first_training_step_goes_down_the_gradient():
    """Adam's first step moves every weight by the rate against the sign of the loss's derivative, here by finite differences."""
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 2, 40).astype(float)
    start, after = (quality.train(x, y, hidden=2, epochs=e, rate=0.01, decay=0.0, seed=5) for e in (0, 1))
    order = np.random.default_rng(5).permutation(len(y))
    fit = order[len(y) // 5 :]

    def loss(net):
        z = net.logits(x[fit])
        return np.mean(np.logaddexp(0, np.where(y[fit] == 1, -z, z)))

    for name in ("w1", "b1", "w2"):
        a, b = getattr(start, name), getattr(after, name)
        for at in np.ndindex(a.shape):
            keep, eps = a[at], 1e-6
            a[at] = keep + eps
            up = loss(start)
            a[at] = keep - eps
            slope = (up - loss(start)) / (2 * eps)
            a[at] = keep
            if abs(slope) > 1e-5:
                assert abs((b[at] - a[at]) + 0.01 * np.sign(slope)) < 1e-4, (name, at)
    assert loss(after) < loss(start)


def test_chat_with_odd_tables(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 5, "x"), (1, 1, "assistant", "b", 6, "y")], "conv_id long, turn int, role string, text string, Formatted int, loss string")
    assert chat.format_turns(chat.turns(rows.where("false"))).collect() == []
    kept = chat.turns(rows).withColumns({"Formatted": F.lit(3), "loss": F.lit("z"), "other": F.lit("z")})
    made = chat.format_turns(kept).first()
    assert set(made.asDict()) == {"conv_id", "formatted", "loss", "other"} and made.other == "z" and "a" in made.formatted and len(made.loss) == 1
    long_ = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("</s> turn "), "id").alias("text"))
    back = chat.format_turns(chat.turns(long_)).select(chat.read_back(F.col("formatted")).alias("b")).first().b
    assert len(back) == 3000 and back[2999].text == "</s> turn 2999"


def test_vectors_of_unequal_length_are_an_error(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="components"):
        ann.neighbours(df, F.col("vec_id") % 100 == 0)


def test_pipeline_keeps_extra_and_clashing_columns(spark, data):
    docs = table(spark, data, "documents").limit(60).withColumns({c: F.lit(i) for i, c in enumerate(["toxicity", "quality", "copies", "row", "c0", "fp", "h", "label", "size", "id"])})
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, data)
        assert stage.columns == docs.columns, name
    rows = stage.collect()
    assert rows and all((r.toxicity, r.copies, r.label, r["size"]) == (0, 2, 7, 8) for r in rows)
    assert corpus_pipeline.STAGES[-1][1](spark, stage, data).count() == len(rows)
