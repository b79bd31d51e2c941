import math

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunking, evaluation, gap, prompts, retrieval, sparse
from siltstone.sources import files, sinks, upsert
from siltstone.streaming import incremental


def ranks(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc_id long, score double, rank long")


def test_fusion_scores_and_ties(spark):
    dense, sparse = ranks(spark, [(1, 1, 0.9, 1), (1, 2, 0.8, 2)]), ranks(spark, [(1, 2, 5.0, 1), (1, 3, 4.0, 2)])
    got = {r.doc_id: (r.rrf_score, r.retrieval_mode) for r in retrieval.fuse(dense, sparse).collect()}
    assert got == {2: (round(1 / 62 + 1 / 61, 6), "hybrid"), 1: (round(1 / 61, 6), "dense_only"), 3: (round(1 / 62, 6), "sparse_only")}
    tie = retrieval.ranked(retrieval.fuse(ranks(spark, [(1, 9, 1.0, 1)]), ranks(spark, [(1, 2, 1.0, 1)])), 5, *retrieval.fused_order())
    assert [r.doc_id for r in tie.orderBy("rank").collect()] == [9, 2]


def test_bm25_by_hand_and_zero_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fish"), (2, "blue fish fish"), (3, "green bird"), (4, None), (5, "tree")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "blue blue fish"), (8, "zzz"), (9, None)], "query_id long, text string")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in sparse.bm25_topk(asked, docs, sparse.sparse_index(docs, str(tmp_path)), 3).collect()}
    n, avg = 5, 8 / 5
    idf = lambda df: math.log(n - df + 0.5) - math.log(df + 0.5)
    part = lambda w, tf, dl: w * tf * 2.6 / (tf + 1.6 * (0.25 + 0.75 * dl / avg))
    assert got[7, 1] == (2, round(2 * part(idf(1), 1, 3) + part(idf(2), 2, 3), 6))
    assert got[7, 3] == (3, 0.0)
    assert [got[8, i] for i in (1, 2, 3)] == [(1, 0.0), (2, 0.0), (3, 0.0)] and got[9, 1] == (1, 0.0)


def test_negative_weights_have_a_floor(spark, tmp_path):
    docs = spark.createDataFrame([(i, "common" + (" rare" if i == 0 else "")) for i in range(5)], "doc_id long, text string")
    w = {r.term: r.idf for r in sparse.sparse_index(docs, str(tmp_path)).terms.collect()}
    raw = {"common": math.log(0.5) - math.log(5.5), "rare": math.log(4.5) - math.log(1.5)}
    assert math.isclose(w["common"], 0.25 * sum(raw.values()) / 2) and math.isclose(w["rare"], raw["rare"])


def test_dense_filters_first(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.6, 0.8], "b"), (3, [0.0, 1.0], "b"), (4, None, "b")], "doc_id long, embedding array<float>, k string")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.doc_id for r in retrieval.dense_topk(q, rows, 1, where=F.col("k") == "b").collect()] == [2]
    assert retrieval.dense_topk(q.where("false"), rows, 1).count() == 0


def test_dense_searches_many_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(25)] + [(90, [math.cos(3), math.sin(3)]), (91, None)], "doc_id long, embedding array<double>")
    q = rows.withColumnRenamed("doc_id", "query_id")
    whole = sorted(map(tuple, retrieval.dense_topk(q, rows, 3, exclude_self=True).collect()))
    assert len(whole) == 78 and [r[1] for r in whole if r[0] == 3 and r[3] == 1] == [90]
    monkeypatch.setattr(retrieval, "SCORE_NUMBERS", 50)
    assert sorted(map(tuple, retrieval.dense_topk(q, rows, 3, exclude_self=True).collect())) == whole
    monkeypatch.setattr(retrieval, "BLOCK_BYTES", 100)  # blocks meet slices
    assert sorted(map(tuple, retrieval.dense_topk(q, rows, 3, exclude_self=True, shared_bytes=0).collect())) == whole


def test_first_columns_keeps_ties_in_order_of_ids():
    import numpy as np

    scores, ids = np.array([[1.0, 3.0, 3.0, 2.0, 3.0], [0.0, 0.0, 0.0, 0.0, 0.0]]), np.array([5, 9, 4, 1, 7])
    line, column = retrieval.first_columns(scores, ids, 2)
    assert list(zip(line.tolist(), ids[column].tolist(), strict=True)) == [(0, 4), (0, 7), (1, 1), (1, 4)]
    assert retrieval.first_columns(scores, ids, 9)[0].tolist() == [0] * 5 + [1] * 5


@pytest.mark.parametrize("shared", [1 << 20, 0])
def test_each_question_has_its_own_filter(spark, shared):
    rows = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], [f"c={i % 3}", "all=1"] if i % 5 else None) for i in range(40)], "doc_id long, embedding array<double>, keys array<string>")
    asked = [(100, [1.0, 0.0], "c=1"), (101, [1.0, 0.0], None), (102, [0.0, 1.0], "c=9"), (103, [0.0, 1.0], "all=1"), (104, None, "c=1")]
    got: dict = {}
    for r in retrieval.dense_topk(spark.createDataFrame(asked, "query_id long, embedding array<double>, only string"), rows, 4, shared_bytes=shared).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    for q, v, only in asked[:4]:
        fits = [i for i in range(40) if only is None or (i % 5 and only in (f"c={i % 3}", "all=1"))]
        best = sorted(fits, key=lambda i: (-round(v[0] * math.cos(i) + v[1] * math.sin(i), 6), i))[:4]
        assert sorted(got.get(q, [])) == sorted(best)
    assert 104 not in got


def test_ranking_metrics(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, 0), (2, 3, 1)], "query_id long, rank long, relevant int")
    totals = spark.createDataFrame([(1, 2), (2, 1), (3, 0), (4, 5)], "query_id long, n_relevant long")
    m = {(r.query_id, r.k): r for r in evaluation.ranking_metrics(lists, totals, (1, 3)).collect()}
    assert math.isclose(m[1, 3].ndcg, 1.5 / (1 + 1 / math.log2(3))) and math.isclose(m[1, 3].ap, (1 + 2 / 3) / 2)
    assert (m[1, 1].precision, m[1, 1].recall, m[1, 3].recall) == (1.0, 0.5, 1.0)
    assert math.isclose(m[2, 3].mrr, 1 / 3) and m[2, 1].hit_rate == 0.0
    assert (m[3, 3].recall, m[3, 3].ndcg, m[3, 3].ap) == (1.0, 0.0, 0.0)
    assert (m[4, 3].recall, m[4, 3].precision) == (0.0, 0.0)


def test_rouge(spark):
    p = spark.createDataFrame([(1, "a a b", "a b c"), (2, "a c b", "a b c"), (3, "", "x"), (4, None, None), (5, "Ä-b, c!", "ä b c")], "id long, hyp string, ref string")
    one = {r.id: r.f1 for r in evaluation.rouge_n(p, 1).collect()}
    longest = {r.id: r.f1 for r in evaluation.rouge_l(p).collect()}
    assert math.isclose(one[1], 2 / 3) and math.isclose(longest[2], 2 / 3)
    assert (one[3], one[4], one[5], longest[3], longest[5]) == (0, 0, 1, 0, 1)
    assert {r.id: r.f1 for r in evaluation.rouge_n(p, 2).collect()}[1] == 0.5


def test_grounding(spark):
    v = spark.createDataFrame([(1, x) for x in ("SUPPORTED", "PARTIAL", "UNSUPPORTED", "FABRICATED")], "id long, verdict string")
    r = evaluation.hallucination(v).first()
    assert (r.hallucination_rate, r.grounding_score) == (0.5, 0.25)


def test_taxonomy(spark):
    cols = "id int, hit boolean, precision double, recall double, rouge1 double, hallucination double, grounding double, faithfulness double, insufficient boolean"
    rows = [
        (1, False, 0.0, 0.0, 0.1, 0.0, 0.0, 0.0, False), (2, True, 0.2, 0.1, 0.5, 0.1, 0.2, 0.9, False), (3, True, 0.9, 0.9, 0.5, 0.5, 0.2, 0.9, False),
        (4, True, 0.9, 0.9, 0.1, 0.1, 0.5, 0.9, False), (5, True, 0.9, 0.9, 0.4, 0.1, 0.5, 0.9, False), (6, False, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, True), (7, True, 0.9, 0.9, 0.18, 0.1, 0.6, 0.9, False),
    ]
    got = {r.id: r.primary_mode[:3] for r in evaluation.failure_taxonomy(spark.createDataFrame(rows, cols)).collect()}
    assert got == {1: "FM1", 2: "FM3", 3: "FM4", 4: "FM5", 5: "NON", 6: "FM7", 7: "FM6"}


def test_cells_by_precedence(spark):
    s = "entity string, dimension string, score double"
    cells = spark.createDataFrame([(e, "d") for e in "abcdef"], "entity string, dimension string")
    single = spark.createDataFrame([("a", "d", 0.9, "VAGUE", 1, True), ("b", "d", 0.3, "VAGUE", 1, True), ("c", "d", None, "QUALIFIED", 0, False), ("f", "d", 0.1, "VAGUE", 2, False)], s + ", level string, commitments int, has_findings boolean")
    got = {r.entity: (r.score, r.label, r.source) for r in gap.merge_cells(cells, spark.createDataFrame([("a", "d", 0.1)], s), single, spark.createDataFrame([("b", "d", 0.7), ("d", "d", 0.6)], s)).collect()}
    assert got == {"a": (0.1, "ALIGNED", "override"), "b": (0.3, "PARTIAL", "single"), "c": (0.85, "CRITICAL", "heuristic"), "d": (0.6, "SIGNIFICANT", "original"), "e": (None, "MISSING", "missing"), "f": (0.65, "SIGNIFICANT", "heuristic")}


@pytest.mark.parametrize("strict", [False, True])
def test_chunks_keep_text_and_budget(strict):
    parts = [" ".join(f"w{i}_{j}" for j in range(n)) for i, n in enumerate([5, 9, 3, 40, 7, 2, 2, 11])]
    out = chunking.fold(parts, least=6, most=12, strict=strict)
    if strict:  # may go over, and leaves text out
        assert all(chunking.count_words(c) >= 6 for c in out[:-1])
    else:
        assert all(chunking.count_words(c) <= 12 * 1.2 for c in out)
        assert set(" ".join(parts).split()) <= set(" ".join(out).split())
    assert chunking.fold([]) == [] and chunking.fold(["one"]) == ["one"]


def test_sections(spark):
    pages = spark.createDataFrame([(1, 1, "intro text", False), (1, 2, "1. First\nwords\nCHAPTER TWO", False), (1, 3, "more", False), (1, 6, "last", True)], "doc_id long, page long, text string, has_table boolean")
    got = [(r.section, r.page_start, r.is_table) for r in chunking.near_tables(chunking.sections(pages)).orderBy("page").collect()]
    assert got == [("Introduction", 1, True), ("CHAPTER TWO", 2, True), ("CHAPTER TWO", 2, True), ("CHAPTER TWO", 2, True)]


def test_models_fail_alone_and_are_asked_once(spark, tmp_path):
    def picky(batch):
        if any("bad" in p for p in batch):
            raise RuntimeError("no")
        return [p.upper() for p in batch]

    df = spark.createDataFrame([(1, "good"), (2, "bad one"), (3, "good")], "id int, prompt string")
    got = {r.id: (r.answer, r.error) for r in prompts.generate(df, picky).collect()}
    assert got[1] == ("GOOD", None) and got[2] == (None, "RuntimeError: no")
    store = str(tmp_path / "replies")
    for _ in range(2):
        assert prompts.persisted(df, store).count() == 3
    assert spark.read.parquet(store).count() == 2


def test_sources(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    assert sorted(r.a for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == [1, 2]
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema, strict=True).collect()
    assert files.malformed_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 1
    (tmp_path / "b.csv").write_text('﻿id,t\n1,"two\nlines ""q"""\n', encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "b.csv")).collect()] == [("1", 'two\nlines "q"')]
    (tmp_path / "ndc").mkdir()
    (tmp_path / "ndc" / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "ndc" / "y.pdf").write_bytes(b"<html>")
    assert {(r.stem, r.kind, r.valid) for r in files.documents(spark, str(tmp_path)).collect()} == {("x", "ndc", True), ("y", "ndc", False)}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "net_zero__South_Africa.json").write_text('{"score": 0.5}')
    r = files.read_reports(spark, str(tmp_path / "r")).first()
    assert (r.report_dimension, r.report_entity, r.score) == ("net_zero", "South Africa", 0.5)
    assert files.read_optional(spark, str(tmp_path / "none.json"), schema).count() == 0
    plan = spark.createDataFrame([("l", ["u1", "u2"]), ("m", ["u1"])], "label string, urls array<string>")
    got = {r.label: (r.url, r.status) for r in files.download(plan, lambda u: b"%PDF-x" if u == "u2" else b"no").collect()}
    assert got == {"l": ("u2", "ok"), "m": (None, "failed")}


def test_ingestion_is_incremental(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "doc_id long, text string"
    prose = "some honest prose about several topics that reads well and keeps going until it is done"
    spark.createDataFrame([(1, prose), (2, None)], schema).write.parquet(src)
    incremental.ingest(spark, src, out, state, schema).awaitTermination(120)
    spark.createDataFrame([(2, prose), (3, "a-\nb " + prose)], schema).write.mode("append").parquet(src)
    incremental.ingest(spark, src, out, state, schema).awaitTermination(120)
    assert sorted((r.doc_id, r.garbled) for r in upsert.read(spark, out, "doc_id long, text string, garbled boolean").collect()) == [(1, False), (2, True), (3, False)]
    assert [(r.rows, r.inserted, r.known) for r in upsert.ingest_report(spark, out).collect()] == [(2, 2, 0), (2, 1, 1)]


def test_passes(spark):
    from siltstone.operators import passes

    cells = spark.createDataFrame([(f"e{i}", i, "d", f"evidence {i}", "benchmark") for i in range(12)], "entity string, position int, dimension string, evidence string, benchmark string")
    out = {r.entity: r for r in passes.analyse(cells, passes.stand_in).collect()}
    assert len(out) == 12 and {r.status for r in out.values()} >= {"ok", "no findings parsed"}
    for r in out.values():
        assert len(r.commitments) <= 1  # repeated texts are one
        assert (r.score is None) == (r.status == "no findings parsed" or r.label == "ABSENT")
        assert all(f.gap_type == "missing_commitment" for f in r.gap_findings)
    analyses = passes.analyse(cells, passes.stand_in)
    scored = sum(r.score is not None for r in out.values())
    assert passes.compare(analyses).count() == scored * (scored - 1) // 2
    assert passes.report(analyses).first().scored == scored


def test_metadata(spark):
    from siltstone.operators import metadata

    docs = spark.createDataFrame([("NDC2_2021_South_Africa",), ("AR6_SPM",), ("known",)], "stem string")
    known = spark.createDataFrame([("known", 1, 2016, "India")], "stem string, cycle int, year int, country string")
    got = {r.stem: (r.cycle, r.year, r.country) for r in metadata.with_metadata(docs, known).collect()}
    assert got == {"NDC2_2021_South_Africa": (2, 2021, "South Africa"), "AR6_SPM": (6, None, None), "known": (1, 2016, "India")}
    eu = spark.createDataFrame([("a", "EU"), ("b", "India")], "doc string, country string")
    alias = spark.createDataFrame([("EU", "France"), ("EU", "Italy")], "entity string, alias string")
    assert sorted((r.doc, r.country) for r in metadata.expand_aliases(eu, alias).collect()) == [("a", "EU"), ("a", "France"), ("a", "Italy"), ("b", "India")]
    chunks = spark.createDataFrame([("D", 1, "X", 2020, "s"), ("D", 0, "Y", 2021, "t")], "doc_id string, chunk_index int, country string, year int, source string")
    cites = spark.createDataFrame([("D", 3), ("E", 1)], "doc string, page int")
    assert {r.doc: r.country for r in metadata.cite(cites, chunks).collect()} == {"D": "Y", "E": None}
    names = metadata.match_names(spark.createDataFrame([("usa",), ("UK",), ("x",)], "name string"), spark.createDataFrame([("USA",), ("UK",), ("uk",)], "name string"))
    assert {r.name: r.found for r in names.collect()} == {"usa": "USA", "UK": "UK", "x": None}
    done = spark.createDataFrame([("a", "d")], "entity string, dimension string")
    assert metadata.unfinished(spark.createDataFrame([("a", "d"), ("b", "d")], "entity string, dimension string"), done).first().entity == "b"


def test_ngrams_are_linear_and_whole(spark):
    import time

    from siltstone.operators import evaluation

    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(evaluation.ngrams(F.col("t"), 2)).collect()] == [["a b", "b c"], [], []]
    assert df.select(evaluation.ngrams(F.col("t"), 3)).first()[0] == ["a b c"]
    long = " ".join(f"w{i % 5000}" for i in range(64_000))
    pairs = spark.createDataFrame([(1, long, long + " x")], "id int, hyp string, ref string")
    start = time.perf_counter()
    got = {r.n: r for r in evaluation.rouge(pairs).collect()}
    assert time.perf_counter() - start < 20 and got[2].precision == 1.0 and abs(got[2].recall - 63_999 / 64_000) < 1e-12


def test_first_commitments_of_each_beginning(spark):
    from siltstone.operators import passes

    kind = passes.COMMITMENTS[len("struct<commitments:") : -1]
    a, b = "x" * 100, "y" * 100
    rows = [[(t, "5", "2030", None, None) for t in (b + "1", a + "1", b + "2", None, a + "2", "short", None)]]
    df = spark.createDataFrame([(r,) for r in rows], f"c {kind}")
    assert [x.text for x in df.select(passes.unique_commitments(F.col("c"))).first()[0]] == [b + "1", a + "1", None, "short"]


def test_stored_index_is_reused_and_follows_the_content(spark, tmp_path):
    docs = spark.createDataFrame([(1, "gaps in plans"), (2, None), (3, "plans plans")], "doc_id long, text string")
    first, again = (sparse.sparse_index(docs, str(tmp_path)) for _ in range(2))
    assert first.built and not again.built and (again.n_docs, again.avgdl) == (3, 4 / 3)
    assert {(r.doc_id, r.term, r.tf, r.dl) for r in again.postings.collect()} == {(1, "gaps", 1, 2), (1, "plans", 1, 2), (3, "plans", 2, 2)}
    changed = sparse.sparse_index(docs.unionByName(docs.where("doc_id = 3")), str(tmp_path))
    assert changed.built and changed.n_docs == 4
    assert sparse.sparse_index(docs.orderBy("text"), str(tmp_path)).built is False
    empty = sparse.sparse_index(docs.where("false"), str(tmp_path))
    asked = spark.createDataFrame([(7, "plans")], "query_id long, text string")
    assert empty.n_docs == 0 and sparse.bm25_topk(asked, docs.where("false"), empty, 3).count() == 0


def pages_of(*texts):
    return [("d", i + 1, t, i == 3) for i, t in enumerate(texts)]


def test_page_chunks(spark):
    """Sections are chunked by themselves and numbered through the document; overlap stays within a section."""
    rows = pages_of("Opening words. Second words here.", "Chapter 2 Plans\nOne two three. Four five six. Seven eight nine.", None, "Ten eleven. Twelve.", "   ", "Chapter 6 End\nLast one.")
    rows += [("e", 1, "", False), ("f", 1, "Chapter 1 Only\n\nA b c.", True)]
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string, has_table boolean").repartition(4)
    meta = spark.createDataFrame([("d", "FR", 2020, 7)], "doc_id string, country string, year int, other int")
    got = {r.chunk_id: r for r in chunking.page_chunks(pages, meta, least=2, most=8).collect()}
    assert sorted(got) == [*(f"d__0000{i}" for i in range(5)), "f__00000"]
    assert [got[f"d__0000{i}"].section for i in range(5)] == ["Introduction", "Chapter 2 Plans", "Chapter 2 Plans", "Chapter 2 Plans", "Chapter 6 End"]
    assert [got[f"d__0000{i}"].page_start for i in range(5)] == [1, 2, 2, 2, 6]
    assert [got[f"d__0000{i}"].is_table for i in range(5)] == [True, True, True, True, False]
    assert all(r.token_count <= 8 * 1.2 and r.char_count == len(r.text) for r in got.values())
    assert got["d__00000"].country == "FR" and got["d__00004"].year == 2020 and got["f__00000"].country is None and got["f__00000"].pipeline_ver == "1.0"
    words = " ".join(got[f"d__0000{i}"].text for i in (1, 2, 3))
    assert all(w in words for w in ("One", "nine.", "Ten", "Twelve."))
    assert chunking.page_chunks(pages.where("false")).count() == 0


def test_token_counts_of_tokenizers(spark):
    """Chunks by a public tokenizer's counts stay within the budget that white-space counts would break."""
    import public_tokenizers

    text = " ".join(f"Internationalisation number {i} goes on." for i in range(40))
    docs = spark.createDataFrame([("a", text)], "doc_id string, text string")
    for kind, name in (("tokenizers", "byte_bpe_50k.json"), ("sentencepiece", "piece_bpe_32k.model")):
        count = chunking.tokenizer_count(kind, public_tokenizers.path(name))
        got = chunking.chunks(docs, count=count, least=16, most=64).collect()
        assert len(got) > 3 and all(r.token_count == count(r.text) and r.token_count <= 64 * 1.2 for r in got)
    with pytest.raises(ValueError):
        chunking.tokenizer_count("none", "x")("text")


@pytest.mark.parametrize("n", [1, 5, 40])
def test_bounded_search_equals_the_whole_one(spark, tmp_path, n):
    """Skewed words, ties and repeats: bounds leave out postings, and no row of the result."""
    import random

    rng = random.Random(n)
    words = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=k))
    rows = [(i, text(rng.randint(0, 40))) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(12)] + [(2000, None), (2001, "w59 " * 30 + "w58 w57")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "w0 w1 w2 w59 w58 w57"), (1, rows[7][1]), (2, "w0"), (3, "unknown"), (4, "w40 w41 w0 w0 w0"), (5, text(30))], "query_id long, text string")
    index = sparse.sparse_index(docs, str(tmp_path))
    whole, bounded = ([tuple(r) for r in sparse.bm25_topk(asked, docs, index, n, bounded_postings=limit).orderBy("query_id", "rank").collect()] for limit in (10**9, 0))
    assert whole == bounded and len(whole) == 6 * n
    every, needed, looked = sparse.postings_read(asked, index, n)
    assert 0 < needed + looked <= every and (n > 1 or needed + looked < 0.8 * every)


def test_common_terms_lie_in_many_files(spark, tmp_path):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("common "), F.col("id").cast("string"), F.lit(" other")).alias("text"))
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = sparse.sparse_index(docs, str(tmp_path / "index"), version=sparse.files(docs))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in index.postings.groupBy(F.input_file_name()).count().collect()]
    assert index.built and len(sizes) > 2 and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert sparse.sparse_index(docs, str(tmp_path / "index"), version=sparse.files(docs)).built is False
    # an unfinished build is passed over, an old version removed
    home = next((tmp_path / "index").iterdir())
    (home / "0unfinished" / "postings").mkdir(parents=True)
    assert sparse.sparse_index(docs, str(tmp_path / "index"), version=sparse.files(docs)).built is False
    assert sparse.drop_indexes(spark, str(tmp_path / "index"), keep=sparse.files(docs)) == 0 and sparse.drop_indexes(spark, str(tmp_path / "index")) == 1


def test_cycles_and_benchmark_defaults(spark):
    from siltstone.operators import metadata

    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2), ("d", None)], "stem string, ndc_cycle int")
    assert sorted(map(tuple, chunking.cycle_report(rows).collect())) == [("NDC1", 1), ("NDC2", 2)]
    known = spark.createDataFrame([("a", "SPM", "WG1", 2021), ("b", None, "WG2", None)], "stem string, doc_type string, wg string, year int")
    got = {r.stem: tuple(r)[2:] for r in metadata.with_benchmark_metadata(rows.where("stem < 'd'"), known).collect()}
    assert got == {"a": ("SPM", "WG1", "", 2021, None, None), "b": ("IPCC_AR6", "WG2", "", None, None, None), "c": ("IPCC_AR6", "Unknown", "", None, None, None)}


def test_forms_questions_and_citations(spark):
    from siltstone.functions import predicate
    from siltstone.functions import text as T
    from siltstone.operators import passes

    assert predicate.one_of(a=[], b=["x"]) == {"b": "x"} and predicate.one_of(a=[1, 2], b=["x"]) == {"$and": [{"a": {"$in": [1, 2]}}, {"b": "x"}]} and predicate.one_of(a=[]) == {}
    df = spark.createDataFrame([("see [doc_1, p.3] and [no]", list(range(10)))], "t string, n array<int>")
    r = df.select(T.highlight_citations(F.col("t")).alias("h"), T.truncate_tokens(F.col("n"), 6, 2).alias("c"), T.truncate_tokens(F.col("n"), 10, 2).alias("whole")).first()
    assert r.h == "see <b>[doc_1, p.3]</b> and [no]" and r.c == [0, 1, 6, 7, 8, 9] and len(r.whole) == 10
    asked = spark.createDataFrame([("India", ["solar", "wind", "grid", "coal", "gas"])], "e string, k array<string>")
    assert asked.select(passes.search_text(F.col("e"), F.col("k"), "targets").alias("s")).first().s == "India solar wind grid coal targets"


def test_fusion_weights(spark):
    a = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id long, doc_id long, score double, rank long")
    b = spark.createDataFrame([(1, 11, 5.0, 1), (1, 12, 4.0, 2)], "query_id long, doc_id long, score double, rank long")
    got = {r.doc_id: r.rrf_score for r in retrieval.fuse(a, b, 60.0, dense_weight=2.0, sparse_weight=0.5).collect()}
    assert got == {10: round(2 / 61, 6), 11: round(2 / 62 + 0.5 / 61, 6), 12: round(0.5 / 62, 6)}
