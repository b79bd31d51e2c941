import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from siltstone.llm import piece_bpe, unigram

TEXTS = ["", " ", "  two  spaces ", "a\n\nb\tc", "é😀▁x", "aaaaaaaaaaaa", "</s>[INST] ok", "\x00\x01", "日本語 text", "Ünïcödé, words. And more!!"]


@pytest.fixture(scope="module")
def data():
    return piece_bpe.read_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def some_texts(pieces):
    rnd = random.Random(1)
    letters = "abcdeth  \n\t▁éñß.!#*日😀\x00THE" + "ij" * 4
    for _ in range(1500):
        yield "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40)))
        yield "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 9))).replace("▁", " ")


def test_encode_and_decode_equal_the_library(data, library):
    bpe, decoder = piece_bpe.PieceBPE(data, cached=500), piece_bpe.PieceDecoder(data)
    for t in [*TEXTS, *some_texts(list(bpe.ids)), "word " * 5000, "x" * 3000]:
        ids = bpe.encode(t)
        assert ids == library.encode(t), t[:80]
        assert decoder.decode(ids) == library.decode(ids), t[:80]


def test_decode_of_any_ids(data, library):
    decoder, rnd = piece_bpe.PieceDecoder(data), random.Random(2)
    for k in range(300):
        ids = [rnd.randrange(3 if k % 2 else 0, 259 if k % 2 else 32000) for _ in range(7)]
        assert decoder.decode(ids) == library.decode(ids)


def test_prefix_table_holds_the_last_token_of_each_prefix(data, library):
    bpe = piece_bpe.PieceBPE(data)
    word = "▁internationalisations"
    assert bpe.prefix_table(word) == [library.encode(word[1:i] if i > 1 else " ")[-1] if i > 1 else bpe.ids["▁"] for i in range(1, len(word) + 1)]


def test_columns(spark, data, library):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "again", "s"), (None, "again", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_ string")
    got = piece_bpe.detokenize(piece_bpe.tokenize(df, data), data)
    assert got.columns == ["doc_id", "decoded_", "ids", "decoded"]
    out = [(r.doc_id, r.ids, r.decoded) for r in got.collect()]
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t, _ in rows]
    assert sorted(map(str, out)) == sorted(map(str, want))
    assert piece_bpe.tokenize(df.where("false"), data).count() == 0


def unigram_library(pieces, fallback):
    extra = [(f"<0x{i:02X}>", -1e6) for i in range(256)] if fallback else []
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *extra, *pieces], unk_id=0, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


@pytest.mark.parametrize("fallback", [False, True])
def test_counts_equal_the_library(data, fallback):
    m = piece_bpe.PieceModel.parse(data)
    pieces = [(p, float(s)) for p, s, k in zip(m.pieces, m.scores, m.types, strict=True) if k == 1]
    lib, own = unigram_library(pieces, fallback), unigram.UnigramCounter(pieces, fallback, cached=300)
    own.least = (-1e6 if fallback else min(s for _, s in pieces)) - 10
    for t in [*TEXTS, *some_texts([p for p, _ in pieces][:4000])]:
        assert own.count(t) == len(lib.encode(t, add_special_tokens=False).ids), t


def test_ties_and_empty_vocabulary():
    # "ab" + "c" and "a" + "bc" score the same: the piece that starts first, "bc" at 1, is met before "c" at 2
    own = unigram.UnigramCounter([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0)])
    lib = unigram_library([("▁", 0.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0)], False)
    for t in ("abc", "ababcc", "bcab"):
        assert own.count(t) == len(lib.encode(t).ids)
    assert unigram.UnigramCounter([]).count("xyz") == 1


def test_count_column(spark, data):
    m = piece_bpe.PieceModel.parse(data)
    lib = unigram_library([(p, float(s)) for p, s, k in zip(m.pieces, m.scores, m.types, strict=True) if k == 1], True)
    n = len(lib.encode("the word", add_special_tokens=False).ids)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the word"), (3, "the word")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in unigram.count_tokens(df, data).collect()) == [(1, 0), (2, 0), (3, n), (3, n)]
    assert unigram.count_tokens(df.where("false"), data).count() == 0


def test_names_that_clash(spark):
    from siltstone.llm import piece_bpe, simhash, unigram

    df = spark.createDataFrame([(1, "some text", "a", 1, 2, 3), (1, None, "b", 1, 2, 3)], "doc_id long, text string, Ids string, n_tokens int, made int, `x.y` int")
    model = piece_bpe.read_model()
    got = piece_bpe.detokenize(piece_bpe.tokenize(df, model), model, out="made")
    assert got.columns == ["doc_id", "n_tokens", "x.y", "ids", "made"]
    assert sorted(r.made for r in got.collect()) == ["", "some text"]
    counted = unigram.count_tokens(df, model)
    assert counted.columns == ["doc_id", "Ids", "made", "x.y", "n_tokens"] and sorted(r.Ids for r in counted.collect()) == ["a", "b"]
    marked = simhash.fingerprints(df, out="MADE")
    assert marked.columns == ["doc_id", "Ids", "n_tokens", "x.y", "MADE"] and 0 in {r.MADE for r in marked.collect()}
    with pytest.raises(ValueError):
        piece_bpe.detokenize(df.selectExpr("doc_id", "array(1) as ids"), model, out="ids")
