import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import tiff


@settings(max_examples=60, deadline=None)
@given(st.one_of(st.binary(max_size=3000), st.lists(st.sampled_from([b"a" * 200, b"bc", b"\0"]), max_size=40).map(b"".join)))
def test_packbits_and_lzw_round_trip(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_streams():
    # the PackBits example of the format's description, and an LZW stream worked by hand
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    assert tiff.unpack_bits(packed).hex() == "aaaaaa80002aaaaaaaaa80002a22" + "aa" * 10
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 257))
    assert tiff.lzw_decode(int(bits.ljust(48, "0"), 2).to_bytes(6, "big")) == bytes([7, 7, 7, 8])


def test_lzw_over_full_tables():
    data = np.random.default_rng(0).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
def test_pages_round_trip(order, compression, predictor, tile):
    rng = np.random.default_rng(4)
    own = [rng.integers(0, 256, (37, 50), dtype=np.uint8), rng.integers(0, 256, (16, 32, 3), dtype=np.uint8), rng.integers(0, 60000, (20, 21), dtype=np.uint16)]
    got = list(tiff.read(tiff.write(own, compression, predictor, rows_per_strip=7, tile=tile, order=order)))
    assert len(got) == 3
    for a, p in zip(own, got, strict=True):
        assert (p.pixels == np.atleast_3d(a)).all()


def test_columns(spark):
    from siltstone.llm.queries import tiff as module

    long = "é" * 100_000
    rows = [(1, "hello", 1), (2, "", 2), (3, None, 3), (4, long, 4), (None, "hello", 5), (5, "x" * 576, 6), (6, "x" * 577, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, page_ int")
    out = module.pages(module.store(df)).collect()
    assert len(out) == len(rows)
    for r, (i, t, k) in zip(sorted(out, key=lambda r: r.page_), rows, strict=True):
        want = (t or "").encode()
        want += b"\xff" * (-len(want) % 576 if want else 576)
        assert (r.doc_id, r.page_, r.n_bytes, bytes(r.pixels)) == (i, k, len((t or "").encode()), want)
        assert (r.page, r.width, r.height, r.error) == (0, 576, len(want) // 576, None)
    assert len({bytes(r.media) for r in out if bytes(r.pixels)[:5] == b"hello"}) == 1
    assert module.pages(module.store(df.where("false"))).count() == 0


def test_damaged_files(spark):
    good = tiff.write([np.zeros((4, 4), np.uint8), np.ones((4, 4), np.uint8)])
    circle = bytearray(good)
    rows = [(1, None), (2, b""), (3, b"II*\0\xff\0\0\0"), (4, good), (5, good[:60]), (6, b"%PDF-")]
    out = tiff.pages(spark.createDataFrame(rows, "id int, media binary")).collect()
    assert sorted(r.page for r in out if r.id == 4) == [0, 1]
    assert all(r.error for r in out if r.id != 4 and r.page is None)
    assert {r.id for r in out} == {1, 2, 3, 4, 5, 6} and len(circle) == len(good)


def test_query(spark, data):
    from siltstone.llm.queries import op10_tiff

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in op10_tiff(spark, data).collect():
        p = tiff.payload(texts[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


@pytest.mark.parametrize("tag, value", [(256, 0), (257, 0), (278, 0), (277, 0), (256, 2**31 - 1), (257, 2**31 - 1), (258, 3), (259, 7)])
def test_forged_directories_give_an_error(spark, tag, value):
    good = bytearray(tiff.write([np.arange(64, dtype=np.uint8).reshape(8, 8)], tiff.DEFLATE, 1, rows_per_strip=4))
    (at,) = __import__("struct").unpack_from("<I", good, 4)
    for i in range(int.from_bytes(good[at : at + 2], "little")):
        entry = at + 2 + 12 * i
        if int.from_bytes(good[entry : entry + 2], "little") == tag:
            good[entry + 2 : entry + 4] = (4).to_bytes(2, "little")
            good[entry + 8 : entry + 12] = value.to_bytes(4, "little")
    (row,) = tiff.pages(spark.createDataFrame([(1, bytes(good))], "id int, media binary")).collect()
    assert row.page is None and row.error


def test_missing_strips_and_long_streams():
    pixels = np.arange(64, dtype=np.uint8).reshape(8, 8)
    good = tiff.write([pixels], tiff.DEFLATE, 1, rows_per_strip=4)
    directory = tiff._directory(good, "<", int.from_bytes(good[4:8], "little"))[0]
    with pytest.raises(ValueError):
        tiff._page(good, "<", directory | {tiff.STRIP_OFFSETS: directory[tiff.STRIP_OFFSETS][:1], tiff.STRIP_COUNTS: directory[tiff.STRIP_COUNTS][:1]})
    assert len(tiff.decompress(zlib.compress(bytes(10**7)), tiff.DEFLATE, 100)) == 100


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, "hello", 1, 2, 3, 4)], "doc_id long, text string, N_bytes int, page int, `a.b` int, c0 int")
    got = tiff.pages(tiff.store(df))
    assert got.columns[:5] == ["doc_id", "a.b", "c0", "n_bytes", "media"] and got.columns.count("page") == 1
    assert got.select("doc_id", "`a.b`", "c0", "n_bytes", "page").first() == (1, 3, 4, 5, 0)
    with pytest.raises(ValueError):
        tiff.pages(df.withColumn("pixels", df.text.cast("binary")), "pixels")
