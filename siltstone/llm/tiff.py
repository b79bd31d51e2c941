"""TIFF media columns: a lossless writer for bytes and a reader of pages.

The reader walks the chain of image directories of either byte order, fetches strips or
tiles, undoes PackBits, LZW or deflate and the horizontal predictor, and gives one row a
page.  It reads 8- and 16-bit unsigned samples, contiguous or in planes.  A damaged file
gives one row with an error and no page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aliased, in_arrow, prepare

#: Tags and codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


# -- compression ---------------------------------------------------------------------------


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + k + 2]
            i += k + 2
        else:
            if k > 128:
                out += data[i + 1 : i + 2] * (257 - k)
            i += 2 if k > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more equal bytes as repeats, the rest as literals."""
    out, i, n, start = bytearray(), 0, len(data), 0

    def literal(a: int, b: int) -> None:
        for k in range(a, b, 128):
            part = data[k : min(b, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while i < n:
        j = i + 1
        while j < n and data[j] == data[i] and j - i < 128:
            j += 1
        if j - i >= 3:
            literal(start, i)
            out += bytes([257 - (j - i), data[i]])
            start = j
        i = j
    literal(start, n)
    return bytes(out)


CLEAR, STOP = 256, 257


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widening one code early."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    out, held, bits, width, last = [], 0, 0, 9, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == CLEAR:
            del table[258:]
            width, last = 9, None
        elif code == STOP:
            break
        else:
            if last is None:
                if code > 255:
                    raise ValueError("LZW data begins with an unknown code")
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(last + entry[:1])
            elif code == len(table):
                entry = last + last[:1]
                table.append(entry)
            else:
                raise ValueError("LZW code out of range")
            out.append(entry)
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[bytes, int] = {}
    held = bits = 0
    out, width, following = bytearray(), 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            word = longer
            continue
        put(codes[word] if len(word) > 1 else word[0])
        codes[longer] = following
        following += 1
        if following in (512, 1024, 2048):
            width += 1
        elif following == 4095:
            put(CLEAR)
            codes, width, following = {}, 9, 258
        word = data[i : i + 1]
    if word:
        put(codes[word] if len(word) > 1 else word[0])
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(STOP)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def compress(data: bytes, method: int, level: int = 6) -> bytes:
    return {NONE: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: lzw_encode(data)}.get(method, lambda: zlib.compress(data, level))()


def decompress(data: bytes, method: int, most: int) -> bytes:
    """The bytes of a strip or tile; of a deflate stream no more than ``most``."""
    if method not in (NONE, PACKBITS, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"compression {method} is not supported")
    return {NONE: lambda: data, PACKBITS: lambda: unpack_bits(data), LZW: lambda: lzw_decode(data)}.get(method, lambda: zlib.decompressobj().decompress(data, most))()


# -- pages -----------------------------------------------------------------------------------


@dataclass
class Page:
    """One image directory: ``pixels`` are (height, width, samples), ``info`` what was stored."""

    pixels: np.ndarray
    info: dict = field(default_factory=dict)


def _differences(a: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return a
    out = a.copy()
    out[:, 1:] -= a[:, :-1]
    return out


def write(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 6) -> bytes:
    """A file of pages, each (height, width) or (height, width, samples) of 8- or 16-bit samples.

    Strips of ``rows_per_strip`` rows, or tiles of ``tile`` (height, width), multiples of 16.
    """
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        a = np.atleast_3d(page)
        h, w, s = a.shape
        bits = a.dtype.itemsize * 8
        a = a.astype(a.dtype.newbyteorder(order))
        if tile:
            th, tw = tile
            padded = np.zeros((-(-h // th) * th, -(-w // tw) * tw, s), a.dtype)
            padded[:h, :w] = a
            parts = [padded[y : y + th, x : x + tw] for y in range(0, h, th) for x in range(0, w, tw)]
        else:
            parts = [a[y : y + rows_per_strip] for y in range(0, h, rows_per_strip)]
        offsets, counts = [], []
        for part in parts:
            data = compress(_differences(part, predictor).tobytes(), compression, level)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        entries = [
            (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [bits] * s), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [2 if s >= 3 else 1]),
            (SAMPLES, 3, [s]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor]),
        ]
        entries += [(TILE_WIDTH, 4, [tile[1]]), (TILE_HEIGHT, 4, [tile[0]]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows_per_strip]), (STRIP_COUNTS, 4, counts)]
        values = []
        for tag, kind, v in sorted(entries):
            packed = struct.pack(order + ("H" if kind == 3 else "I") * len(v), *v)
            if len(packed) > 4:
                values.append((tag, kind, len(v), struct.pack(order + "I", len(out))))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                values.append((tag, kind, len(v), packed.ljust(4, b"\0")))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(values)) + b"".join(struct.pack(order + "HHI", *v[:3]) + v[3] for v in values)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        size = TYPE_SIZES.get(kind, 0) * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if kind in (1, 3, 4) and size:
            tags[tag] = struct.unpack_from(order + {1: "B", 3: "H", 4: "I"}[kind] * count, data, place)
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def _page(data: bytes, order: str, tags: dict[int, tuple]) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, s = tags[WIDTH][0], tags[HEIGHT][0], one(SAMPLES, 1)
    bits, method, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if min(w, h, s, one(ROWS_PER_STRIP, 1), one(TILE_WIDTH, 1), one(TILE_HEIGHT, 1)) < 1:
        raise ValueError("a page without samples")
    if bits not in (8, 16) or predictor not in (1, 2) or one(SAMPLE_FORMAT, 1) != 1:
        raise ValueError(f"{bits}-bit samples with predictor {predictor} are not supported")
    kind = np.dtype("u1" if bits == 8 else order + "u2")
    planes = s if one(PLANAR, 1) == 2 and s > 1 else 1
    deep = s // planes
    if TILE_OFFSETS in tags:
        ph, pw, offsets, counts = tags[TILE_HEIGHT][0], tags[TILE_WIDTH][0], tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        ph, pw, offsets = min(one(ROWS_PER_STRIP, h), h), w, tags[STRIP_OFFSETS]
        counts = tags.get(STRIP_COUNTS) or (len(data) - offsets[0],)
    down, across = -(-h // ph), -(-w // pw)
    if len(offsets) != planes * down * across or len(counts) != len(offsets):
        raise ValueError(f"{len(offsets)} strips or tiles in place of {planes * down * across}")
    # a page is laid out only when all its parts are there, so that forged sizes claim no memory
    parts = []
    for i, (at, n) in enumerate(zip(offsets, counts, strict=True)):
        rows = ph if TILE_OFFSETS in tags else min(ph, h - i % (down * across) // across * ph)
        raw = decompress(data[at : at + n], method, rows * pw * deep * kind.itemsize)
        part = np.frombuffer(raw, kind, rows * pw * deep).reshape(rows, pw, deep).astype(kind.newbyteorder("="))
        parts.append(np.cumsum(part, axis=1, dtype=part.dtype) if predictor == 2 else part)
    pixels = np.empty((h, w, s), kind.newbyteorder("="))
    for i, part in enumerate(parts):
        plane, k = divmod(i, down * across)
        y, x = k // across * ph, k % across * pw
        pixels[y : y + ph, x : x + pw, plane * deep : (plane + 1) * deep] = part[: h - y, : w - x]
    return Page(pixels, {"width": w, "height": h, "samples": s, "bits": bits, "compression": method, "predictor": predictor, "tiled": TILE_OFFSETS in tags})


def read(data: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2) != (42,):
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("the directories form a circle")
        seen.add(at)
        tags, following = _directory(data, order, at)
        yield _page(data, order, tags)
        at = following


# -- columns ---------------------------------------------------------------------------------

PAD, UNIT = 255, 576


def payload(text: str | None) -> bytes:
    """The UTF-8 bytes of a text, filled with 255 up to a positive multiple of 576."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % UNIT if raw else UNIT)


def store(docs: DataFrame, text: str = "text", out: str = "media", level: int = 1) -> DataFrame:
    """``docs`` with each text as a one-page file in the binary column ``out``, and ``n_bytes``.

    The page is 576 samples wide, in deflated strips of 64 rows with the horizontal
    predictor.  Null counts as empty.  Texts are stored whole; the text column goes.  Own
    columns called ``out`` or ``n_bytes`` are replaced.  Rows stay one to one; equal texts have equal files.
    An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    given, back = aliased(docs, text, out, "n_bytes")
    df = docs.select(*given, docs[text].cast("string").alias("text"))
    schema, names = df.drop("text").withColumns({"size": F.lit(0).cast("long"), "made": F.lit(b"").cast("binary")}).schema, [*df.columns[:-1], "size", "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, files = [], []
            for t in b.column(b.num_columns - 1):
                data = payload(t.as_py())
                sizes.append(len((t.as_py() or "").encode("utf-8", "surrogatepass")))
                files.append(write([np.frombuffer(data, np.uint8).reshape(-1, UNIT)], level=level))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=names)

    return in_arrow(df, run, schema).select(*back, F.col("size").alias("n_bytes"), F.col("made").alias(out))


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, mean double, deviation double, error string"


def pages(files: DataFrame, media: str = "media") -> DataFrame:
    """One row a page: the columns of ``files`` and those of ``PAGE_FIELDS``.

    ``pixels`` are the samples in row order, low byte first.  A null or damaged file gives
    the pages before the damage and one row with ``page`` null and an ``error``.  Own columns
    called like one of ``PAGE_FIELDS`` are replaced; ``media`` must not be called so.  Repeated files
    give their pages again.  An empty table gives no rows.
    """
    prepare(files.sparkSession)
    import pyspark.sql.types as T

    more = T.StructType.fromDDL(PAGE_FIELDS)
    if media.lower() in more.names:
        raise ValueError(f"{media} is the name of a result")
    given, back = aliased(files, *more.names)
    at = [c.lower() for c in files.columns if c.lower() not in more.names].index(media.lower())
    files = files.select(*given)
    schema, names = T.StructType([*files.schema.fields, *more.fields]), [*files.columns, *more.names]
    kinds = [pa.int32()] * 7 + [pa.bool_(), pa.binary(), pa.float64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, rows, held = [], [], 0

            def flush(b=b):
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*b.take(pa.array(of, pa.int64())).columns, *made], names=names)

            for i, data in enumerate(b.column(at)):
                try:
                    for k, p in enumerate(read(data.as_py() or b"")):
                        raw = p.pixels.astype(p.pixels.dtype.newbyteorder("<")).tobytes()
                        x = p.info
                        of.append(i)
                        rows.append((k, x["width"], x["height"], x["samples"], x["bits"], x["compression"], x["predictor"], x["tiled"], raw, float(p.pixels.mean()), float(p.pixels.std()), None))
                        held += len(raw)
                        if held > 16 << 20:
                            yield flush()
                            of, rows, held = [], [], 0
                except (ValueError, KeyError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                    of.append(i)
                    rows.append((*[None] * 11, str(e) or type(e).__name__))
            if rows:
                yield flush()

    return in_arrow(files, run, schema).select(*back, *more.names)
