"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text there is exactly one token that its encoding can end with, and
an encoding is right exactly if each two neighbours are *compatible*: no merge across their
border would have come before the merges that built them.  So the encoder walks the text
once.  An Aho-Corasick automaton names the pieces that end at each place; the one that is
compatible with the token stored for the prefix before it is stored for this prefix.  The
ids are then read backwards from the last prefix.

Compatibility is decided by undoing merges at the border, latest first, and looking for a
piece that would have joined the two sides earlier.  Results are remembered per pair.

A text is first cut where no piece can span: between two characters that stand next to each
other in no piece.  Encodings of the resulting segments are remembered in a cache of bounded
size, as words recur.
"""

from __future__ import annotations

import codecs
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aliased, in_arrow, prepare, text_of

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; bytes for length-delimited fields."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            if data[i] < 128:
                return value, i + 1
            shift, i = shift + 7, i + 1

    i = 0
    while i < len(data):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        elif key & 7 == 2:
            n, i = varint(i)
            value, i = data[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[key & 7]
            value, i = data[i : i + n], i + n
        yield key >> 3, value


@dataclass
class PieceModel:
    """Pieces, scores, types and the flags that matter, read from a model file's bytes."""

    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = 1
    byte_fallback: bool = False
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    charsmap: bytes = b""
    unk_surface: str = " ⁇ "

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        m = cls()
        for number, value in _fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                m.pieces.append(piece)
                m.scores.append(score)
                m.types.append(kind)
            elif number == 2:
                for k, v in _fields(value):
                    if k == 3:
                        m.model_type = v
                    elif k == 24 and v:
                        raise ValueError("white space as a suffix is not supported")
                    elif k == 35:
                        m.byte_fallback = bool(v)
                    elif k == 44:
                        m.unk_surface = v.decode()
            elif number == 3:
                for k, v in _fields(value):
                    if k == 2:
                        m.charsmap = v
                    elif k == 3:
                        m.add_dummy_prefix = bool(v)
                    elif k == 4:
                        m.remove_extra_whitespaces = bool(v)
                    elif k == 5 and not v:
                        raise ValueError("unescaped white space is not supported")
        if m.charsmap:
            raise ValueError("only the identity normaliser is supported")
        return m

    def normalise(self, text: str) -> str:
        if self.remove_extra_whitespaces:
            text = re.sub(" +", " ", text.strip(" "))
        if text and self.add_dummy_prefix:
            text = " " + text
        return text.replace(" ", SPACE)


class Cache(dict):
    """A dictionary that makes missing values and keeps two generations of at most ``most`` keys."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceDecoder:
    """Decoder for one model of either kind; ``data`` are the bytes of its file."""

    def __init__(self, data: bytes):
        m = self.model = PieceModel.parse(data)
        kinds = {CONTROL: lambda p: b"", UNKNOWN: lambda p: m.unk_surface.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)])}
        self.raw = [kinds.get(k, lambda p: p.replace(SPACE, " ").encode())(p) for p, k in zip(m.pieces, m.types, strict=True)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are not UTF-8 each become U+FFFD, the dummy space goes."""
        codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))
        out = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "each-byte")
        first = next((i for i in ids if self.model.types[i] != CONTROL), None)
        if first is not None and (self.model.add_dummy_prefix or self.model.remove_extra_whitespaces) and self.model.pieces[first].startswith(SPACE):
            out = out.lstrip(" ") if self.model.remove_extra_whitespaces else out[1:]
        return out


#: Letters after which nothing but such a letter continues a piece, if a vocabulary allows that.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"


def adjacent(pieces) -> frozenset[str]:
    """All pairs of characters that stand next to each other in a piece."""
    return frozenset(p[i : i + 2] for p in pieces for i in range(len(p) - 1))


def cutter(pairs: frozenset[str], runs: bool = True) -> re.Pattern | None:
    """A pattern that finds segments which no piece crosses, as fine as these pairs allow; none if there is no simple one.

    Without ``runs`` every space mark begins a segment of its own.
    """
    space, spaces = (f"{SPACE}*", f"{SPACE}+") if runs else (f"{SPACE}?", SPACE)
    if any(p[1] == SPACE != p[0] or "\n" in p for p in pairs):
        return None
    letter = re.compile(f"[{LETTERS}]")
    if any(letter.match(p[0]) and not letter.match(p[1]) for p in pairs):
        return re.compile(f"{space}[^{SPACE}\n]+|\n|{spaces}")
    return re.compile(f"{space}[^{SPACE}\n{LETTERS}]*[{LETTERS}]+|{space}[^{SPACE}\n{LETTERS}]+|\n|{spaces}")


#: Segments that a worker remembers while it works on a partition, in either of two generations: some 60 MB.
CACHED = 120_000


class PieceBPE:
    """Encoder for one BPE model; ``data`` are the bytes of its file."""

    def __init__(self, data: bytes, cached: int = CACHED, longest: int = 64):
        m = self.model = PieceModel.parse(data)
        if m.model_type != 2 or UNUSED in m.types or USER_DEFINED in m.types:
            raise ValueError("needs a BPE model without unused and user-defined pieces")
        self.ids = {p: i for i, p in enumerate(m.pieces) if m.types[i] == NORMAL}
        self.bytes_at = {int(p[3:5], 16): i for i, p in enumerate(m.pieces) if m.types[i] == BYTE}
        self.unk = m.types.index(UNKNOWN)
        self.longest = longest
        self.words = Cache(lambda s: array("i", self._segment(s)).tobytes(), cached)
        self.fits = Cache(self._compatible, 2 * cached)
        self.size = len(m.pieces)
        #: (left id * size + right id) -> id of the piece that the two make
        self.joins = {
            a * self.size + b: i
            for p, i in self.ids.items()
            for k in range(1, len(p))
            if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None
        }
        #: what each token's last merge joined; -1 for characters
        self.left, self.right = [-1] * self.size, [-1] * self.size
        #: tokens that merging their own characters gives
        self.reachable = {i for p, i in self.ids.items() if self._trace(p, i)}

    # -- cutting into segments ---------------------------------------------------------------

    @cached_property
    def pairs(self) -> frozenset[str]:
        return adjacent(self.ids)

    @cached_property
    def cutter(self) -> re.Pattern | None:
        return cutter(self.pairs)

    def segments(self, text: str) -> list[str]:
        if self.cutter:
            return self.cutter.findall(text)
        at = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.pairs]
        return [text[a:b] for a, b in zip([0, *at], [*at, len(text)], strict=True) if a < b]

    # -- merges ------------------------------------------------------------------------------

    def _trace(self, piece: str, token: int) -> bool:
        """Merges a piece's characters, keeping what the last merge joined; whether the piece results."""
        out = [self.ids.get(c, -1) for c in piece]
        scores, size, a, b = self.model.scores, self.size, -1, -1
        while len(out) > 1:
            best = max(((scores[t], -k, t) for k in range(len(out) - 1) if (t := self.joins.get(out[k] * size + out[k + 1])) is not None and out[k] >= 0 <= out[k + 1]), default=None)
            if best is None:
                return False
            k = -best[1]
            a, b = out[k], out[k + 1]
            out[k : k + 2] = [best[2]]
        self.left[token], self.right[token] = a, b
        return out == [token]

    def _compatible(self, pair: int) -> bool:
        """Whether the two tokens of ``pair`` stay apart when their characters are merged together.

        Going back in time, the border lies between the last part of the left and the first
        part of the right token.  A merge over it counts if it comes before the later of the
        two merges that hid those parts; of equal merges the one further left comes first.
        """
        scores, left, right, joins, size = self.model.scores, self.left, self.right, self.joins, self.size
        a, b = divmod(pair, size)
        above, ties = float("-inf"), False  # a merge over the border must score more, or as much if `ties`
        while True:
            joined = joins.get(a * size + b)
            if joined is not None and (scores[joined] > above or ties and scores[joined] == above):
                return False
            if left[a] < 0 and left[b] < 0:
                return True
            # undo the later merge: the one with the lower score, and of equals the right one
            if left[b] < 0 or left[a] >= 0 and scores[a] < scores[b]:
                above, ties, a = scores[a], False, right[a]
            else:
                above, ties, b = scores[b], True, left[b]

    @cached_property
    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for i in self.reachable:
            p = self.model.pieces[i]
            auto.add_word(p, (i, len(p)))
        auto.make_automaton()
        return auto

    def prefix_table(self, text: str) -> list[int]:
        """For each prefix length from 1 the last token; every character of ``text`` must be a piece."""
        last, fits, size, done = [-1] * (len(text) + 1), self.fits, self.size, -1
        for end, (token, n) in self.automaton.iter(text):  # at one end, longer pieces first
            if end != done:
                before = last[end - n]  # at the start: last[-1], which is still -1
                if n > end or fits[before * size + token]:
                    last[end], done = token, end
        return last[:-1]

    def _known(self, text: str) -> list[int]:
        table, pieces = self.prefix_table(text), self.model.pieces
        out, at = [], len(text)
        while at:
            token = table[at - 1]
            out.append(token)
            at -= len(pieces[token])
        return out[::-1]

    def _segment(self, text: str) -> tuple[int, ...]:
        """Ids of one segment; characters outside the vocabulary become bytes or one unknown id each."""
        out: list[int] = []
        at = 0
        for i, c in enumerate(text):
            if c not in self.ids:
                out += self._known(text[at:i])
                out += [self.bytes_at[b] for b in c.encode()] if self.model.byte_fallback else [self.unk]
                at = i + 1
        return tuple(out + self._known(text[at:]))

    # -- whole texts -------------------------------------------------------------------------

    def forget(self) -> None:
        """Empties the caches; what belongs to the model stays."""
        for cache in (self.words, self.fits):
            cache.clear()
            cache.old = {}

    def encode_bytes(self, text: str) -> bytes:
        """The ids as 32-bit numbers in the machine's order, joined from remembered segments."""
        found = self.segments(self.model.normalise(text))
        if max(map(len, found), default=0) <= self.longest:
            return b"".join(map(self.words.__getitem__, found))
        return b"".join(self.words[s] if len(s) <= self.longest else array("i", self._segment(s)).tobytes() for s in found)

    def encode(self, text: str) -> list[int]:
        """The ids of a text, as the library's ``encode`` gives them without sampling or special ids."""
        return array("i", self.encode_bytes(text)).tolist()


@lru_cache(maxsize=2)
def load(data: bytes) -> PieceBPE:
    """One encoder per worker process and model."""
    return PieceBPE(data)


@lru_cache(maxsize=2)
def load_decoder(data: bytes) -> PieceDecoder:
    return PieceDecoder(data)


def read_model(path: str | None = None) -> bytes:
    """The model file's bytes, read on the driver; by default that of the public 32k model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def tokenize(docs: DataFrame, model: bytes, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as an array of ints, ``out``, in place of the text.

    Null counts as the empty text and gives an empty array.  Whole texts are encoded, of any
    length; rows are kept one to one, repeated rows too.  An own column called ``out`` is
    replaced.  The model, half a megabyte, is broadcast.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    given, back = aliased(docs, text, out)
    df = docs.select(*given, text_of(docs, text).alias("text"))
    schema, names = df.drop("text").withColumn("made", F.array().cast("array<int>")).schema, [*df.columns[:-1], "made"]
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(shared.value)
        for b in batches:
            made = [encoder.encode_bytes(t) for t in b.column(b.num_columns - 1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(m) // 4 for m in made])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=names)
        encoder.forget()

    return in_arrow(df, run, schema).select(*back, F.col("made").alias(out))


def detokenize(df: DataFrame, model: bytes, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the array ``ids`` as ``out`` beside it; null ids give the empty text.

    An own column called ``out``, other than ``ids``, is replaced.
    """
    if ids.lower() == out.lower():
        raise ValueError("ids and out must have different names")
    shared = df.sparkSession.sparkContext.broadcast(model)
    given, back = aliased(df, out)
    at = [c.lower() for c in df.columns if c.lower() != out.lower()].index(ids.lower())
    df = df.select(*given)
    schema, names = df.withColumn("made", F.lit("").cast("string")).schema, [*df.columns, "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load_decoder(shared.value).decode
        for b in batches:
            lists = b.column(at)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).tolist(), lists.offsets.to_pylist()
            spans = zip(offsets, offsets[1:], lists.is_valid().to_pylist(), strict=False)
            texts = [decode(flat[i:j]) if there else "" for i, j, there in spans]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=names)

    return in_arrow(df, run, schema).select(*back, F.col("made").alias(out))
