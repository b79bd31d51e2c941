"""Token counts of a unigram model, without building tokens.

The best segmentation of a text maximises the sum of its pieces' scores.  An Aho-Corasick
automaton names the vocabulary pieces that end at each place; dynamic programming carries
only the best score and the number of pieces of each prefix.

Ties follow the tokenizers' rule: a later candidate replaces the best only if its score is
greater, and candidates arrive by their start, longest piece first.  A character that no
piece covers scores the least score minus 10; a run of such characters is one unknown token,
or with byte fallback one token for each of their bytes.  Sums are in double precision; the
default vocabulary's scores are whole numbers, so they are exact.

A text is cut before every space first (each word begins with the space mark), with byte
fallback also where no piece continues, and counts are remembered in a cache of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aliased, in_arrow, prepare, text_of
from .piece_bpe import BYTE, NORMAL, SPACE, USER_DEFINED, Cache, PieceModel, adjacent, cutter

UNKNOWN_PENALTY = 10.0


class UnigramCounter:
    """Counts for (piece, score) pairs; pieces use the space mark for spaces."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = False, cached: int = 500_000, longest: int = 64):
        import ahocorasick

        self.byte_fallback, self.longest = byte_fallback, longest
        self.least = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()
        self.singles = {p for p, _ in vocabulary if len(p) == 1}
        self.words = Cache(self.count_word, cached)
        # with bytes for unknown characters, words may be cut where no piece continues
        self.cutter = (cutter(adjacent(p for p, _ in vocabulary), runs=False) if byte_fallback else None) or re.compile(f"{SPACE}[^{SPACE}]*")

    def count_word(self, word: str) -> int:
        """The number of tokens of one word."""
        n = len(word)
        if self.singles.issuperset(word):
            best, pieces = [0.0] + [float("-inf")] * n, [0] * (n + 1)
            for end, (size, score) in self.automaton.iter(word):
                start = end + 1 - size
                s = best[start] + score
                if s > best[end + 1]:
                    best[end + 1], pieces[end + 1] = s, pieces[start] + 1
            return pieces[n]
        # for each prefix: best score, pieces, and whether the last piece is unknown
        best, pieces, unknown = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def uncovered(upto: int) -> None:
            # each character may also be unknown, if no single piece is that character
            nonlocal done
            while done < upto:
                done += 1
                if not single[done]:
                    s = best[done - 1] + self.least
                    longer = best[done]
                    # the unknown character starts last, so it must be greater
                    if longer is None or s > longer:
                        best[done], unknown[done] = s, True
                        if self.byte_fallback:
                            pieces[done] = pieces[done - 1] + len(word[done - 1].encode())
                        else:
                            pieces[done] = pieces[done - 1] + (not unknown[done - 1])

        single = [False] * (n + 1)
        if self.filled:
            for end, (size, score) in self.automaton.iter(word):
                end += 1
                uncovered(end - 1)
                if size == 1:
                    single[end] = True
                start = end - size
                s = best[start] + score
                if best[end] is None or s > best[end]:
                    best[end], pieces[end], unknown[end] = s, pieces[start] + 1, False
        uncovered(n)
        return pieces[n]

    def count(self, text: str) -> int:
        """The number of tokens of a text: a space goes in front unless there is one, then word by word."""
        text = text.replace(" ", SPACE)
        if not text:
            return 0
        if text[0] != SPACE:
            text = SPACE + text
        found = self.cutter.findall(text)
        return sum(self.words[w] if len(w) <= self.longest else self.count_word(w) for w in found)


@lru_cache(maxsize=2)
def load(data: bytes) -> UnigramCounter:
    """A counter over the pieces and scores of a model file, once a worker process."""
    m = PieceModel.parse(data)
    vocabulary = [(p, s) for p, s, k in zip(m.pieces, m.scores, m.types, strict=True) if k in (NORMAL, USER_DEFINED)]
    return UnigramCounter(vocabulary, byte_fallback=BYTE in m.types)


def count_tokens(docs: DataFrame, model: bytes, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens ``out`` (long) in place of ``text``.

    Null counts as empty and has no tokens.  Texts are counted whole; rows stay one to one.
    An own column called ``out`` is replaced.  Repeated rows are counted alike.  Segmentations of equal
    score are told apart by the tokenizers' rule.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    given, back = aliased(docs, text, out)
    df = docs.select(*given, text_of(docs, text).alias("text"))
    schema, names = df.drop("text").withColumn("made", F.lit(0).cast("long")).schema, [*df.columns[:-1], "made"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load(shared.value).count
        for b in batches:
            n = pa.array([count(t.as_py()) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=names)

    return in_arrow(df, run, schema).select(*back, F.col("made").alias(out))
