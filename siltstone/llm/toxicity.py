"""Toxicity by class-conditional Kneser-Ney language models.

Two bigram models, one of toxic and one of ordinary labelled documents, score every text;
the difference of their log-likelihoods, divided by the length, is the evidence.  Each class
discounts its own pairs by a constant and gives the mass so freed after a context to its word
level: the number of distinct contexts that a word follows in the class, discounted in turn.
What that frees goes to the *shared* continuation counts of all labelled documents, weighed by
how likely the class makes the word's beginning.

A pair counts once a document, and all labelled rows count.  Pairs are counted by one
distributed aggregate; a second one sums them up by word, context and beginning.  Counts up to the
discount are freed whole, so what has no larger count takes no part in the *difference* of
two models.  Just those rows go; the rest, named by 64-bit hashes, are the model.  It grows with the
corpus.  Up to ``MODEL_ROWS`` rows it is broadcast; beyond that only its most frequent rows are, and each
chunk of texts fetches those that it needs of the others, with equal results.

A logistic curve turns evidence into a probability.  It is fitted on at most
``CALIBRATION_ROWS`` labelled rows, each scored without its own counts.
Evidence is the mean over the text's distinct pairs, the highest mean over a window, so that a
short outburst in a long text is not diluted, and the mean of the decisive part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aliased, freed, fresh, handed_over, in_arrow, prepare, quoted, text_of, without
from .labelled import bounded_sample, label_table, lists, logistic, mapped, with_labels

BEGINNING = 4
CALIBRATION_ROWS = 20_000
#: Rows of a model that may be broadcast, about 100 MB.
MODEL_ROWS = 4_000_000
PATTERN = r"[\p{L}\p{N}]+"
WINDOW, PRIOR_WORDS = 64, 8.0
#: Counts that an even split stands for, at a beginning; the discounts, of smaller counts all; the largest log-ratio of a token.
BACKOFF_BEGINNING = 30.0
DISCOUNT_PAIR, DISCOUNT_WORD, DISCOUNT_BEGINNING, CLIP = 2, 3, 1, 6.0
#: Evidence beyond which a token's log-ratio counts as decisive.
DECISIVE = 1.5

#: Kinds of rows: pairs, words, contexts, beginnings, and two of sums over all words.
PAIR, WORD, CONTEXT, BEGIN, SUMS, MORE = range(6)
#: The context of a text's first word, and what marks a count of a beginning among counts of pairs.
START, MARK = 0, -(1 << 63)
#: Rows that a task adds up before it hands them on.
BUFFER = 1 << 20
#: Texts of a chunk that is scored with the part of the model it needs; bits of a place within a slice of marks.
CHUNK, SLICE = 512, 20
#: Tokens whose probabilities are computed at once.
STEP = 1 << 17


def _tokens(text: Column) -> Column:
    """Hashes of the lower-cased words, each followed by that of its beginning."""
    words = F.regexp_extract_all(F.lower(text), F.lit(PATTERN), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.array(F.xxhash64(w), F.xxhash64(F.substring(w, 1, BEGINNING)))))


def _mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two columns of longs."""
    h = (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (y.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Pairs:
    """The distinct (context, word) pairs of each text, where they first occur."""

    context: np.ndarray
    word: np.ndarray
    begin: np.ndarray
    text: np.ndarray
    at: np.ndarray  # the place among all tokens
    offsets: np.ndarray  # of the texts' tokens

    @classmethod
    def of(cls, values: np.ndarray, offsets: np.ndarray) -> Pairs:
        word, begin, offsets = np.ascontiguousarray(values[0::2]), values[1::2], offsets // 2
        context = np.empty_like(word)
        context[1:] = word[:-1]
        context[offsets[:-1][offsets[:-1] < len(word)]] = START
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        first = np.sort(np.unique(_mix(_mix(context, word).view(np.int64), text), return_index=True)[1])
        return cls(context[first], word[first], begin[first], text[first], first, offsets)


def add_up(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of (columns, rows) ``counts`` by (x, y), in their order: like longs next to each other take less room in a shuffle."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])) if len(x) else order
    return x[start], y[start], np.add.reduceat(counts[:, order], start, axis=1) if len(start) else counts


class _Buffer:
    """Adds rows up until there are ``BUFFER`` of them."""

    def __init__(self, columns: int):
        self.columns, self.parts, self.rows = columns, [], 0

    def add(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        self.parts.append(add_up(x, y, counts))
        self.rows += len(self.parts[-1][0])
        if self.rows >= BUFFER:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.parts:
            x, y = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            counts = np.concatenate([p[2] for p in self.parts], axis=1)
            self.parts, self.rows = [], 0
            x, y, counts = add_up(x, y, counts)
            for i in range(0, len(x), 50_000):
                yield x[i : i + 50_000], y[i : i + 50_000], counts[:, i : i + 50_000].astype(np.int64)


def _batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by class (0 ordinary, 1 toxic) that hold each pair; under ``MARK``, pairs by beginning."""
    held = _Buffer(2)
    batch = lambda r: _batch("u w o t", r[0], r[1], *r[2])
    for b in batches:
        p = Pairs.of(*lists(b.column(1)))
        toxic = b.column(0).to_numpy()[p.text].astype(np.int32)
        counts = np.stack([1 - toxic, toxic])
        mark = np.full(len(toxic), MARK)
        yield from map(batch, held.add(np.concatenate([p.context, p.begin]), np.concatenate([p.word, mark]), np.concatenate([counts, counts], axis=1)))
    yield from map(batch, held.flush())


LEVELS = "kind int, x long, y long, a long, b long, c long, d long"


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From counted pairs: those above the discount, and sums by word (contexts by class, both, and those of kept pairs), context (pairs, and what exceeds the discount) and beginning."""
    words, contexts = _Buffer(4), _Buffer(4)

    def out(kind: int, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for x, y, counts in rows:
            yield _batch("kind x y a b c d", np.full(len(x), kind, np.int32), x, y, *counts)

    for b in batches:
        u, w, *n = (b.column(i).to_numpy() for i in range(4))
        n, begins = np.stack(n), w == MARK
        more = np.maximum(n - DISCOUNT_PAIR, 0)
        zero = np.zeros_like(n)
        yield from out(BEGIN, [(u[begins], zero[0][begins], np.concatenate([n, zero])[:, begins])])
        kept = ~begins & (more > 0).any(axis=0)
        yield from out(PAIR, [(u[kept], w[kept], np.concatenate([n, zero])[:, kept])])
        u, w, n, more, kept = u[~begins], w[~begins], n[:, ~begins], more[:, ~begins], kept[~begins]
        none = np.zeros(len(u), np.int64)
        yield from out(WORD, words.add(w, none, np.stack([n[0] > 0, n[1] > 0, none == 0, kept]).astype(np.int64)))
        yield from out(CONTEXT, contexts.add(u, none, np.concatenate([n, more])))
    yield from out(WORD, words.flush())
    yield from out(CONTEXT, contexts.flush())


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that a difference of models depends on, and sums over all words and beginnings."""
    sums, more = np.zeros(4, np.int64), np.zeros(4, np.int64)
    for b in batches:
        kind, a = b.column(0).to_numpy(), np.stack([b.column(i).to_numpy() for i in range(3, 7)])
        word, begin = kind == WORD, kind == BEGIN
        sums += np.concatenate([a[:2, word].sum(axis=1), np.minimum(a[:2, word], DISCOUNT_WORD).sum(axis=1)])
        more += np.concatenate([[word.sum(), a[2, word].sum()], a[:2, begin].sum(axis=1)])
        least = np.select([word, begin], [DISCOUNT_WORD, DISCOUNT_BEGINNING], 0)
        over = np.where(kind == CONTEXT, a[2:].max(axis=0, initial=0), a[:2].max(axis=0, initial=0)) > least
        over |= word & (a[3] > 0)  # a kept pair needs its word's shared count
        kept = b.filter(pa.array(over))
        x, y = kept.column(1).to_numpy(), kept.column(2).to_numpy()
        key = np.where(kept.column(0).to_numpy() == PAIR, _mix(x, y).view(np.int64), x)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(key)], names=[*"kind x y a b c d key".split()])
    for kind, x in ((SUMS, sums), (MORE, more)):
        yield _batch("kind x y a b c d key", np.array([kind], np.int32), *np.zeros((2, 1), np.int64), *x[:, None], np.zeros(1, np.int64))


@dataclass
class Sums:
    """Over all words: distinct pairs of each class, what discounts free of them, words, distinct pairs of both, and pairs of texts."""

    pairs: np.ndarray
    freed: np.ndarray
    words: float
    either: float
    texts: np.ndarray

    @property
    def usable(self) -> bool:
        return bool((self.pairs > 0).all())

    def word_level(self, follows: np.ndarray, either: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """(2, n): each class's discounted continuation counts, and the shared ones weighed by beginnings."""
        shared = (either + 0.5) / (self.either + 0.5 * self.words)
        share = (self.texts / self.texts.sum())[:, None]
        b = np.maximum(begin - DISCOUNT_BEGINNING, 0)
        weight = (b + share * BACKOFF_BEGINNING) / (share * (b.sum(axis=0) + BACKOFF_BEGINNING))
        return (np.maximum(follows - DISCOUNT_WORD, 0) + self.freed[:, None] * shared * weight) / self.pairs[:, None]

    def pair_level(self, pair: np.ndarray, total: np.ndarray, over: np.ndarray, word: np.ndarray) -> np.ndarray:
        """(2, n): discounted pairs after a context, and the word level for the rest; that alone where nothing follows the context."""
        known = (np.maximum(pair - DISCOUNT_PAIR, 0) + (total - over) * word) / np.maximum(total, 1)
        return np.where(total > 0, known, word)


def log_ratio(p: np.ndarray) -> np.ndarray:
    """Of toxic over ordinary probabilities."""
    return np.clip(np.log(np.maximum(p[1], 1e-300)) - np.log(np.maximum(p[0], 1e-300)), -CLIP, CLIP)


#: Columns of the rows of each kind: by class, and over both.
WIDTH = {PAIR: 2, WORD: 3, CONTEXT: 4, BEGIN: 2}


class Tables:
    """A model's rows as sorted keys and columns, with a row of zeros for what is not there."""

    def __init__(self, kept: DataFrame | None = None, near: Tables | None = None):
        self.keys, self.columns, self.near = {}, {}, near
        for k in WIDTH if kept is not None else ():  # one kind after the other, in as few bytes as its counts need
            rows, counts = kept.where(F.col("kind") == k), list("abcd"[: WIDTH[k]])
            most = rows.agg(F.max(F.greatest(*counts))).first()[0] or 0
            self._put(k, rows.select("key", *[F.col(c).cast("int" if most < 1 << 31 else "long") for c in counts]).toArrow())

    @classmethod
    def of(cls, rows: pa.Table, near: Tables) -> Tables:
        """The tables of some rows of a model, (kind, key, a, b, c, d), beside those that are ``near``."""
        made, kind = cls(near=near), rows.column("kind").to_numpy()
        for k, width in WIDTH.items():
            made._put(k, rows.select(["key", *"abcd"[:width]]).filter(pa.array(kind == k)))
        return made

    def _put(self, kind: int, rows: pa.Table) -> None:
        key = rows.column(0).to_numpy().view(np.uint64)
        order = np.argsort(key)
        self.keys[kind] = np.append(key[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.columns[kind] = np.stack([np.append(c.to_numpy()[order], c.type.to_pandas_dtype()(0)) for c in rows.columns[1:]])

    def find(self, kind: int, key: np.ndarray) -> np.ndarray:
        """(columns, n) counts of each key."""
        at = np.searchsorted(self.keys[kind], key)
        at[self.keys[kind][at] != key] = len(self.keys[kind]) - 1
        found = self.columns[kind][:, at]
        return found if self.near is None else found + self.near.find(kind, key)  # no row is in both

    def has(self, kind: int, key: np.ndarray) -> np.ndarray:
        """Which keys (longs) have a row."""
        key = key.view(np.uint64)
        at = np.searchsorted(self.keys[kind][:-1], key)
        return (self.keys[kind][at] == key) & (at < len(self.keys[kind]) - 1)


@dataclass
class Model:
    """Sums over all words, the rows as arrays (or, where too many, the most frequent ``near`` as arrays and the other ``rows`` as a table), and the logistic weights."""

    sums: Sums
    tables: Tables | None
    frame: DataFrame | None = None
    rows: int = 0
    near: Tables | None = None
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -30.0]))


def ratios(sums: Sums, tables: Tables, p: Pairs) -> np.ndarray:
    """The log-ratio of each pair."""
    word, first, at = np.unique(p.word, return_index=True, return_inverse=True)
    counts, begins = tables.find(WORD, word.view(np.uint64)), tables.find(BEGIN, p.begin[first].view(np.uint64))
    level = sums.word_level(counts[:2].astype(float), counts[2].astype(float), begins.astype(float))
    context, to = np.unique(p.context, return_inverse=True)
    after = tables.find(CONTEXT, context.view(np.uint64))
    known = (after[2:] > 0).any(axis=0)  # contexts with a pair above the discount; after others the word level decides
    out = np.empty(len(at))
    for i in range(0, len(at), STEP):
        s = slice(i, i + STEP)
        r = log_ratio(level[:, at[s]])
        some = np.flatnonzero(known[to[s]])
        total = after[:, to[s][some]].astype(float)
        pair = tables.find(PAIR, _mix(p.context[s][some], p.word[s][some])).astype(float)
        r[some] = log_ratio(sums.pair_level(pair, total[:2], total[2:], level[:, at[s][some]]))
        out[s] = r
    return out


def own_ratios(sums: Sums, c: int, ids: dict[str, np.ndarray], n: dict[str, np.ndarray]) -> np.ndarray:
    """The log-ratios of the distinct pairs of one text of class ``c``, without what that text itself adds to the counts.

    ``ids`` name each pair's context, word and beginning; ``n`` has its counts.  Of a pair that
    is in no table it is not known whether others have it too; it is taken for the text's alone.
    """
    n = {k: v.astype(float) for k, v in n.items()}
    over = n["pair"][c] > DISCOUNT_PAIR
    for name, columns, mine in (("context", [("total", c)], None), ("context", [("over", c)], over), ("word", [("follows", c), ("either", 0)], ~over), ("begin", [("begin", c)], None)):
        at = np.unique(ids[name], return_inverse=True)[1]
        less = np.bincount(at, weights=mine)[at]
        for column, row in columns:
            n[column][row] = np.maximum(n[column][row] - less, 0)
    n["pair"][c] = np.maximum(n["pair"][c] - 1, 0)
    # a context that keeps no pair above the discount frees all
    return log_ratio(sums.pair_level(n["pair"], n["total"], n["over"], sums.word_level(n["follows"], n["either"][0], n["begin"])))


def summed(ratio: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 3): the mean log-ratio, the highest mean over a window, and the mean of what exceeds ``DECISIVE``.

    ``at`` has the pairs' places among all tokens, ``offsets`` those of the texts; means are shrunk towards 0.
    """
    size = int(offsets[-1])
    r, one = np.zeros(size), np.zeros(size)
    r[at], one[at] = ratio, 1
    total, strong, count = (np.concatenate([[0.0], np.cumsum(x)]) for x in (r, np.maximum(r - DECISIVE, 0), one))
    n = count[offsets[1:]] - count[offsets[:-1]] + PRIOR_WORDS
    mean, decided = ((t[offsets[1:]] - t[offsets[:-1]]) / n for t in (total, strong))
    best = mean.copy()
    for i in np.flatnonzero(np.diff(offsets) > WINDOW):
        t = total[offsets[i] : offsets[i + 1] + 1]
        best[i] = max(best[i], (t[WINDOW:] - t[:-WINDOW]).max() / (WINDOW + PRIOR_WORDS))
    return np.column_stack([mean, best, decided])


EVIDENCE = {f"e{i}": ("double", pa.float64()) for i in range(3)}


def _evidence(sums: Sums, tables: Tables, values: np.ndarray, offsets: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """(texts, 3) evidence; where ``own`` names a text's class, without its own counts."""
    if not sums.usable or not len(values):
        return np.zeros((len(offsets) - 1, 3))
    p = Pairs.of(values, offsets)
    if own is None:
        return summed(ratios(sums, tables, p), p.at, p.offsets)
    cut, out = np.searchsorted(p.text, np.arange(len(own) + 1)), []
    for c, i, j in zip(own, cut, cut[1:], strict=False):
        ids = {"context": p.context[i:j], "word": p.word[i:j], "begin": p.begin[i:j]}
        found = {k: tables.find(kind, key) for k, kind, key in ((PAIR, PAIR, _mix(ids["context"], ids["word"])), *((k, k, ids[x].view(np.uint64)) for k, x in ((WORD, "word"), (CONTEXT, "context"), (BEGIN, "begin"))))}
        n = {"pair": found[PAIR], "total": found[CONTEXT][:2], "over": found[CONTEXT][2:], "follows": found[WORD][:2], "either": found[WORD][2:], "begin": found[BEGIN]}
        out.append(own_ratios(sums, int(c), ids, n))
    return summed(np.concatenate(out), p.at, p.offsets)


def _marks(keys: DataFrame, rows: int) -> np.ndarray:
    """A bit for each place that one of ``rows`` keys has; what has none is in no row.  At most 32 MB; beyond 32 million rows more keys share a place."""
    bits = max(SLICE, min(28, (8 * rows).bit_length()))
    place = F.shiftrightunsigned("key", 64 - bits)

    def run(group: pa.Table) -> pa.Table:
        on = np.zeros(1 << SLICE, np.uint8)
        on[group.column("p").to_numpy()] = 1
        return pa.table({"s": group.column("s")[:1], "m": pa.array([np.packbits(on, bitorder="little").tobytes()])})

    placed = keys.select(F.shiftrightunsigned(place, SLICE).alias("s"), place.bitwiseAND(F.lit((1 << SLICE) - 1)).alias("p"))
    marks = np.zeros((1 << (bits - SLICE), 1 << (SLICE - 3)), np.uint8)
    for r in placed.groupBy("s").applyInArrow(run, "s long, m binary").toLocalIterator():
        marks[r.s] = np.frombuffer(r.m, np.uint8)
    return marks.ravel()


def _marked(marks: np.ndarray, key: np.ndarray) -> np.ndarray:
    place = key.view(np.uint64) >> np.uint64(64 - int(len(marks) * 8 - 1).bit_length())
    return (marks[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _by_chunk(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row a chunk, with lists of what the batches have of it."""
    rows = pa.Table.from_batches(batches).sort_by("chunk")
    chunk = rows.column("chunk").to_numpy()
    at = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])) if len(chunk) else np.empty(0, np.int64)
    offsets = pa.array(np.append(at, len(chunk)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(chunk[at]), *[pa.ListArray.from_arrays(offsets, pa.array(c.to_numpy())) for c in rows.columns[1:]]], names=rows.column_names)


def _joined(df: DataFrame, model: Model, text: str, own: str | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with the evidence, where the model's rows are too many to broadcast.

    Texts are dealt to chunks.  Each chunk asks for the rows that its pairs may have, as keys alone, and is scored
    with the part of the model that it got back.  The texts are shuffled once, as they are: their tokens never are.
    """
    sc, sums, chunk, tokens = df.sparkSession.sparkContext, model.sums, fresh(df, "chunk"), fresh(df, "tokens")
    near, marks = sc.broadcast(model.near), sc.broadcast(_marks(model.frame.select("key"), model.rows))
    chunks = df.count() // CHUNK + 1
    named = df.withColumn(chunk, F.pmod(F.xxhash64(*[F.col(quoted(c)) for c in df.columns]), F.lit(chunks)))
    hashed = _tokens(text_of(named, text))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Buffer(0)
        for b in batches:
            p = Pairs.of(*lists(b.column(1)))
            place = b.column(0).to_numpy()[p.text] * len(WIDTH)
            context, to = np.unique(p.context, return_inverse=True)
            follows = (near.value.has(CONTEXT, context) | _marked(marks.value, context))[to]  # after other contexts there is no pair
            for kind, key in ((PAIR, _mix(p.context, p.word).view(np.int64)), (WORD, p.word), (CONTEXT, p.context), (BEGIN, p.begin)):
                on = np.flatnonzero(_marked(marks.value, key) & (follows if kind == PAIR else True))
                on = on[~near.value.has(kind, key[on])]
                for x, y, _ in held.add(key[on], place[on] + kind, np.zeros((0, len(on)), np.int64)):
                    yield _batch("key place", x, y)
        for x, y, _ in held.flush():
            yield _batch("key place", x, y)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BUFFER:
                yield _by_chunk(held)
                held = []
        if held:
            yield _by_chunk(held)

    asked = in_arrow(named.select(chunk, hashed.alias("h")), ask, "key long, place long")
    met = asked.join(model.frame.select(F.col("key").alias("k"), "kind", *"abcd"), (F.col("key") == F.col("k")) & (F.pmod("place", F.lit(len(WIDTH))) == F.col("kind")))
    found = in_arrow(met.select(F.floor(F.col("place") / len(WIDTH)).alias("chunk"), F.col("kind").cast("byte").alias("kind"), "key", *"abcd"), pack, "chunk long, kind array<byte>, key array<long>, a array<long>, b array<long>, c array<long>, d array<long>")

    def run(texts: pa.Table, rows: pa.Table) -> pa.Table:
        parts, made = Tables.of(pa.table({c: rows.column(c).combine_chunks().flatten() for c in rows.column_names[1:]}), near.value), []
        for b in texts.combine_chunks().to_batches(max_chunksize=256):
            e = _evidence(sums, parts, *lists(b.column(tokens)), None if own is None else b.column(own).to_numpy())
            made.append(pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *map(pa.array, e.T)], names=[*keep, *EVIDENCE]))
        return pa.Table.from_batches(made)

    dealt = named.repartition(F.col(chunk)).withColumn(tokens, hashed)
    schema = df.select(*map(quoted, keep)).withColumns({c: F.lit(0.0) for c in EVIDENCE}).schema
    return dealt.groupBy(chunk).cogroup(found.groupBy("chunk")).applyInArrow(run, schema)


def evidence(df: DataFrame, model: Model, text: str, own: str | None = None, keep_text: bool = False) -> DataFrame:
    """``df`` with the evidence ``e0`` to ``e2`` of its column ``text``, which goes unless ``keep_text``; without a text's own counts where ``own`` has its class."""
    df = without(df, *EVIDENCE)
    keep = [c for c in df.columns if keep_text or c != text]
    if model.tables is None:
        return _joined(df, model, text, own, keep)
    sent, tokens = df.sparkSession.sparkContext.broadcast((model.sums, model.tables)), fresh(df, "tokens")
    hashed = df.select(*map(quoted, keep), _tokens(text_of(df, text)).alias(tokens))
    return mapped(hashed, tokens, lambda v, o, y=None: tuple(_evidence(*sent.value, v, o, y).T), EVIDENCE, own)


def _stored(rows: DataFrame) -> DataFrame:
    """What a difference of models depends on of the labelled rows (label, h), in the shared folder."""
    counted = in_arrow(rows, _counted, "u long, w long, o long, t long")
    pairs = counted.repartition("u", "w").groupBy("u", "w").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    levels = in_arrow(pairs, _levels, LEVELS).repartition("kind", "x", "y").groupBy("kind", "x", "y").agg(*[F.sum(c).alias(c) for c in "abcd"])
    return handed_over(in_arrow(levels, _kept, LEVELS + ", key long"))


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_column: str = "doc_id", text: str = "text", label: str = "toxic", calibration_rows: int = CALIBRATION_ROWS, model_rows: int = MODEL_ROWS, seed: int = 7) -> Model:
    """Fits the models on the rows of ``docs`` whose id has a label that ``train`` (over ``id``) admits.

    ``labels`` has the columns ``id_column`` and ``label``.  All of those rows are counted,
    repeated ones too.  The logistic curve is fitted on at most ``calibration_rows`` ids.
    Without rows of both classes every score is the share of label 1, or 0 without any label.
    Null texts count as empty; of very long texts every word counts.
    """
    prepare(docs.sparkSession)
    known = label_table(labels, label, train, id_column)
    rows = docs.select(docs[id_column].alias("id"), text_of(docs, text).alias("text"))
    kept = _stored(with_labels(rows, known).select("label", _tokens(F.col("text")).alias("h")))
    freed(docs.sparkSession)  # the shuffles of the counts
    whole = F.col("kind").isin(SUMS, MORE)
    total = {r.kind: [float(r[c]) for c in "abcd"] for r in kept.where(whole).groupBy("kind").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
    first, more = (np.array(total.get(k, [0.0] * 4)) for k in (SUMS, MORE))
    sums, kept = Sums(first[:2], first[2:], more[0], more[1], more[2:]), kept.where(~whole)
    often = F.floor(8 * F.log2(F.greatest(F.col("a") + F.col("b"), F.col("c")) + 1))
    size = {r.often: r.n for r in kept.groupBy(often.alias("often")).agg(F.count("*").alias("n")).collect()}
    if sum(size.values()) <= model_rows:
        model = Model(sums, Tables(kept))
    else:
        order = sorted(size, reverse=True)
        held = np.cumsum([size[x] for x in order])
        least = F.lit([order[0] + 1, *order][int((held <= model_rows).sum())])
        model = Model(sums, None, kept.where(often < least), sum(size.values()), Tables(kept.where(often >= least)))
    sample = rows.join(bounded_sample(known, calibration_rows), "id").select("label", "text")
    got = evidence(sample, model, "text", own="label").select("label", *EVIDENCE).orderBy(F.xxhash64("label", *EVIDENCE)).limit(calibration_rows).toArrow()
    freed(docs.sparkSession)
    y = got.column("label").to_numpy().astype(float)
    x = np.column_stack([got.column(c).to_numpy() for c in EVIDENCE])
    if len(y) and 0 < y.sum() < len(y) and sums.usable:
        model.weights = logistic(x, y)
    elif len(y):
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        model.weights = np.array([0.0, 0.0, 0.0, np.log(share / (1 - share))])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability ``out`` (double, 0 to 1) that a text is toxic.

    The text column goes unless ``keep_text``; an own column called ``out`` is replaced.  Null
    and empty texts get the score of no evidence.  Texts are scored whole; rows stay one to one, and
    repeated ones score alike.  The caller sets the threshold; a score equal to it counts as reaching it in
    the registered query and in the pipeline.  An empty table gives no rows.
    """
    prepare(docs.sparkSession)
    given, back = aliased(docs, out)
    names = [c for c in docs.columns if c.lower() != out.lower()]
    own = next((i for i, c in enumerate(names) if c.lower() == text.lower()), None)
    if own is None:  # the text goes under the score's name
        df, read = docs.select(*given, docs[quoted(text)].alias("t")), "t"
    else:
        df, read = docs.select(*given), f"c{own}"
    w = model.weights
    z = sum((F.col(c) * float(w[i]) for i, c in enumerate(EVIDENCE)), F.lit(float(w[3])))
    p = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return evidence(df, model, read, keep_text=keep_text).select(*[c for i, c in enumerate(back) if keep_text or i != own], p.alias(out))
