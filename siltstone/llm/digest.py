"""Document fingerprints from improbable byte windows, kept in chains of Bloom filters.

Every window of ``WINDOW`` bytes has an entropy; how rare its (rounded) entropy is among all
windows of the corpus is counted once, over all texts.  In a text, the rarest window of every run of
neighbours gets a point, and windows with enough points are the text's features.  So a feature
depends on its neighbourhood only, and texts that share a passage share its features.  Features
go into Bloom filters in the order of the text; a filter that is full starts the next one.

Two fingerprints are compared filter by filter: common bits beyond what chance and the numbers of
set bits explain, as a share of the most that were possible; each filter of the shorter
chain counts with its best partner.

The work runs in Arrow batches, in integers throughout: all texts of a batch lie in one buffer, and
entropies come from running sums over it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aliased, bytes_of, handed_over, in_arrow, prepare, text_of

#: Bytes of a window; neighbours that share a point, and points that make a feature, in texts of so many bytes or more.
WINDOW, RUNS = 16, ((256, 32, 8), (0, 8, 2))
#: Bits of a filter, bits that a feature sets, features that a filter holds.
BITS, HASHES, FEATURES = 2048, 5, 160
#: Steps of the entropy scale.
STEPS = 1000
#: Deviations of chance that common bits must exceed.
DEVIATIONS = 4.0
#: Bytes handled at once.
BLOCK = 1 << 16

_UNIT = 1 << 20
#: What the c-th further occurrence of a byte in a window adds to the sum of c * log2(c), in units.
_GAIN = np.diff(np.array([0.0] + [c * np.log2(c) for c in range(1, 257)])).__mul__(_UNIT).round().astype(np.int64)


def entropies(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The entropy of each window of ``data``, from 0 to ``STEPS``: window i begins at byte i.

    Each byte's equals within a window before and after it are counted; a window loses what its
    first byte adds to it and gains what the next byte adds, so all sums are differences of two
    running sums.
    """
    n = len(data)
    if n < window:
        return np.zeros(0, np.int16)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for at in range(0, n, BLOCK):
        part = data[at : at + BLOCK + window]
        same = np.empty(len(part), np.uint8)
        for lag in range(1, window):
            m = len(part) - lag
            if m <= 0:
                break
            new = min(m, BLOCK)  # pairs whose first byte lies in this block
            eq = np.equal(part[lag : lag + new], part[:new], out=same[:new].view(bool)).view(np.uint8)
            before[at + lag : at + lag + new] += eq
            after[at : at + new] += eq
    lost, gained = np.cumsum(_GAIN[after]), np.cumsum(_GAIN[before])
    # the first window: only equals inside it count, which is what ``before`` has there
    total = gained[window - 1 :].copy()
    total[1:] -= lost[: n - window]
    most = int(round(window * np.log2(window) * _UNIT))
    return np.clip((most - total) * STEPS // most, 0, STEPS).astype(np.int16)


def _inside(off: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` windows of a buffer lie within one text."""
    ok = np.ones(n, bool)
    for end in off[1:-1]:
        ok[max(0, end - window + 1) : max(0, end)] = False
    return ok


def count_entropies(docs: DataFrame, text: str = "text", window: int = WINDOW) -> np.ndarray:
    """How many windows of all texts have each entropy: ``STEPS + 1`` counts."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(STEPS + 1, np.int64)
        for b in batches:
            data, off = bytes_of(b.column(0))
            e = entropies(data, window)
            total += np.bincount(e[_inside(off, window, len(e))], minlength=STEPS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["entropy", "n"])

    found = in_arrow(docs.select(text_of(docs, text).alias("text")), run, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(STEPS + 1, np.int64)
    counts[found.column("entropy").to_numpy()] = found.column("n").to_numpy()
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """The rank of each entropy, rarest first; entropies that never occur and windows of one byte come last."""
    usual = np.where(counts > 0, counts, np.iinfo(np.int64).max)
    usual[0] = np.iinfo(np.int64).max
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), usual))] = np.arange(len(counts))
    return rank


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers (fixed values: the multipliers of the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(data: np.ndarray, at: np.ndarray, size: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A 64-bit number for each feature, by its bytes alone."""
    step = np.arange(-(-window // 8) * 8)
    taken = np.where(step < size[:, None], np.append(data, np.uint8(0))[np.minimum(at[:, None] + step, len(data))], np.uint8(0))
    h = _mixed(size.astype(np.uint64))
    for word in np.ascontiguousarray(taken).view("<u8").T:
        h = _mixed(h ^ word)
    return h


def features(data: np.ndarray, off: np.ndarray, ranks: np.ndarray, window: int = WINDOW, runs=RUNS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, hash) of the features of each text of a buffer, in order of their first place.

    Points of equal windows of a text add up, so that a text of repeats has features too.  Short texts
    have shorter runs (``runs``), whose winners include most of those of longer ones.  A text
    with fewer windows than a run of neighbours is one run; one shorter than a window is itself a
    feature; an empty one has none.
    """
    sizes = np.diff(off)
    e = entropies(data, window)
    n = len(e)
    # rarest first, ties to the first window; windows across texts never win
    key = (ranks[e] if n else np.zeros(0, np.int64)) * (n + 1) + np.arange(n)
    key[~_inside(off, window, n)] = np.iinfo(np.int64).max
    text, at, size, points = (np.zeros(0, np.int64),) * 4
    most = np.iinfo(np.int64).max
    for least, neighbours, needed in runs:
        low, span = key, 1
        while span < neighbours:  # the smallest of each run, by doubling
            step = min(span, neighbours - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        run = window + neighbours - 1
        times = np.bincount(low[_inside(off, run, len(low))] % (n + 1) if n >= run else key[:0], minlength=1)
        new = np.flatnonzero(times)
        of = np.searchsorted(off, new, side="right") - 1
        mine = (sizes[of] >= least) & (sizes[of] < most) if len(of) else of.astype(bool)
        text, at, points = np.append(text, of[mine]), np.append(at, new[mine]), np.append(points, times[new[mine]] / needed)
        size, most = np.append(size, np.full(int(mine.sum()), window)), least
    for t in np.flatnonzero((sizes < run) & (sizes > 0)):
        a, b = off[t], off[t + 1]
        one = a if b - a < window else int(key[a : b - window + 1].argmin()) + a
        text, at, size, points = np.append(text, t), np.append(at, one), np.append(size, min(b - a, window)), np.append(points, 1)
    order = np.lexsort((at, text))
    text, at, size, points = text[order], at[order], size[order], points[order]
    h = hashes(data, at, size, window)
    _, first, same = np.unique(_mixed(h ^ _mixed(text.astype(np.uint64))), return_index=True, return_inverse=True)
    keep = np.sort(first[np.bincount(same, weights=points, minlength=len(first)) >= 1 - 1e-9])
    return text[keep], at[keep], size[keep], h[keep]


def digests(data: np.ndarray, off: np.ndarray, ranks: np.ndarray, window: int = WINDOW, **options) -> list[np.ndarray]:
    """The chain of each text: one line of ``BITS / 8`` bytes a filter."""
    text, _, _, h = features(data, off, ranks, window, **options)
    many = np.bincount(text, minlength=len(off) - 1)
    base = np.concatenate([[0], np.cumsum(-(-many // FEATURES))])
    place = (np.arange(len(text)) - (np.cumsum(many) - many)[text]) // FEATURES
    row = np.repeat(base[text] + place, HASHES)
    flat = ((h[:, None] >> np.arange(0, 11 * HASHES, 11, dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64).ravel()
    out = np.zeros((int(base[-1]), BITS // 8), np.uint8)
    np.bitwise_or.at(out, (row, flat >> 3), (1 << (flat & 7)).astype(np.uint8))
    return [out[base[i] : base[i + 1]] for i in range(len(off) - 1)]


def likeness(a: np.ndarray, b: np.ndarray, block: int = 256) -> float:
    """How much of the shorter chain the other holds, 0 to 1; two empty chains are alike, an empty one is unlike any other."""
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(b), b.tobytes()) < (len(a), a.tobytes()):
        a, b = b, a
    wide = lambda x: np.unpackbits(x, axis=1).astype(np.float32)
    na, nb = (np.bitwise_count(x).sum(axis=1).astype(np.float64) for x in (a, b))
    best = np.zeros(len(a))
    for i in range(0, len(a), block):
        mine, s = wide(a[i : i + block]), slice(i, i + block)
        for j in range(0, len(b), block):
            other, t = wide(b[j : j + block]), slice(j, j + block)
            x, y = na[s, None], nb[None, t]
            chance = x * y / BITS
            spread = np.sqrt(chance * (1 - x / BITS) * (1 - y / BITS))
            floor, most = chance + DEVIATIONS * spread, np.minimum(x, y)
            common = (mine @ other.T).astype(np.float64)
            share = np.where(common == most, 1.0, (common - chance) / np.maximum(most - chance, 1e-9))
            best[s] = np.maximum(best[s], np.where((common > floor) | (common == most), np.clip(share, 0, 1), 0).max(axis=1))
    # filters count with their set bits: the last one of a chain may hold little
    return float((best * na).sum() / na.sum())


def _chains(column: pa.Array, ranks: np.ndarray) -> list[np.ndarray]:
    return digests(*bytes_of(column), ranks)


def _ranks(docs: DataFrame, counts: np.ndarray | None, text: str):
    return docs.sparkSession.sparkContext.broadcast(rarity(count_entropies(docs, text) if counts is None else counts))


def fingerprint(docs: DataFrame, counts: np.ndarray | None = None, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out``: the fingerprint of each whole text, the bytes of its chain.

    Equal texts have equal fingerprints.  ``counts`` are those of ``count_entropies``, by default of
    ``docs``; fingerprints are comparable if made with the same ones.  Null and empty texts have the empty
    fingerprint.  A column ``out`` that is there already is replaced; rows, their repeats and all
    other columns stay.  A very long text is one row and so one buffer in a task.  An empty table gives no rows.
    """
    ranks = _ranks(docs, counts, text)
    inner, back = aliased(docs, out)
    rows = docs.select(text_of(docs, text).alias("text"), *inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [x.tobytes() for x in _chains(b.column(0), ranks.value)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(made, pa.binary())], names=[*b.schema.names[1:], "made"])

    return in_arrow(rows, run, rows.drop("text").schema.add("made", "binary")).select(*back, F.col("made").alias(out))


def chain_of(fingerprint: bytes) -> np.ndarray:
    """A fingerprint as ``likeness`` takes it: one line a filter."""
    return np.frombuffer(fingerprint, np.uint8).reshape(-1, BITS // 8)


def halves(text: str, following: str) -> str:
    """``text`` with its last half (rounded down, in code points) replaced by as much of the beginning of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = (("id", None), ("n_chars", "long"), ("edited_sha256", "binary"), ("fingerprint", "binary"), ("edited_fingerprint", "binary"), ("near_edited", "double"), ("near_next", "double"))


def _compared(ids: pa.Array, texts: list[str], following: list[str], own: list[np.ndarray], after: list[np.ndarray], ranks: np.ndarray) -> list[pa.Array]:
    """The columns of ``_FIELDS`` for texts, those that follow them, and the chains of both."""
    edited = [halves(x, y) for x, y in zip(texts, following, strict=True)]
    other = _chains(pa.array(edited, pa.string()), ranks)
    return [
        ids, pa.array([len(x) for x in texts], pa.int64()), pa.array([hashlib.sha256(x.encode()).digest() for x in edited], pa.binary()),
        pa.array([x.tobytes() for x in own], pa.binary()), pa.array([x.tobytes() for x in other], pa.binary()),
        pa.array([likeness(x, y) for x, y in zip(own, other, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
    ]


def with_edits(docs: DataFrame, counts: np.ndarray | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``:
    each text beside itself with its last half replaced (see ``halves``), and beside the next text.

    The next text is that of the following row by id, after the last the first; a single row follows
    itself.  Null ids come first; rows of one id follow each other by the 64-bit hash of their
    texts, then by text, so a repeated id may be spread over tasks.  Null and empty texts are empty: alike to
    each other, unlike any other.  Texts below some 40 bytes hold too few windows to find a half of them again.
    Other columns are ignored, whatever their names.  An empty table gives no rows.

    Texts are dealt once, by ranges of ids; each task reads its range in order and holds a batch.  Only
    the first and the last row of a range wait for their neighbours, one pair a range.
    """
    spark = docs.sparkSession
    ranks = _ranks(docs, counts, text)
    rows = docs.select(F.col(id_column).alias("id"), text_of(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    tasks = max(rows.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(tasks, "id", "h").sortWithinPartitions("id", "h", "text").select("id", "text")
    names = [n for n, _ in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        kept = None  # the last row so far: id, text, chain

        def waiting(end: str, ids: pa.Array, value: str) -> pa.RecordBatch:
            empty = [pa.nulls(1, f.type) for f in schema][1 : len(names)]
            return pa.RecordBatch.from_arrays([ids, *empty, pa.array([task], pa.int32()), pa.array([end]), pa.array([value], pa.string())], schema=schema)

        for b in batches:
            if not b.num_rows:
                continue
            schema = pa.schema([("id", b.schema.field(0).type), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("task", pa.int32()), ("end", pa.string()), ("text", pa.string())])
            chains, texts = _chains(b.column(1), ranks.value), b.column(1).to_pylist()
            if kept is None:
                yield waiting("first", b.column(0).slice(0, 1), texts[0])
                ids, mine, own = b.column(0).slice(0, len(texts) - 1), texts[:-1], chains[:-1]
                after, next_ = texts[1:], chains[1:]
            else:
                ids, mine, own = pa.concat_arrays([kept[0], b.column(0).slice(0, len(texts) - 1)]), [kept[1], *texts[:-1]], [kept[2], *chains[:-1]]
                after, next_ = texts, chains
            kept = (b.column(0).slice(len(texts) - 1, 1), texts[-1], chains[-1])
            if mine:
                made = _compared(ids, mine, after, own, next_, ranks.value)
                yield pa.RecordBatch.from_arrays([*made, *[pa.nulls(len(mine), t) for t in (pa.int32(), pa.string(), pa.string())]], schema=schema)
        if kept:
            yield waiting("last", kept[0], kept[1])

    fields = ", ".join(f"`{n}` {t or kind}" for n, t in _FIELDS)
    # filters are sparse bits, which zstd takes down by a third
    made = handed_over(in_arrow(dealt, run, f"{fields}, task int, end string, text string"), "zstd")
    ends = made.where("end is not null").select("id", "task", "end", "text")
    order = [r.task for r in ends.where("end = 'first'").select("task").orderBy("task").collect()]  # numbers of tasks only
    follows = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "task int, next int")
    pairs = ends.where("end = 'last'").select("id", "text", "task").join(follows, "task").join(ends.where("end = 'first'").select(F.col("task").alias("next"), F.col("text").alias("following")), "next").select("id", "text", "following")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, after = (_chains(b.column(i), ranks.value) for i in (1, 2))
            yield pa.RecordBatch.from_arrays(_compared(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), own, after, ranks.value), names=names)

    whole = made.where("end is null").select(*names).unionByName(in_arrow(pairs, close, fields))
    return whole.withColumnRenamed("id", "doc_id").withColumn("edited_sha256", F.lower(F.hex("edited_sha256")))
