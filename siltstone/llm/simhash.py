"""SimHash near-duplicates, compared bit-sliced.

Fingerprints are 64 majority bits over XXH64 (seed 42) hashes of word shingles.  Copies
collapse to one row per fingerprint before anything is compared.  Two fingerprints within
the radius agree in at least ``bands - radius`` of the bands that the 64 bits are cut into,
so each choice of that many bands gives a block key and every linked pair shares a block.

Within a block the fingerprints lie *vertically*: plane ``p`` holds bit ``p`` of 64
fingerprints per machine word.  One XOR per plane gives one bit of 64 distances at once, a
carry-save adder counts them, and a fingerprint's comparison with a block is abandoned as soon as every
other lane has passed the radius.  A block reports links that span its connected parts, not its pairs.

A block above ``cap`` fingerprints is cut again: its free bits split into ``radius + 1``
parts of which a linked pair shares one.  That repeats until each block fits, so no
candidate is lost and no task gathers more than ``cap`` fingerprints of one block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aliased, cut, fresh, in_arrow, prepare, quoted, row_hash, small_side, text_of
from .components import connected_components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text; 0 if it has no words (null included)."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(b" ".join(w), seed)]
    else:
        hashes = [digest(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray, step: int = 1 << 15) -> int:
    """The 64-bit value whose bits are set in over half of ``hashes``; in steps, for long texts."""
    set_in = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """``docs`` with the column ``out`` (long, the signed form) in place of ``text``.

    Null texts count as empty and get 0.  An own column called ``out`` is replaced.
    """
    prepare(docs.sparkSession)
    given, back = aliased(docs, text, out)
    df = docs.select(*given, text_of(docs, text).alias("text"))
    schema, names = df.drop("text").withColumn("made", F.lit(0).cast("long")).schema, [*df.columns[:-1], "made"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(b.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps.view(np.int64))], names=names)

    return in_arrow(df, run, schema).select(*back, F.col("made").alias(out))


def _count(planes: np.ndarray, own: np.ndarray, radius: int, live: np.ndarray) -> np.ndarray:
    """Words whose bits mark the lanes of ``live`` within the radius, by carry-save counting.

    ``planes[p]`` and ``own[p]`` broadcast to the shape of ``live``; their XOR is bit p of each
    distance.  Rows of which every live lane is beyond the radius are abandoned.
    """
    width, near, rows = max(1, radius.bit_length()), np.zeros(live.shape, np.uint64), np.arange(len(live))
    total = [np.zeros(live.shape, np.uint64) for _ in range(width)]
    over = np.zeros(live.shape, np.uint64)
    for p in range(64):
        carry = planes[p] ^ own[p]
        for k in range(width):
            total[k], carry = total[k] ^ carry, total[k] & carry
        over |= carry
        if p % 8 == 7:
            # a lane is over when its counter overflowed or reads more than the radius
            above, same = over.copy(), np.full(over.shape, FULL)
            for k in reversed(range(width)):
                if radius >> k & 1:
                    same &= total[k]
                else:
                    above |= same & total[k]
                    same &= ~total[k]
            on = (~above & live).any(axis=1)
            if not on.any():
                return near
            if 2 * on.sum() <= len(on):
                rows, live, over, above, own, total = rows[on], live[on], over[on], above[on], own[:, on], [t[on] for t in total]
                planes = planes[:, on] if planes.shape[1] > 1 else planes
    near[rows] = ~above & live
    return near


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, rows, lanes / 64) bit planes of (rows, lanes) fingerprints; lanes a multiple of 64."""
    rows, lanes = fps.shape
    shift = np.arange(64, dtype=np.uint64)
    parts = fps.reshape(rows, lanes // 64, 64)
    return np.stack([np.bitwise_or.reduce(((parts >> np.uint64(p)) & np.uint64(1)) << shift, axis=2) for p in range(64)])


def _links(near: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
    """Spanning links of one block: breadth-first over rows of neighbour bits."""
    n, out = len(fps), []
    left = np.ones(n, dtype=bool)
    for seed in range(n):
        if not left[seed]:
            continue
        left[seed] = False
        edge = np.array([seed])
        while len(edge):
            met = np.bitwise_or.reduce(near[edge], axis=0)
            lanes = np.unpackbits(met.astype("<u8").view(np.uint8), bitorder="little")[:n].astype(bool) & left
            edge = np.flatnonzero(lanes)
            left[edge] = False
            out += [(int(fps[i]), int(fps[seed])) for i in edge]
    return out


def compare_block(fps: np.ndarray, radius: int = 2, step: int = 512) -> list[tuple[int, int]]:
    """Links (signed pairs) that connect what one block's distinct fingerprints link."""
    fps = np.asarray(fps, dtype=np.int64)
    n = len(fps)
    lanes = -(-n // 64) * 64
    padded = np.zeros((1, lanes), np.uint64)
    padded[0, :n] = fps.view(np.uint64)
    planes = _planes(padded)  # (64, 1, words)
    valid = np.packbits(np.arange(lanes) < n, bitorder="little").view("<u8").astype(np.uint64)
    near = np.zeros((n, lanes // 64), np.uint64)
    for i in range(0, n, step):
        q = fps[i : i + step].view(np.uint64)
        own = np.stack([((q >> np.uint64(p)) & np.uint64(1)) * FULL for p in range(64)])[:, :, None]
        live = np.repeat(valid[None], len(q), axis=0)
        at = np.arange(i, i + len(q))
        live[at - i, at // 64] &= ~(np.uint64(1) << (at % 64).astype(np.uint64))  # no fingerprint meets itself
        near[i : i + step] = _count(planes, own, radius, live)
    return _links(near, fps)


def compare_small(blocks: list[np.ndarray], radius: int = 2) -> list[tuple[int, int]]:
    """As ``compare_block`` for many blocks of at most 64 fingerprints, one word each, together."""
    sizes = np.array([len(b) for b in blocks])
    fps = np.zeros((len(blocks), 64), np.int64)
    for i, b in enumerate(blocks):
        fps[i, : len(b)] = b
    most = int(sizes.max())
    u = fps.view(np.uint64)
    planes = _planes(u)  # (64, blocks, 1)
    own = np.stack([((u[:, :most] >> np.uint64(p)) & np.uint64(1)) * FULL for p in range(64)])  # (64, blocks, queries)
    valid = np.array([(1 << int(n)) - 1 for n in sizes], dtype=np.uint64)
    alone = np.uint64(1) << np.arange(most, dtype=np.uint64)
    # no fingerprint meets itself, and the places after a block's last one meet none
    live = np.where(np.arange(most) < sizes[:, None], valid[:, None] & ~alone, np.uint64(0))
    near = _count(planes, own, radius, live)
    out: list[tuple[int, int]] = []
    for i in np.flatnonzero(near.any(axis=1)):
        out += _links(near[i, : sizes[i], None], fps[i, : sizes[i]])
    return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col, links, small = batch.column(0), [], []
            values, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
            for a, b in zip(off, off[1:], strict=False):
                if b - a > 64:
                    links += compare_block(values[a:b], radius)
                elif b - a > 1:
                    small.append(values[a:b])
            for i in range(0, len(small), 4096):
                links += compare_small(small[i : i + 4096], radius)
            got = np.array(sorted(set(links)), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return run


def _again(radius: int):
    """Keys of the next cut: the free bits of ``mask`` in radius + 1 parts, each with its own key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            key, fp, mask = (np.asarray(batch.column(i)) for i in range(3))
            keys, fps, masks = [], [], []
            for k, f, m in zip(key.tolist(), fp.tolist(), mask.tolist(), strict=True):
                free = [p for p in range(64) if m >> p & 1]
                for j in range(radius + 1):
                    part = sum(1 << p for p in free[j :: radius + 1])
                    h = xxhash.xxh64_intdigest(f"{k}|{j}|{f & part & (2**64 - 1)}".encode())
                    keys.append(h - 2**64 if h >= 2**63 else h)
                    fps.append(f)
                    rest = (m & ~part) & (2**64 - 1)
                    masks.append(rest - 2**64 if rest >= 2**63 else rest)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, fps, masks)], names=["key", "fp", "mask"])

    return run


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(fps: DataFrame, radius: int = 2, bands: int = 4, cap: int = 4096) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct fingerprints (one long column) within the radius.

    Transitively they join exactly what the pairs within the radius join.
    """
    if not 0 < radius < bands <= 32:
        raise ValueError("needs 0 < radius < bands <= 32")
    fps = fps.toDF("fp")
    width = [64 * (i + 1) // bands - 64 * i // bands for i in range(bands)]
    masks = [((1 << w) - 1) << sum(width[:i]) for i, w in enumerate(width)]
    kinds = [sum(x) for x in combinations(masks, bands - radius)]
    keyed = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))).alias("key"), F.lit(_signed(~m & (2**64 - 1))).alias("mask")) for i, m in enumerate(kinds)])).alias("x"),
    ).select("x.key", "fp", "x.mask")
    found = None
    while True:
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = keyed.join(counts, "key")
        blocks = met.where(F.col("n") <= cap).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
        made = in_arrow(blocks, _compare(radius), "a long, b long")
        found = made if found is None else found.unionByName(made)
        hot = cut(met.where(F.col("n") > cap).select("key", "fp", "mask"))
        if hot.isEmpty():
            return found
        keyed = cut(in_arrow(hot, _again(radius), "key long, fp long, mask long").distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 3, radius: int = 2, bands: int = 4, cap: int = 4096, seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, columns ``also``, ``fp`` (long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` bits, the
    row's own included; null ids never win unless all of a component are null.  Null and
    empty texts have the fingerprint 0 and link like others.  Repeated rows stay repeated.
    An empty table gives an empty result.
    """
    light = docs.select(docs[id_column], *[docs[c] for c in also], text_of(docs, text).alias("text"))
    light = cut(fingerprints(light, "text", words, seed))
    least = cut(light.groupBy("fp").agg(F.min(id_column).alias("least")))
    comp = connected_components(links(least.select("fp"), radius, bands, cap))
    member = least.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    roots = member.groupBy("component").agg(F.min("least").alias("component_id"))
    mapped = member.join(roots, "component").select("fp", "component_id")
    return light.join(mapped, "fp").select(id_column, *also, "fp", "component_id")


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", find=near_duplicates, **options) -> DataFrame:
    """``docs`` with one row of each component of near-duplicates: that of the smallest id, nulls last.

    ``find`` marks the components as ``near_duplicates`` does.  Of several rows with that id, the one with the smallest hash stays, and of rows equal in
    every column one.  Columns stay as they are.
    """
    # the id and a hash of the whole row name a row; texts stay where they are, unless the kept rows are too many to broadcast
    row = fresh(docs, "row")
    named = docs.withColumn(row, row_hash(docs))
    marked = find(named, id_column, text, also=(row,), **options).withColumnRenamed(id_column, "keep_id").withColumnRenamed(row, "keep_row")
    alike = marked.groupBy("keep_id", "keep_row").agg(F.first("fp").alias("fp"), F.first("component_id").alias("component_id"), F.count("*").alias("times"))
    first = F.min(F.struct(F.col("keep_id").isNull().alias("none"), F.col("keep_id"), F.col("keep_row"), F.col("times"))).alias("x")
    # one component has one fingerprint group of equal component ids; null ids make one group a fingerprint
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = cut(alike.groupBy(group.alias("g")).agg(first).select("x.keep_id", "x.keep_row", "x.times").distinct())

    def rows(of: DataFrame) -> DataFrame:
        met = named.join(small_side(of.drop("times")), named[quoted(id_column)].eqNullSafe(F.col("keep_id")) & (named[row] == F.col("keep_row")))
        return met.select(*[F.col(quoted(c)) for c in [*docs.columns, row]])

    one, more = rows(kept.where("times = 1")), kept.where("times > 1")
    if not more.isEmpty():
        # of rows that equal each other one stays, found with map-side combining
        one = one.unionByName(rows(more).dropDuplicates([id_column, row]))
    return one.drop(row)
