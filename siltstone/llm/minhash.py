"""Near-duplicates by exact Jaccard similarity, found through MinHash bands.

Two texts are near-duplicates if the Jaccard similarity of their sets of word shingles is at
least ``4 / 5``.  Each of ``BANDS`` bands hashes ``ROWS`` minima; a pair at the threshold
shares no band in one of 300,000 cases, a closer one still less often.  Equal texts collapse
before anything is compared.

The candidates of a bucket are not all paired: first those outside its largest component
meet one member of it, in up to ``HEADS`` turns.  Pairs within a component need no test.
After the first turn, texts go whose shingles are for too large a part in no other text that is
left: they have no near-duplicate there, whatever their bucket.  In the end only members still
outside meet those others whose shared shingles and sizes allow the similarity, once over
all buckets.  Every candidate pair is thus tested, joined already or ruled out by
exact counts, so that the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, freed, handed_over, in_arrow, prepare, small_side, text_of
from .components import connected_components

BANDS, ROWS = 32, 5
#: Turns in which a bucket's members meet one of them before what is left is paired.
HEADS = 6
#: Heads of different buckets that a member meets in the first turn; twice as many in each further one, as fewer are left.
MEETS = 3
#: Steps of the share of own shingles by which heads are chosen.
LEVELS = 40
#: Times that texts without enough shared shingles go; their own shingles count no more the next time.
PEELS = 2
#: Shingles that are hashed at once, so that they stay in a core's cache.
STEP = 1 << 14


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; a shorter text, or none, is one shingle."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII white space
    digest = xxhash.xxh64_intdigest
    if len(w) < words:
        return np.array([digest(b" ".join(w), seed)], dtype=np.uint64)
    return np.unique(np.array([digest(s, seed) for s in map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False))], dtype=np.uint64))


def bands(sets: list[np.ndarray], seed: int = 42) -> np.ndarray:
    """(sets, BANDS) bucket keys (long) of sets that are not empty."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    b = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    least, size, i = np.empty((len(sets), len(a)), np.uint64), np.array([len(s) for s in sets]), 0
    while i < len(sets):
        j = max(i + 1, i + int(np.searchsorted(np.cumsum(size[i:]), STEP)))
        x, at = np.concatenate(sets[i:j]), np.concatenate([[0], np.cumsum(size[i : j - 1])])
        for k in range(len(a)):
            least[i:j, k] = np.minimum.reduceat(x * a[k] + b[k], at)
        i = j
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for row in np.moveaxis(least.reshape(-1, BANDS, ROWS), 2, 0):
        key = (key ^ row) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _with_bands(df: DataFrame, words: int, seed: int, fingerprints: bool = False) -> DataFrame:
    """``df`` with ``n`` (distinct shingles), ``bands`` and, with ``fingerprints``, SimHash's ``print`` in place of its last column, the text.

    One pass makes them all: each pass of its own would keep a further Python worker a core.
    """
    keep = df.columns[:-1]
    made = [F.lit(0).cast("long").alias("n"), F.array(F.lit(0).cast("long")).alias("bands"), *([F.lit(0).cast("long").alias("print")] if fingerprints else [])]
    schema = df.select(*[F.col(f"`{c}`") for c in keep], *made).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1)
            sets = [shingles(t.as_py(), words, seed) for t in texts]
            key = pa.array(bands(sets, seed).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), key)
            out = [pa.array([len(s) for s in sets], pa.int64()), lists]
            if fingerprints:
                out.append(pa.array(np.array([simhash.fingerprint(t.as_py(), seed=seed) for t in texts], dtype=np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *out], names=names)

    return in_arrow(df, run, schema)


def _sets(df: DataFrame, words: int, seed: int) -> DataFrame:
    """(copy, shingles) of (copy, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), words, seed) for t in b.column(1)]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], names=["copy", "shingles"])

    return in_arrow(df, run, "copy long, shingles array<long>")


def alike(both: Column, n: Column, m: Column) -> Column:
    """Whether sets of ``n`` and ``m`` members that share ``both`` have a similarity of 4 / 5, in whole numbers."""
    return 5 * both >= 4 * (n + m - both)


def _tested(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose shingles are alike, by exact counts."""
    met = pairs.join(sets.select(F.col("copy").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("copy").alias("a"), F.col("shingles").alias("x")), "a")
    return met.where(alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"))).select("a", "b")


def _shared(left: DataFrame, known: DataFrame) -> DataFrame:
    """``left`` without texts that can have no near-duplicate in it, ``s`` set to the shingles that another text in it has."""
    own = known.join(left.select("copy").distinct(), "copy", "left_semi").select("copy", F.explode("shingles").alias("shingle"))
    once = own.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("copy").alias("copy")).where("texts = 1")
    alone = once.groupBy("copy").agg(F.count("*").alias("alone"))
    counted = left.drop("s").join(alone, "copy", "left").withColumn("s", F.col("n") - F.coalesce("alone", F.lit(0)))
    least = left.groupBy("key").agg(F.min("n").alias("least"))
    # a partner has at least the shared part, and no less than the bucket's smallest
    return counted.join(least, "key").where(alike(F.col("s"), F.col("n"), F.greatest("s", "least"))).drop("alone", "least")


def links(reps: DataFrame, sets, given: DataFrame | None = None) -> DataFrame | None:
    """Links ``a``, ``b`` that connect all near-duplicates of (copy, n, bands), or None without candidates.

    ``sets(copies)`` gives (copy, shingles) of the copies that have a candidate.  ``given`` are candidates (a, b) found
    before: they are tested first, and what they connect is not compared again.
    """
    spark = reps.sparkSession
    keyed = reps.select("copy", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1").select("key")
    met = cut(keyed.join(shared, "key"))
    rows = met.count()
    if not rows and (given is None or given.isEmpty()):
        return None
    copies = met.select("copy")
    if given is not None:
        copies = copies.unionByName(given.select(F.explode(F.array("a", "b")).alias("copy")))
    known = sets(copies.distinct())
    found = None if given is None else cut(_tested(given, known))
    if not rows:
        return found
    # what two texts share is at most what either shares with any other
    near = lambda n, s, m, r: alike(F.least(s, r), n, m)
    before, member = None, met.withColumn("s", F.col("n"))
    if found is None:
        member = member.withColumn("component", F.col("copy"))
    else:
        comp = connected_components(found).withColumnRenamed("node", "copy")
        member = member.join(comp, "copy", "left").withColumn("component", F.coalesce("component", "copy"))
    for turn in range(HEADS + 1):
        # texts with few shingles of their own lie amid a group; coarser from turn to turn, so that heads change;
        # first one head for many buckets, then each its own
        level = F.floor((F.col("n") - F.col("s")) * LEVELS / (F.col("n") * max(1, turn)))
        head = F.min(F.struct(F.struct(level, F.xxhash64("copy", F.col("key") if turn else F.lit(0), F.lit(turn))).alias("order"), "copy", "n", "s")).alias("head")
        parts = member.groupBy("key", "component").agg(F.count("*").alias("size"), head)
        mains = parts.groupBy("key").agg(F.max(F.struct("size", "component", "head")).alias("main"), F.sum("size").alias("total"), F.count("*").alias("parts")).where("parts > 1")
        # buckets of one component are done
        left = member.join(mains.select("key", F.col("main.component").alias("inner"), F.col("main.head").alias("head"), "total"), "key")
        heads = left.where("component <> inner").select("copy", "n", "s", "head.order", F.col("head.copy").alias("head"), F.col("head.n").alias("m"), F.col("head.s").alias("r"), "total")
        outside = cut(heads, rows)
        # what pairing the members outside the main component with all others would cost
        rest = outside.agg(F.sum("total")).first()[0] or 0
        if turn == HEADS or turn and (rest <= rows or turn > 2 and 4 * rest > 3 * before):
            break
        before = rest
        some = F.slice(F.sort_array(F.collect_set(F.struct("order", "head"))), 1, MEETS << turn)
        first = outside.where(near(F.col("n"), F.col("s"), F.col("m"), F.col("r"))).groupBy("copy").agg(some.alias("some")).select("copy", F.explode("some.head").alias("a")).select("a", F.col("copy").alias("b"))
        made = cut(_tested(first, known))
        found = made if found is None else found.unionByName(made)
        comp = connected_components(found).withColumnRenamed("node", "copy")
        member = left.select("key", "copy", "n", "s").join(comp, "copy", "left").withColumn("component", F.coalesce("component", "copy"))
        for _ in range(0 if turn else PEELS):
            member = cut(_shared(member, known), rows)
        member = member if not turn else cut(member, rows)
        freed(spark)
    if not rest:
        return found
    of = left.groupBy("copy").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    left = left.join(of, "copy").withColumn("inside", F.col("component") == F.col("inner"))
    o, x = left.where("not inside").alias("o"), left.alias("x")
    apart = (F.col("o.key") == F.col("x.key")) & (F.col("o.component") != F.col("x.component")) & (F.col("x.inside") | (F.col("o.copy") < F.col("x.copy")))
    # of the buckets that two texts share, the first pairs them
    once = near(F.col("o.n"), F.col("o.s"), F.col("x.n"), F.col("x.s")) & (F.array_intersect("o.keys", "x.keys")[0] == F.col("o.key"))
    second = o.join(x, apart & once).select(F.least("o.copy", "x.copy").alias("a"), F.greatest("o.copy", "x.copy").alias("b"))
    return _tested(second, known) if found is None else found.unionByName(_tested(second, known))


def _fingerprinted(reps: DataFrame, radius: int, planes: int, cap: int) -> DataFrame:
    """Candidates (a, b) among (copy, fp) that connect all texts whose fingerprints are linked within the radius."""
    least = cut(reps.groupBy("fp").agg(F.min("copy").alias("least")))
    same = reps.join(least, "fp").where("copy <> least").select(F.col("least").alias("a"), F.col("copy").alias("b"))
    apart = simhash.links(least.select("fp"), radius, planes, cap)
    for c in "ab":
        apart = apart.join(least.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")), c)
    return cut(same.unionByName(apart.select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))).distinct())


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, seed: int = 42, also: tuple[str, ...] = (), fingerprints: bool = False, radius: int = 2, planes: int = 4, cap: int = 4096) -> DataFrame:
    """One row per row of ``docs``: id, columns ``also``, ``fp`` (long, names the component) and ``component_id``.

    ``component_id`` is the smallest id reachable over near-duplicates, the row's own
    included; null ids never win unless all of a component are null.  Texts without words,
    null included, are alike.  Repeated rows stay repeated.  With ``fingerprints``, SimHash comes first: the links
    of fingerprints within ``radius`` bits (in ``planes`` bands) are tested exactly, and MinHash bands find what these leave apart.
    """
    spark = docs.sparkSession
    prepare(spark, 500, "2m")
    whole = text_of(docs, text)
    light = docs.select(docs[id_column].alias("id"), *[docs[c] for c in also], F.xxhash64(whole).alias("copy"), whole.alias("text"))
    light = cut(_with_bands(light, words, seed, fingerprints))
    reps = light.drop("id", *also).dropDuplicates(["copy"])
    given = _fingerprinted(reps.select("copy", F.col("print").alias("fp")), radius, planes, cap) if fingerprints else None
    freed(spark)

    def sets(copies: DataFrame) -> DataFrame:
        texts = docs.select(F.xxhash64(whole).alias("copy"), whole.alias("text")).join(small_side(copies), "copy", "left_semi")
        return handed_over(_sets(texts, words, seed).dropDuplicates(["copy"]))

    found = links(reps.select("copy", "n", "bands"), sets, given)
    rows = light.select("id", *also, "copy")
    if found is None:
        rows = rows.withColumn("fp", F.col("copy"))
    else:
        comp = connected_components(found).withColumnRenamed("node", "copy")
        rows = rows.join(small_side(comp), "copy", "left").withColumn("fp", F.coalesce("component", "copy")).drop("component")
    freed(spark)
    least = rows.groupBy("fp").agg(F.min("id").alias("component_id"))
    return rows.join(least, "fp").select(F.col("id").alias(id_column), *also, "fp", "component_id")
