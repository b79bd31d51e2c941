"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the copy number ``target / size`` of its source; the whole part is
certain, the fraction is a probability.  The pivotal method pairs two fractional documents of a
source and moves mass between them (a probability times the document's size) at random, up
or down, so that one of them becomes 0 or 1 while each keeps its expected copies and the
pair's expected size stays exactly the same.  What remains fractional meets the next.

Documents are dealt by hash into groups of a source.  Each group is one sorted stream that
holds a single undecided row, so its size does not matter; its last undecided row goes up a
reduction tree with a fan-in of 64.  Streams run from large to small documents, so that the
last one is small as a rule; it is rounded to the nearer side, and a source thus misses its
target by at most half a document.

All draws come from hashes of the rows' contents: reruns agree on any cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, aliased, cut, freed, fresh, handed_over, in_arrow, prepare, row_hash, small_side, text_of

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (5, 2, 1)


def targets(docs: DataFrame, source: str = "source", size: str = "size", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target``: how much of each source a mix takes.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times
    all sizes.  None takes more than ``most`` times its size; the excess is shared again by
    weight.  The level at which that ends is found at once: sources are sorted by the level
    at which they would be full, and running sums tell which of them are.  One row a source
    meets in one task, no document does.
    """
    if share > most:
        raise ValueError("the mix asks for more than the sources may give")
    by = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    full = by.select("source", "source_size", weight.alias("w")).withColumn("full", most * F.col("source_size") / F.col("w"))
    ranked = Window.orderBy(F.col("full"), F.col("source").asc_nulls_last())
    before, everything = ranked.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = full.select(
        "*",
        F.row_number().over(ranked).alias("rank"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("w").over(everything).alias("all_w"),
    )
    # what a weight of 1 gets if the sources before this one are full; right from the first that this does not fill
    per_weight = (share * F.col("all_size") - most * F.col("before")) / (F.col("all_w") - F.col("w_before"))
    first = F.min(F.when(per_weight <= F.col("full"), F.struct(F.col("rank"), per_weight.alias("level")))).over(everything)
    level = level.withColumn("level", first["level"])
    return level.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("level") > F.col("full")), most * F.col("source_size")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _draw(*parts) -> float:
    """A number in [0, 1) that depends on nothing but ``parts``."""
    return int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big") / 2**64


def pair(f: float, a: float, g: float, b: float, draw: float) -> tuple[float, float]:
    """New fractions of two units of sizes ``a`` and ``b``; at least one is 0 or 1."""
    up, down = min((1 - f) * a, g * b), min(f * a, (1 - g) * b)  # mass that may go to the first, or from it
    if draw * (up + down) < down:
        return (1.0, g - up / b) if (1 - f) * a <= g * b else (f + up / a, 0.0)
    return (0.0, g + down / b) if f * a <= (1 - g) * b else (f - down / a, 1.0)


EPS = 1e-12


def _pivot(names: list[str], at: dict[str, int], last: bool):
    """Streams sorted groups; adds each row's decision, -1 for a group's one undecided row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, f, size, key = None, None, 0.0, 0.0, 0  # the undecided row, a batch of one

        def out(batch: pa.RecordBatch, decided: list[int], fractions: list[float]) -> pa.RecordBatch:
            columns = list(batch.columns)
            columns[at["fraction"]] = pa.array(fractions, pa.float64())
            columns[at["taken"]] = pa.array(decided, pa.int32())
            return pa.RecordBatch.from_arrays(columns, names=names)

        def close() -> Iterator[pa.RecordBatch]:
            if held is not None:
                yield out(held, [int(f >= 0.5) if last else -1], [f])

        for b in batches:
            groups, fractions, sizes, keys = (b.column(at[c]).to_pylist() for c in ("group", "fraction", "weight", "key"))
            decided, mine = [0] * len(groups), None  # mine: where in this batch the undecided row lies
            for i, (o, g, w, k) in enumerate(zip(groups, fractions, sizes, keys, strict=True)):
                if o != group:
                    yield from close() if mine is None else ()
                    if mine is not None:
                        decided[mine], fractions[mine] = (int(f >= 0.5) if last else -1), f
                    held, mine, group = None, None, o
                if w <= 0 or g <= EPS or g >= 1 - EPS:
                    decided[i] = int(w > 0 and g >= 1 - EPS)
                    continue
                if held is None and mine is None:
                    mine, f, size, key = i, g, w, k
                    continue
                f, g = pair(f, size, g, w, _draw(key, k))
                if EPS < f < 1 - EPS:
                    decided[i] = int(g >= 1 - EPS)
                    continue
                if mine is None:
                    yield out(held, [int(f >= 1 - EPS)], [f])
                    held = None
                else:
                    decided[mine], mine = int(f >= 1 - EPS), None
                if EPS < g < 1 - EPS:
                    mine, f, size, key = i, g, w, k
                else:
                    decided[i] = int(g >= 1 - EPS)
            if mine is None:
                yield out(b, decided, fractions)
            else:
                rest = [i for i in range(len(groups)) if i != mine]
                yield out(b.take(pa.array(rest, pa.int64())), [decided[i] for i in rest], [fractions[i] for i in rest])
                held = b.slice(mine, 1)
        yield from close()

    return run


def _groups(rows: int) -> int:
    """Streams that the rows of a source are dealt to: some 2,000 rows of the whole table each."""
    return max(64, 1 << (rows // 2048).bit_length())


def mix(docs: DataFrame, source: str = "source", size: str | None = None, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, groups: int | None = None, copies: str = "copies") -> DataFrame:
    """``docs`` with the column ``copies`` (int): how often the mix takes each row.

    The size of a row is the column ``size``, or the number of words of ``text`` if that is
    not given; null sizes and texts count 0, and such rows are never taken.  A null source is
    a source of its own.  All other columns stay as they are; only an own column ``copies`` is
    replaced.  Repeated rows are drawn one by one.  Long texts do not matter: only keys and
    sizes are sorted.  Also adds ``copies`` + ``_size``, ``_source_size`` and ``_target`` (with ``_`` more where
    such a column is there).  No rows give none.
    """
    spark = docs.sparkSession
    prepare(spark)
    freed(spark)  # what steps before have left, of files and of the driver's memory
    results = [copies, *[fresh(docs, f"{copies}_{c}") for c in ("size", "source_size", "target")]]
    given, back = aliased(docs, *results)
    count = F.regexp_count(text_of(docs, text), F.lit(WORD)) if size is None else F.coalesce(docs[size], F.lit(0))
    # written once, so that a number can name each row
    kept = handed_over(docs.select(*given, docs[source].alias("source"), count.cast("long").alias("size"), row_hash(docs).alias("key"), F.monotonically_increasing_id().alias("row")))
    groups = groups or _groups(kept.count())
    light = kept.select("source", "size", "key", "row")
    goal = targets(light, weights=weights, share=share, most=most).toDF("goal_source", "source_size", "target")
    # one row a source; whether it is broadcast is left to Spark, which knows its size by then
    met = light.join(goal, light.source.eqNullSafe(F.col("goal_source"))).drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    group = lambda place: F.xxhash64("source", F.col("source").isNull(), place)
    place = F.pmod(F.col("key"), F.lit(groups)).cast("int")
    ready = met.select(
        "source", "size", "source_size", "target", "row", "key", place.alias("place"), F.floor(rate).cast("int").alias("whole"), (rate - F.floor(rate)).alias("fraction"),
        F.col("size").cast("double").alias("weight"), F.lit(-1).alias("taken"), group(place).alias("group"),
    )
    done, level = None, groups
    while True:
        names = list(ready.columns)
        at = {c: names.index(c) for c in ("group", "fraction", "weight", "key", "taken")}
        run = in_arrow(ready.repartition("group").sortWithinPartitions("group", F.col("weight").desc(), "key"), _pivot(names, at, level == 1), ready.schema)
        run = cut(run)
        done = run.where("taken >= 0") if done is None else done.unionByName(run.where("taken >= 0"))
        if level == 1:
            break
        level = -(-level // 64)
        upper = F.floor(F.col("place") / 64).cast("int")
        ready = run.where("taken < 0").withColumn("place", upper).withColumn("group", group(upper))
    took = F.when(F.col("size") > 0, F.col("whole") + F.col("taken")).otherwise(0)
    decided = done.select("row", took.alias("copies"), "source_size", "target")
    out = kept.drop("source", "key").join(small_side(decided), "row")
    return out.select(*back, *[F.col(c).alias(r) for c, r in zip(("copies", "size", "source_size", "target"), results, strict=True)])
