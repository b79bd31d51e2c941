"""What several sources say of one key, merged by precedence in one aggregate.

A chain of left joins shuffles the left side once a source and meets repeated keys as more
rows.  Here the sources are stacked with their rank, and one aggregate over the key picks, column by
column, the first value that is there: one shuffle for any number of sources, with a row a key and task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(spine: DataFrame, sources: list[tuple[str, DataFrame]], key: str | list[str], whole: bool = False, place: str | None = None) -> DataFrame:
    """``spine`` (one row a key) with the columns of ``sources`` (tag, rows), the first source going first.

    Each column takes the first value by precedence that is not null, or, with ``whole``, the value of the
    first source that has the key at all.  Of rows of one source with one key the last by ``place`` (a
    column of the sources that have it) counts, else any.  ``from_TAG`` tells whether a source has the key.
    Keys that ``spine`` does not have are left out; a null key is a key.  Columns that the
    spine has too keep the spine's values.
    """
    keys = [key] if isinstance(key, str) else key
    own = [c for c in spine.columns if c not in keys]
    columns = list(dict.fromkeys(c for _, s in sources for c in s.columns if c not in (*keys, *own, place)))

    def tagged(df: DataFrame, rank: int) -> DataFrame:
        order = F.struct(F.lit(rank).alias("rank"), (-F.col(place).cast("double") if place in df.columns else F.lit(0.0)).alias("place"))
        gone = [*([place] if place else []), *([c for c in own if c in df.columns] if rank else [])]
        return df.withColumn("__order", order).drop(*gone)

    stack = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tagged(s, r) for r, (_, s) in enumerate([("", spine), *sources])])
    rank = F.col("__order.rank")
    picked = [F.min_by(c, F.when(F.col(c).isNotNull() | (F.lit(whole) & (rank > 0)), F.col("__order"))).alias(c) for c in columns]
    kept = [F.min_by(c, F.when(rank == 0, F.col("__order"))).alias(c) for c in own]
    have = [F.coalesce(F.bool_or(rank == r + 1), F.lit(False)).alias(f"from_{tag}") for r, (tag, _) in enumerate(sources)]
    met = stack.groupBy(*keys).agg(F.bool_or(rank == 0).alias("__spine"), *kept, *picked, *have)
    return met.where("__spine").drop("__spine")


def spread_models(results: DataFrame, key: str, model: str, value: str, names: dict[str, str]) -> DataFrame:
    """(key, one column a model): the value of each model named in ``names`` (model -> column), in one aggregate; the largest of repeats."""
    return results.groupBy(key).agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(c) for m, c in names.items()])


def retrieval_hit(rate: Column, precision: Column) -> Column:
    """Whether a question's document was found: by its hit rate where that is above 0, else by the precision of its contexts (.5 where unknown)."""
    return F.when(rate > 0, rate > 0.5).otherwise(F.coalesce(precision, F.lit(0.5)) > 0.3)


def settle_label(label: Column, score: Column, from_single: Column, from_original: Column, by_score) -> Column:
    """A cell's label in a summary: a single report's own, or by its score; else by an original report's score; else MISSING."""
    return F.when(from_single, F.coalesce(label, by_score(score))).when(from_original, by_score(score)).otherwise("MISSING")
