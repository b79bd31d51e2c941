"""Gap scoring: cells with precedence, matrices, pairs, rankings, keep-first dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scores import measurability_score, severity_label


#: Dimensions that may be broadcast.
GRID_ROWS = 10_000


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a stated order (not whichever comes first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def grid(entities: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Every entity with every dimension; both are reference tables, and dimensions are broadcast up to ``GRID_ROWS`` (counted)."""
    few = dimensions.limit(GRID_ROWS + 1).count() <= GRID_ROWS
    return entities.crossJoin(F.broadcast(dimensions) if few else dimensions)


def merge_cells(cells: DataFrame, override: DataFrame, single: DataFrame, original: DataFrame, keys: tuple[str, str] = ("entity", "dimension")) -> DataFrame:
    """Score, label and source of each cell: override, single report, heuristic, original, or missing.

    ``override``: keys, score.  ``single``: keys, score, level, commitments, has_findings.
    ``original``: keys, score.  A single report without findings counts only through its
    measurability.  Each input has at most one row a cell.
    """
    keys = list(keys)
    met = cells.join(override.select(*keys, F.col("score").alias("o_score")), keys, "left")
    met = met.join(single.select(*keys, F.col("score").alias("s_score"), "level", "commitments", "has_findings"), keys, "left")
    met = met.join(original.select(*keys, F.col("score").alias("r_score")), keys, "left")
    part = lambda score, source: F.struct(score.cast("double").alias("score"), F.lit(source).alias("source"))
    best = F.coalesce(
        F.when(F.col("o_score").isNotNull(), part(F.col("o_score"), "override")),
        F.when(F.col("has_findings") & F.col("s_score").isNotNull(), part(F.col("s_score"), "single")),
        F.when(F.col("level").isNotNull(), part(measurability_score(F.col("level"), F.col("commitments")), "heuristic")),
        F.when(F.col("r_score").isNotNull(), part(F.col("r_score"), "original")),
        part(F.lit(None), "missing"),
    )
    met = met.withColumn("best", best)
    return met.select(*keys, F.col("best.score").alias("score"), severity_label(F.col("best.score"), "MISSING").alias("label"), F.col("best.source").alias("source"))


def matrix(cells: DataFrame, dimensions: list[str], value: str = "score", keys: tuple[str, str] = ("entity", "dimension")) -> DataFrame:
    """Entity × dimension; the columns are stated, so no pass is spent on finding them."""
    return cells.groupBy(keys[0]).pivot(keys[1], dimensions).agg(F.first(value))


def pairs(scores: DataFrame, entity: str = "entity", position: str = "position", dimension: str = "dimension", score: str = "score") -> DataFrame:
    """Pairs of entities (first before second) with both scores and the leader: the lower score, ties to the second.

    The join is an equi-join on the dimension; one dimension has one row an entity.
    """
    a = scores.select(dimension, F.col(entity).alias("entity_a"), F.col(position).alias("pos_a"), F.col(score).alias("score_a"))
    b = scores.select(dimension, F.col(entity).alias("entity_b"), F.col(position).alias("pos_b"), F.col(score).alias("score_b"))
    met = a.join(b, dimension).where("pos_a < pos_b")
    gap = F.abs(F.col("score_a") - F.col("score_b"))
    return met.select(dimension, "entity_a", "entity_b", "score_a", "score_b", gap.alias("relative_gap"), F.when(F.col("score_a") < F.col("score_b"), F.col("entity_a")).otherwise(F.col("entity_b")).alias("leader"))


def common_leader(scores: DataFrame, entity: str = "entity", position: str = "position", dimension: str = "dimension", score: str = "score") -> DataFrame:
    """(entity_a, entity_b, common, total_a, total_b, leader): pairs of entities over the dimensions that both have, led by the smaller total; a tie has no leader.

    All pairs of a dimension's entities meet, as many as the reference tables have; totals are added up map-side.
    """
    x = scores.where(F.col(score).isNotNull()).select(dimension, F.col(entity).alias("e"), F.col(position).alias("p"), F.col(score).alias("s"))
    a, b = (x.select(dimension, *[F.col(c).alias(f"{c}_{side}") for c in ("e", "p", "s")]) for side in "ab")
    met = a.join(b, dimension).where("p_a < p_b").groupBy(F.col("e_a").alias("entity_a"), F.col("e_b").alias("entity_b"))
    sums = met.agg(F.array_sort(F.collect_set(dimension)).alias("common"), F.round(F.sum("s_a"), 6).alias("total_a"), F.round(F.sum("s_b"), 6).alias("total_b"))
    return sums.withColumn("leader", F.when(F.col("total_a") < F.col("total_b"), F.col("entity_a")).when(F.col("total_b") < F.col("total_a"), F.col("entity_b")))


def ranking(scores: DataFrame, entity: str = "entity", score: str = "score") -> DataFrame:
    """Entities by mean score, lowest first; the mean's label and the number of scored cells."""
    by = scores.where(F.col(score).isNotNull()).groupBy(entity).agg(F.avg(score).alias("mean_score"), F.count("*").alias("cells"))
    w = Window.orderBy("mean_score", entity)  # one row an entity
    return by.withColumn("place", F.row_number().over(w).cast("bigint")).withColumn("label", severity_label(F.col("mean_score")))


def worst_finding(findings: Column) -> Column:
    """struct(score, severity_first, severity_of_max) of an array of (severity, severity_score); zero and null scores do not count."""
    scored = F.filter(findings, lambda f: F.coalesce(f.severity_score, F.lit(0.0)) > 0)
    top = F.array_max(F.transform(scored, lambda f: F.struct(f.severity_score.alias("s"), f.severity.alias("v"))))
    return F.struct(top.s.alias("score"), F.try_element_at(findings, F.lit(1)).severity.alias("severity_first"), top.v.alias("severity_of_max"))
