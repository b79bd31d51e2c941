"""Score functions as Column expressions: labels, heuristics, costs, safe numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def severity_label(score: Column, missing: str = "ABSENT") -> Column:
    return F.when(score.isNull(), missing).when(score >= 0.80, "CRITICAL").when(score >= 0.50, "SIGNIFICANT").when(score >= 0.20, "PARTIAL").otherwise("ALIGNED")


def measurability_score(level: Column, commitments: Column) -> Column:
    """A score where an analysis is missing, from how measurable the commitments are."""
    return F.when((level == "ABSENT") | (commitments == 0), 0.85).when(level == "VAGUE", 0.65).when(level == "QUALIFIED", 0.60).when(level == "QUANTIFIED", 0.55).otherwise(0.60)


def canonical_gap_type(raw: Column) -> Column:
    """One spelling for each gap type."""
    name = F.regexp_replace(F.lower(raw), r"[^\p{L}\p{N}]+", "_")
    return F.when(name.isin("vague", "vague_vs_measurable"), "vague_target").otherwise(name)


def safe_double(value: Column, default: float = 0.0) -> Column:
    """Numbers from anything; text that is no number, NaN and null become ``default``."""
    x = value.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def dirty_null(value: Column) -> Column:
    """An empty object written for a missing value is missing."""
    return F.when(F.trim(value) != "{}", value)


def cost(tokens: Column, rate_per_thousand: float) -> Column:
    return tokens * F.lit(rate_per_thousand / 1000)


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)
