"""The gap analysis of all cells in one plan: retrieve, extract, classify, find gaps, assemble, compare.

Each model pass is a batch stage over all (entity, dimension) rows; what it replies is read as
JSON, repaired if need be, with a default for every field.  A pass that fails leaves nulls in
its own columns and a status, and never a score.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.scores import canonical_gap_type, dirty_null, severity_label
from siltstone.functions.text import repair_json

from .gap import pairs, worst_finding
from .prompts import Generator, generate

COMMITMENTS = "struct<commitments:array<struct<text:string,target_value:string,target_year:string,conditional:boolean,confidence:double>>>"
MEASURABILITY = "struct<level:string,score:double,reason:string,missing_elements:array<string>>"
FINDINGS = "struct<gap_findings:array<struct<gap_type:string,severity:string,severity_score:double,description:string,confidence:double>>,summary:string>"


def search_text(entity: Column, keywords: Column, suffix: str, n: int = 4) -> Column:
    """What to search for: the entity, its dimension's first keywords, and a suffix."""
    return F.concat_ws(" ", entity, F.array_join(F.slice(keywords, 1, n), " "), F.lit(suffix))


def model_pass(df: DataFrame, name: str, instruction: str, schema: str, generator: Generator, *inputs: str, **options) -> DataFrame:
    """Adds the struct ``name`` that a reply holds, null if it holds none, and ``name`` + ``_error``."""
    prompt = F.concat_ws("\n\n", F.lit(instruction), *[F.concat(F.lit(f"{c.upper()}:\n"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in inputs])
    asked = generate(df.withColumn("__prompt", prompt), generator, "__prompt", "__reply", **options)
    return asked.withColumn(name, F.from_json(repair_json(F.col("__reply")), schema)).withColumnRenamed("error", f"{name}_error").drop("__prompt", "__reply")


def unique_commitments(c: Column) -> Column:
    """Commitments of all cycles, the first of those whose texts begin with the same 100 characters; dirty values cleaned."""
    # sorted by beginning and place, the first of each beginning stays; then back to the order of places
    numbered = F.array_sort(F.transform(c, lambda x, i: F.struct(F.substring(x.text, 1, 100).alias("start"), i.alias("i"), x.alias("x"))))
    firsts = lambda s: F.filter(s, lambda e, k: (k == 0) | ~e.start.eqNullSafe(F.get(s, k - 1).start))
    kept = F.get(F.transform(F.array(numbered), lambda s: F.array_sort(F.transform(firsts(s), lambda e: F.struct(e.i.alias("i"), e.x.alias("x"))))), F.lit(0))
    kept = F.transform(kept, lambda e: e.x)
    return F.transform(kept, lambda x: F.struct(x.text.alias("text"), dirty_null(x.target_value).alias("target_value"), x.target_year.try_cast("int").alias("target_year"), F.coalesce(x.conditional, F.lit(False)).alias("conditional"), F.coalesce(x.confidence, F.lit(0.5)).alias("confidence")))


def analyse(cells: DataFrame, generator: Generator, **options) -> DataFrame:
    """One row a cell: commitments, level, score, label, status and findings.

    ``cells``: entity, position, dimension, evidence, benchmark (texts, retrieved once for all).
    """
    a = model_pass(cells, "a", "List the commitments as JSON.", COMMITMENTS, generator, "entity", "dimension", "evidence", **options)
    a = a.withColumn("commitments", unique_commitments(F.coalesce(F.col("a.commitments"), F.array().cast("array<struct<text:string,target_value:string,target_year:string,conditional:boolean,confidence:double>>")))).withColumn("listed", F.to_json("commitments"))
    b = model_pass(a, "b", "Classify how measurable the commitments are, as JSON.", MEASURABILITY, generator, "entity", "listed", **options)
    c = model_pass(b, "c", "Name the gaps to the benchmark as JSON.", FINDINGS, generator, "entity", "dimension", "listed", "benchmark", **options)
    found = F.transform(F.coalesce(F.col("c.gap_findings"), F.array().cast("array<struct<gap_type:string,severity:string,severity_score:double,description:string,confidence:double>>")), lambda f: F.struct(canonical_gap_type(f.gap_type).alias("gap_type"), f.gap_type.alias("raw_gap_type"), F.coalesce(f.severity, F.lit("MINOR")).alias("severity"), f.severity_score.alias("severity_score"), f.description.alias("description"), F.coalesce(f.confidence, F.lit(0.5)).alias("confidence")))
    out = c.withColumn("gap_findings", found).withColumn("worst", worst_finding(F.col("gap_findings")))
    status = F.when(F.col("c").isNull(), "no findings parsed").when(F.col("a").isNull(), "no commitments parsed").otherwise("ok")
    return out.select(
        "entity", "position", "dimension", "commitments", F.coalesce("b.level", F.lit("unclear")).alias("level"), F.col("worst.score").alias("score"), severity_label(F.col("worst.score")).alias("label"),
        F.col("worst.severity_first").alias("severity_first"), F.col("worst.severity_of_max").alias("severity_of_max"), "gap_findings", F.coalesce("c.summary", F.lit("")).alias("summary"), status.alias("status"),
    )


def compare(analyses: DataFrame) -> DataFrame:
    """Pairs of entities of each dimension by score, the fallback where no model compares; cells without a score have no pair."""
    return pairs(analyses.where("score is not null"))


def report(analyses: DataFrame) -> DataFrame:
    """One JSON document a dimension: its cells by position, mean score and how many have one."""
    cell = F.struct("position", "entity", "score", "label", "level", "commitments", "gap_findings", "summary", "status")
    by = analyses.groupBy("dimension").agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.avg("score").alias("mean_score"), F.count("score").alias("scored"))
    return by.select("dimension", "mean_score", "scored", F.to_json(F.struct("dimension", "mean_score", "cells")).alias("report"))


def stand_in(prompts: list[str]) -> list[str]:
    """A deterministic model for the three passes, by what the prompt asks; every fifth reply is no JSON."""
    out = []
    for p in prompts:
        n = sum(p.encode()) % 100
        if n % 5 == 4:
            out.append("I cannot say.")
        elif p.startswith("List"):
            out.append("```json\n" + json.dumps({"commitments": [{"text": f"Reduce by {n} percent", "target_value": str(n), "target_year": "2030", "conditional": n % 2 == 0}] * 2}) + "\n```")
        elif p.startswith("Classify"):
            out.append(json.dumps({"level": ("VAGUE", "QUANTIFIED", "ABSENT")[n % 3], "score": n / 100}))
        else:
            out.append("Result: " + json.dumps({"gap_findings": [{"gap_type": "MISSING_COMMITMENT", "severity": "MAJOR", "severity_score": n / 100}], "summary": "done"}) + " end")
    return out
