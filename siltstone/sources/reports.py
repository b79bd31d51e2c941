"""Reports and result files whose values come in several shapes, read as VARIANT.

A file is parsed once into a VARIANT; paths into it are tried shape by shape.  No schema is inferred,
so a scan reads each file once, whatever the others hold, and a file that is no JSON gives a null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.scores import severity_label


def read_variants(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """(file, stem, value): one row a file below ``path``; ``value`` is null where the file is no JSON."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    text = F.regexp_replace("value", "^\\uFEFF", "")
    return files.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("stem"), F.try_parse_json(text).alias("value"))


def malformed(values: DataFrame) -> DataFrame:
    """The files of ``read_variants`` that are no JSON."""
    return values.where(F.col("value").isNull()).select("file")


def at(value: Column, path: str, kind: str = "string") -> Column:
    """The value at a path as a type, null where it is absent or of another kind."""
    return F.try_variant_get(value, path, kind)


def number(value: Column, *paths: str) -> Column:
    """The first of several paths that holds a number other than 0, or text of one."""
    return F.coalesce(*[F.nullif(at(value, p, "double"), F.lit(0.0)) for p in paths])


def truthy(value: Column, path: str) -> Column:
    """Whether there is anything at a path: not null, false, 0, or an empty text, list or object."""
    text = at(value, path, "string")
    return F.coalesce(~F.trim(text).isin("", "false", "0", "0.0", "[]", "{}", "null"), F.lit(False))


def items(value: Column, path: str, names: tuple[str, ...]) -> Column:
    """The list at a path as an array of VARIANT: the list itself, or of an object of lists the first of ``names`` that is one; else empty."""
    shapes = [at(value, path, "array<variant>"), *[at(value, f"{path}['{n}']", "array<variant>") for n in names]]
    return F.coalesce(*shapes, F.array().cast("array<variant>"))


def keyed_items(df: DataFrame, value: str = "value", path: str = "$.per_query", names: tuple[str, ...] = (), keys: tuple[str, ...] = ("qid", "id")) -> DataFrame:
    """``df`` without ``value``, with (name, key, item) for each element of the lists at ``path``.

    An object of lists gives the elements of all its lists, or of those in ``names``, with the list's
    ``name``; a plain list gives them with a null name.  Elements without any of ``keys``, and values
    of other shapes, give no rows.
    """
    v = F.col(value)
    lists = F.map_filter(F.coalesce(at(v, path, "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda n, x: n.isin(*names) if names else F.lit(True))
    named = F.transform(F.map_entries(lists), lambda e: F.struct(e.key.alias("name"), F.try_variant_get(e.value, "$", "array<variant>").alias("list")))
    plain = F.array(F.struct(F.lit(None).cast("string").alias("name"), at(v, path, "array<variant>").alias("list")))
    rest = [c for c in df.columns if c != value]
    rows = df.select(*rest, F.explode(F.concat(plain, named)).alias("l")).select(*rest, "l.name", F.explode("l.list").alias("item"))
    key = F.coalesce(*[F.nullif(at(F.col("item"), f"$.{k}"), F.lit("")) for k in keys])
    return rows.select(*rest, "name", key.alias("key"), "item").where("key is not null")


def single_reports(values: DataFrame) -> DataFrame:
    """(dimension, entity, score, label, answered, level, commitments) of cell reports named ``DIMENSION__ENTITY``.

    The name is cut at its first two underscores; an entity's underscores stand for spaces.
    ``answered``: whether the last pass left any output; ``level`` is ABSENT where none is given.
    """
    v, stem = F.col("value"), F.col("stem")
    score = at(v, "$.score", "double")
    return values.where(stem.contains("__") & v.isNotNull()).select(
        F.substring_index(stem, "__", 1).alias("dimension"), F.translate(F.regexp_extract(stem, r"^.*?__(.*)$", 1), "_", " ").alias("entity"), score.alias("score"),
        F.coalesce(at(v, "$.label"), severity_label(score)).alias("label"), truthy(v, "$.details.raw_llm_outputs.pass_c").alias("answered"),
        F.coalesce(at(v, "$.details.measurability.level"), F.lit("ABSENT")).alias("level"), F.coalesce(F.size(at(v, "$.details.commitments", "array<variant>")), F.lit(0)).alias("commitments"),
    )


def findings(values: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, entity, file, score, severity) of reports named ``gap_DIMENSION_...``, one row an analysed entity.

    ``score`` is the largest of an entity's findings, under either of two names, zeros and other kinds
    left out; ``severity`` is the overall one, or the first finding's.
    """
    v, stem = F.col("value"), F.col("stem")
    fits = [F.when(stem.startswith(f"gap_{d}_"), F.lit(d)) for d in dimensions]
    rows = values.select("file", "value", F.explode(F.array_compact(F.array(*fits))).alias("dimension"))
    rows = rows.select("file", "dimension", F.explode(at(v, "$.country_analyses", "map<string,variant>")).alias("entity", "one"))
    found = at(F.col("one"), "$.gap_findings", "array<variant>")
    scores = F.transform(found, lambda f: number(f, "$.severity_score", "$.score"))
    severity = F.coalesce(at(F.col("one"), "$.overall_severity"), at(F.get(found, F.lit(0)), "$.severity"))
    return rows.select("dimension", "entity", "file", F.array_max(scores).alias("score"), severity.alias("severity"))


def original_reports(values: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, entity, score, severity, file): of each cell the first file, by path, that holds a score."""
    first = findings(values, dimensions).where("score is not null").groupBy("dimension", "entity").agg(F.min_by(F.struct("score", "severity", "file"), "file").alias("x"))
    return first.select("dimension", "entity", "x.score", F.coalesce("x.severity", severity_label(F.col("x.score"))).alias("severity"), "x.file")
