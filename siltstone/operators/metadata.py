"""Document metadata: lookups with a fallback to names, aliases, citations, resumable cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gap import keep_first


def parse_stem(stem: Column) -> Column:
    """struct(cycle, year, country) of names like ``NDC2_2021_South_Africa``; null parts where the name has none."""
    cycle = F.regexp_extract(stem, r"^[A-Za-z]+([0-9]+)_", 1)
    year = F.regexp_extract(stem, r"_([0-9]{4})(?:_|$)", 1)
    country = F.translate(F.regexp_extract(stem, r"^[A-Za-z]+[0-9]+_[0-9]{4}_(.+)$", 1), "_", " ")
    return F.struct(cycle.try_cast("int").alias("cycle"), year.try_cast("int").alias("year"), F.nullif(country, F.lit("")).alias("country"))


def with_metadata(docs: DataFrame, known: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds cycle, year and country: from the reference table ``known`` (stem, cycle, year, country), else from the name."""
    k = known.select(F.col("stem").alias("__stem"), *[F.col(c).alias(f"__{c}") for c in ("cycle", "year", "country")])
    met = docs.join(k, F.col(stem) == F.col("__stem"), "left").withColumn("__parsed", parse_stem(F.col(stem)))
    found = F.col("__stem").isNotNull()
    out = [F.when(found, F.col(f"__{c}")).otherwise(F.col("__parsed")[c]).alias(c) for c in ("cycle", "year", "country")]
    return met.select(*docs.columns, *out)


# What a benchmark report is taken for where the reference table does not know it.
BENCHMARK_DEFAULTS = {"doc_type": "IPCC_AR6", "wg": "Unknown", "relevance": ""}


def with_benchmark_metadata(docs: DataFrame, known: DataFrame, stem: str = "stem") -> DataFrame:
    """Adds doc_type, wg, relevance, year and chapter from ``known`` (stem and any of these), with defaults for the first three; country is null."""
    names = ("doc_type", "wg", "relevance", "year", "chapter")
    k = known.select(F.col("stem").alias("__stem"), *[F.col(c).alias(f"__{c}") for c in names if c in known.columns])
    met = docs.join(k, F.col(stem) == F.col("__stem"), "left")
    have = lambda c: F.col(f"__{c}") if c in known.columns else F.lit(None).cast("string" if c in BENCHMARK_DEFAULTS else "int")
    out = [(F.coalesce(have(c), F.lit(BENCHMARK_DEFAULTS[c])) if c in BENCHMARK_DEFAULTS else have(c)).alias(c) for c in names]
    return met.select(*docs.columns, *out, F.lit(None).cast("string").alias("country"))


def expand_aliases(docs: DataFrame, aliases: DataFrame, entity: str = "country") -> DataFrame:
    """A document of an entity stands for its aliases too: ``aliases`` (entity, alias); its own row stays."""
    more = docs.join(aliases, docs[entity] == aliases["entity"]).select(*[aliases["alias"].alias(c) if c == entity else docs[c] for c in docs.columns])
    return docs.unionByName(more)


def cite(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (…, doc) with country, year and source of the document's first chunk; nulls for unknown documents."""
    first = keep_first(chunks, ["doc_id"], F.col("chunk_index")).select(F.col("doc_id").alias("doc"), "country", "year", "source")
    return citations.join(first, "doc", "left")


def match_names(wanted: DataFrame, have: DataFrame, name: str = "name") -> DataFrame:
    """``wanted`` with the spelling ``found`` in ``have``: exact first, else whatever the case."""
    h = have.select(F.col(name).alias("found"), F.lower(name).alias("__low"))
    met = wanted.withColumn("__low", F.lower(name)).join(h, "__low", "left")
    return keep_first(met, [name], (F.col("found") == F.col(name)).desc_nulls_last(), F.col("found")).drop("__low")


def unfinished(cells: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("entity", "dimension")) -> DataFrame:
    """The cells that have no result yet, for runs that go on where one stopped."""
    return cells.join(done.select(*keys), list(keys), "left_anti")
