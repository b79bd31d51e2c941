"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, tokenizing.

``STAGES`` lists (name, function) in order.  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``, in their order.
Each stage works on all rows that the one before it kept.  Null ids, texts and sources pass
through every stage as the operators define; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import minhash, mixing, piece_bpe, quality, simhash, toxicity
from siltstone.llm.common import fresh, handed_over, table

#: A document is toxic, or good, from this probability on.
THRESHOLD = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is below the threshold; the models learn from all labelled ones."""
    score = fresh(docs, "toxicity")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = toxicity.score(docs, model, out=score, keep_text=True)
    return scored.where(F.col(score) < THRESHOLD).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality reaches the threshold."""
    score = fresh(docs, "quality")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = quality.score(docs, model, out=score, keep_text=True)
    return scored.where(F.col(score) >= THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group whose sets of five-word shingles are linked by a similarity of at least 0.8.

    Pairs come from fingerprints at 2 or fewer differing bits and, for those farther apart, from MinHash bands; an exact check follows.
    """
    return simhash.keep_one(docs, find=minhash.near_duplicates, fingerprints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources reach their target sizes."""
    copies = fresh(docs, "copies")
    mixed = mixing.mix(docs, copies=copies)
    each = fresh(mixed, "each")
    repeated = mixed.where(F.col(copies) > 0).withColumn(each, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
    return repeated.select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: ``doc_id``, ``source``, ``n_tokens``, ``ids``."""
    ids = piece_bpe.tokenize(docs.select("doc_id", "source", "text"), piece_bpe.read_model())
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokenize", tokenize),
]

#: No SQL: language models, a network and random draws are tested against their parts instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of a data directory, each on what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = handed_over(docs)
    return docs
