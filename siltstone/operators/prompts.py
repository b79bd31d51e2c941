"""Contexts, prompts and pluggable model stages.

Models are functions from a batch of prompts to a batch of replies, run by Arrow workers.
Offline stand-ins are deterministic.  Replies of real models cost money and vary, so
``persisted`` keeps them by prompt hash and asks only for prompts it has not seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A batch of prompts to a batch of replies; called once a batch in a worker.
Generator = Callable[[list[str]], list[str]]


def context_block(chunks: DataFrame, text_chars: int | None = None, section_chars: int = 80) -> DataFrame:
    """(query_id, context): numbered source headers and texts in rank order.

    ``chunks``: query_id, rank, doc_id, country, year, page, section, source, text.  Headers of gap
    analyses cut a section at 70 characters, those of answers at 80.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    # The lines of a source's header.
    body = F.concat_ws(
        "\n",
        F.format_string("--- SOURCE %d ---", "rank"),
        F.concat(F.lit("SOURCE ID : "), F.coalesce(F.col("doc_id").cast("string"), F.lit("UNKNOWN"))),
        F.format_string("Country   : %s  |  Year: %s  |  Page: %s", F.coalesce("country", F.lit("N/A")), F.coalesce(F.col("year").cast("string"), F.lit("")), F.coalesce(F.col("page").cast("string"), F.lit("?"))),
        F.concat(F.lit("Source    : "), F.coalesce("source", F.lit(""))),
        F.concat(F.lit("Section   : "), F.substring(F.coalesce("section", F.lit("")), 1, section_chars)),
        F.concat(F.lit("Content   :\n"), F.substring(text, 1, text_chars) if text_chars else text),
    )
    rows = chunks.select("query_id", F.struct(F.col("rank"), body.alias("body")).alias("b"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b.body), "\n\n").alias("context"))


def user_message(context: Column, question: Column, kind: Column, gap_note: str = "State what is missing.\n") -> Column:
    """Context, a note for gap questions, and the question."""
    return F.concat(
        F.lit("RETRIEVED CONTEXT:\n\n"), F.coalesce(context, F.lit("NO CONTEXT RETRIEVED.")), F.lit("\n\n" + "─" * 60 + "\n"),
        F.when(kind == "gap", gap_note).otherwise(""), F.lit("\nQUESTION: "), question, F.lit("\n\nAnswer (remember: use ONLY the context above, cite every claim as [doc_id, p.N]):"),
    )


def messages(system: str, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def echo_generator(prompts: list[str]) -> list[str]:
    """The stand-in: a reply that names the first source of its prompt, or says that there is none."""
    out = []
    for p in prompts:
        at = p.find("SOURCE ID : ")
        if at < 0:
            out.append("INSUFFICIENT_CONTEXT")
        else:
            doc = p[at + 12 :].split("\n", 1)[0].strip()
            out.append(f"Reply {hashlib.md5(p.encode()).hexdigest()[:8]} rests on one source [{doc}, p.1].")
    return out


def generate(df: DataFrame, generator: Generator = echo_generator, prompt: str = "prompt", out: str = "answer", partitions: int | None = None, attempts: int = 3) -> DataFrame:
    """Adds ``out`` and ``error``: replies by batch, a failing prompt asked up to ``attempts`` times alone.

    ``partitions`` bounds how many batches ask at once, as a rate limit.
    """
    rows = df.coalesce(partitions) if partitions else df
    schema = df.withColumns({c: F.lit(None).cast("string") for c in (out, "error")}).schema

    def ask(p: str) -> tuple[str | None, str | None]:
        error = None
        for _ in range(attempts):
            try:
                return generator([p])[0], None
            except Exception as e:  # noqa: BLE001 - a model's own errors become a column
                error = f"{type(e).__name__}: {e}"
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                replies = [(r, None) for r in generator(b[prompt].tolist())]
            except Exception:  # noqa: BLE001 - then one by one
                replies = [ask(p) for p in b[prompt]]
            yield b.assign(**{out: [r for r, _ in replies], "error": [e for _, e in replies]})

    return rows.mapInPandas(run, schema)


def persisted(df: DataFrame, store: str, generator: Generator = echo_generator, prompt: str = "prompt", **options) -> DataFrame:
    """Replies from a Parquet store keyed by prompt hash; new prompts are asked once and appended."""
    spark = df.sparkSession
    keyed = df.withColumn("prompt_hash", F.sha2(F.col(prompt), 256))
    try:
        known = spark.read.parquet(store).select("prompt_hash")
        fresh = keyed.select("prompt_hash", prompt).distinct().join(known, "prompt_hash", "left_anti")
    except Exception as e:  # the store begins empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = keyed.select("prompt_hash", prompt).distinct()
    generate(fresh, generator, prompt, **options).write.mode("append").parquet(store)
    return keyed.join(spark.read.parquet(store).drop(prompt), "prompt_hash", "left")


def embed(df: DataFrame, text: str = "text", out: str = "embedding", size: int = 64, prefix: str = "") -> DataFrame:
    """Unit vectors of hashed words, the offline stand-in for an embedding model; ``prefix`` as queries have one."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        def one(t: str) -> np.ndarray:
            v = np.zeros(size, np.float32)
            for w in (prefix + (t or "")).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % size] += 1 if h >> 63 else -1
            n = float(np.linalg.norm(v))
            return v / n if n else v

        return texts.map(one)

    return df.withColumn(out, vectors(F.col(text)))


def judge_overlap(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``verdict`` to (claim, context): the stand-in judge, by the share of a claim's words in the context."""
    from siltstone.functions.text import overlap_tokens

    words = claims.withColumns({"__c": F.array_distinct(overlap_tokens(F.col("claim"))), "__x": overlap_tokens(F.col("context"))})
    share = F.size(F.array_intersect("__c", "__x")) / F.greatest(F.size("__c"), F.lit(1))
    return words.withColumn("verdict", F.when(share >= 0.8, "SUPPORTED").when(share >= least, "PARTIAL").otherwise("UNSUPPORTED")).drop("__c", "__x")
