"""Pages to sections to chunks.

Sections are windows.  The chunker is a fold over the sentences of one section: what a chunk
may hold depends on where the one before it ended, so it runs in order inside a row, as an
Arrow function over arrays of sentences; rows are independent and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import heading, sentences, strip

MIN_TOKENS, MAX_TOKENS, OVERLAP = 512, 1024, 0.20


def sections(pages: DataFrame) -> DataFrame:
    """Adds ``section`` and ``page_start`` to (doc_id, page, text): the last heading so far, longer than 4.

    A page belongs wholly to its last heading; pages before any are ``Introduction``.
    """
    lines = F.transform(F.split("text", "\n"), heading)
    found = F.filter(lines, lambda h: F.length(h) > 4)
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    marked = pages.withColumn("own", F.when(F.size(found) > 0, F.element_at(found, -1)))
    return marked.select("*", F.coalesce(F.last("own", True).over(w), F.lit("Introduction")).alias("section"), F.coalesce(F.last(F.when(F.col("own").isNotNull(), F.col("page")), True).over(w), F.lit(1)).cast("bigint").alias("page_start")).drop("own")


def near_tables(pages: DataFrame) -> DataFrame:
    """Adds ``is_table``: whether this page or one of the next three has a table."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(0, 3)
    return pages.withColumn("is_table", F.max("has_table").over(w))


def count_words(text: str) -> int:
    """The offline stand-in for a tokenizer's count."""
    return len(text.split())


def fold(parts: list[str], count: Callable[[str], int] = count_words, least: int = MIN_TOKENS, most: int = MAX_TOKENS, overlap: float = OVERLAP, strict: bool = False) -> list[str]:
    """Chunks of sentences, at most ``most`` tokens, the end of each repeated at the start of the next.

    ``strict`` also leaves out chunks below ``least`` and counts a carried sentence's words one
    by one; otherwise no text is lost.
    """
    done: list[str] = []
    held: list[tuple[str, int]] = []
    budget = int(most * overlap)

    def emit(items: list[tuple[str, int]]) -> None:
        text = " ".join(t for t, _ in items).strip()
        if text and (not strict or count(text) >= least):
            done.append(text)

    for part in parts:
        size = count(part)
        if size > most:
            if not strict:
                emit(held)
                held = []
            words, total = [], 0
            for word in part.split():
                n = count(word)
                if words and total + n > most:
                    emit(words)
                    words, total = [], 0
                words.append((word, n))
                total += n
            held += words
        elif sum(n for _, n in held) + size > most:
            emit(held)
            carried, total = [], 0
            while held and total + held[-1][1] <= budget:
                carried.insert(0, held.pop())
                total += carried[0][1]
            held = [*carried, (part, size)]
        else:
            held.append((part, size))
    text = " ".join(t for t, _ in held).strip()
    if text and done and count(text) < least // 2 and count(done[-1] + " " + text) <= most * 1.2:
        done[-1] = done[-1] + " " + text
    elif text:
        done.append(text)
    return done


@lru_cache(maxsize=4)
def _loaded(kind: str, path: str):
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda text: len(t.encode(text, add_special_tokens=False).ids)
    if kind == "sentencepiece":
        import sentencepiece

        t = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda text: len(t.encode(text))
    raise ValueError(f"unknown kind of tokenizer: {kind}")


def tokenizer_count(kind: str, path: str) -> Callable[[str], int]:
    """A token count for ``fold``, by a tokenizer's file (``tokenizers`` or ``sentencepiece``), read once a worker.

    The file must be there on every executor.
    """
    return lambda text: _loaded(kind, path)(text)


def _folded(df: DataFrame, parts: Column, count: Callable[[str], int], **options) -> DataFrame:
    """``df`` with ``made``: the chunks of a column of sentences, as (text, tokens)."""
    rows = df.withColumn("parts", parts)
    kept = [c for c in rows.columns if c != "parts"]
    schema = rows.drop("parts").schema.add("made", T.ArrayType(T.StructType().add("text", "string").add("tokens", "long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [[{"text": t, "tokens": count(t)} for t in fold(p.as_py() or [], count, **options)] for p in b.column("parts")]
            kind = pa.list_(pa.struct([("text", pa.string()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(made, kind)], names=[*kept, "made"])

    return rows.mapInArrow(run, schema)


def chunks(df: DataFrame, key: str = "doc_id", text: str = "text", count: Callable[[str], int] = count_words, **options) -> DataFrame:
    """(key, chunk_index, chunk_id, text, token_count, char_count) of cleaned texts, one section each."""
    made = _folded(df.select(key, F.col(text).alias("text")), sentences(F.coalesce(F.col("text"), F.lit(""))), count, **options)
    out = made.select(key, F.posexplode("made").alias("chunk_index", "c"))
    return out.select(
        key, F.col("chunk_index").cast("bigint").alias("chunk_index"), F.format_string("%s__%05d", F.col(key).cast("string"), F.col("chunk_index")).alias("chunk_id"),
        F.col("c.text").alias("text"), F.col("c.tokens").alias("token_count"), F.length("c.text").cast("bigint").alias("char_count"),
    )


def section_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, section, page_start, is_table, text): the pages of a section as one text, sections without text left out.

    ``is_table``: whether the section's first page or one of the three after it has a table.
    """
    marked = near_tables(sections(pages))
    one = marked.groupBy("doc_id", "section", "page_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p.text), "\n").alias("text"),
        F.coalesce(F.min_by("is_table", "page"), F.lit(False)).alias("is_table"),
    )
    return one.withColumn("text", strip(F.col("text"))).where("text <> ''").select("doc_id", "section", "page_start", "is_table", "text")


#: What a chunk carries of its document, with types; missing columns of the metadata are null.
PROVENANCE = {
    "source": "string", "doc_type": "string", "country": "string", "ndc_cycle": "int", "year": "int", "language": "string", "emissions_rank": "int", "withdrawn": "boolean",
    "superseded": "boolean", "note": "string", "wg": "string", "chapter": "int", "relevance": "string", "file": "string", "file_path": "string",
}


def page_chunks(pages: DataFrame, meta: DataFrame | None = None, count: Callable[[str], int] = count_words, version: str = "1.0", **options) -> DataFrame:
    """The chunk table of (doc_id, page, text, has_table): one row a chunk, numbered through each document.

    Sections are windows over a document's pages, each section is folded by itself (see ``fold``), and a
    running sum over the sections' numbers of chunks gives every chunk its place in the document,
    so that sections of one document are chunked in different tasks.  ``meta`` (doc_id and any of
    ``PROVENANCE``, one row a document) is joined to the chunks; null pages are empty.
    """
    made = _folded(section_texts(pages), sentences(F.col("text")), count, **options).drop("text")
    before = Window.partitionBy("doc_id").orderBy("page_start").rowsBetween(Window.unboundedPreceding, -1)
    numbered = made.withColumn("first", F.coalesce(F.sum(F.size("made")).over(before), F.lit(0)))
    out = numbered.select("doc_id", "section", "page_start", "is_table", "first", F.posexplode("made").alias("i", "c"))
    out = out.withColumn("chunk_index", (F.col("first") + F.col("i")).cast("bigint"))
    known = meta.columns if meta is not None else []
    own = [F.col(c).cast(t).alias(c) if c in known else F.lit(None).cast(t).alias(c) for c, t in PROVENANCE.items()]
    if meta is not None:
        out = out.join(meta.select("doc_id", *[c for c in PROVENANCE if c in known]), "doc_id", "left")
    return out.select(
        F.format_string("%s__%05d", F.col("doc_id").cast("string"), F.col("chunk_index")).alias("chunk_id"), "doc_id", *own, "section", "page_start", F.col("c.tokens").alias("token_count"),
        F.length("c.text").cast("bigint").alias("char_count"), "chunk_index", "is_table", F.col("c.text").alias("text"), F.current_timestamp().alias("processed_at"), F.lit(version).alias("pipeline_ver"),
    )


def cycle_report(rows: DataFrame, cycle: str = "ndc_cycle") -> DataFrame:
    """(group, n): chunks by submission cycle, named ``NDC1`` and so on; rows without a cycle are left out."""
    return rows.where(F.col(cycle).isNotNull()).groupBy(F.concat(F.lit("NDC"), F.col(cycle).cast("string")).alias("group")).agg(F.count("*").alias("n"))


def corpus_report(rows: DataFrame, group: str, missing: str) -> DataFrame:
    """(group, n, tokens, mean_tokens): counts, with ``missing`` for null groups and the mean rounded down."""
    g = F.coalesce(F.col(group), F.lit(missing)).alias("group")
    return rows.groupBy(g).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"), F.floor(F.sum("tokens") / F.count("*")).cast("bigint").alias("mean_tokens"))
