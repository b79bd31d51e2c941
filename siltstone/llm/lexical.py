"""Ranked lexical search with integer scores: postings meet the terms of items, sums are ranked.

Postings are a DataFrame (bucket, term, row, id, n, tf), one row a term and text.  They are
counted where a text lies, in Arrow batches, so nothing is shuffled for them.  A text with terms also has one posting of the empty term with all its terms,
so that one aggregate over the stored postings gives the document frequencies and the corpus
numbers alike.

Items' terms are broadcast while there are at most ``BROADCAST_TERMS`` of them (counted);
only their postings are stored then, dealt by text, so that every text's sums are made where
its postings are.  Beyond that both sides meet by bucket and term in a shuffle; a bucket holds a
slice of the texts, and so a term that most texts hold is spread over many.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bytes_of, handed_over, in_arrow, prepare, text_of

#: Terms: runs of ASCII letters and digits and of anything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows (item, term) that may be broadcast.
BROADCAST_TERMS = 200_000
#: Buckets of terms; postings of a term in one slice of its bucket; matches that one task adds up.
BUCKETS, SLICE_ROWS, TASK_MATCHES = 64, 1_000_000, 4_000_000


#: What each byte of a text becomes in a term; 0 ends a term.
FOLDED = np.array([i if i > 0x7F or chr(i).isalnum() else 0 for i in range(256)], np.uint8)
FOLDED[65:91] += 32


def terms(text: Column) -> Column:
    """The terms of a text in order, A-Z in lower case."""
    return F.regexp_extract_all(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), F.lit(TERM), F.lit(0))


def split(texts: pa.Array) -> tuple[pa.StringArray, np.ndarray]:
    """All terms of a column of texts, and the number of each one's text: what ``terms`` gives, for whole batches."""
    data, off = bytes_of(texts)
    data, ends = FOLDED[data], off[1:]
    inside = data != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts = off[:-1][off[:-1] < len(data)]
    first[starts] = inside[starts]  # a text's first byte begins a term whatever came before
    at = np.flatnonzero(first)
    kept = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)]).astype(np.int32)
    bounds = np.append(kept[at], kept[-1]).astype(np.int32)
    made = pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[inside]))
    return made, np.searchsorted(ends, at, side="right")


def _counted(known):
    """Rows (row, id, n, term, tf) of a batch (row, id, text); terms outside ``known``, if any are given, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known is None else pa.array(known.value, pa.string())
        for b in batches:
            made, of = split(b.column(2))
            n = np.bincount(of, minlength=b.num_rows)
            coded = made.dictionary_encode()
            names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            if wanted is not None:
                keep = pc.is_in(names, value_set=wanted).to_numpy(zero_copy_only=False)[code] if len(code) else np.zeros(0, bool)
                of, code = of[keep], code[keep]
            pairs, tf = np.unique(of * (len(names) + 1) + code, return_counts=True)
            of, code = np.divmod(pairs, len(names) + 1)
            some = np.flatnonzero(n)  # texts with terms: their posting of the empty term
            at = np.concatenate([some, of])
            term = pa.concat_arrays([pa.array([""] * len(some), pa.string()), names.take(pa.array(code))])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(n[at]), term, pa.array(np.concatenate([n[some], tf]))], names=["row", "id", "n", "term", "tf"])

    return run


def postings(docs: DataFrame, id_column: str = "doc_id", text: str = "text", known: list[str] | None = None) -> DataFrame:
    """(row, id, n, term, tf): each distinct term of each text (of those ``known``), and one row ('', n) a text with terms.

    ``row`` tells rows of one id apart.  Null and empty texts have no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), text_of(docs, text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_arrow(rows, _counted(None if known is None else spark.sparkContext.broadcast(known)), f"row long, id {kind}, n long, term string, tf long")


def bucket(slices: int) -> Column:
    """Where a posting lies: its term's bucket, and in it the slice of its text."""
    return (F.pmod(F.xxhash64("term"), F.lit(BUCKETS)) * slices + F.pmod(F.xxhash64("row"), F.lit(slices))).cast("int")


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_terms: int = BROADCAST_TERMS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``item_id``, ``rank`` (int, from 1), ``doc_id``, ``score`` (long): the ``k`` best texts of each item, scores above 0 only.

    With N texts that hold a term, L terms in all of them, n in one, df texts with a term and tf
    its occurrences in a text: weight w = floor(1000 * ln((2N + 2) / (2df + 1))) in doubles,
    m = 10 + (90 * n * N) div L, score = sum of w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the
    item's distinct terms, in 64-bit integers.  Equal scores rank by ascending id.

    Null texts count as empty and are never found; items without terms have no rows.  Every row of
    a repeated document id is a text of its own; rows of a repeated item id are one item with all
    their terms.  Null ids are kept, first among equals.  Other columns are ignored, whatever their
    names.  Very long texts are one array of terms in a row.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item"), F.explode(terms(text_of(items, item_text))).alias("term")).distinct()
    few = asked.limit(broadcast_terms + 1).count() <= broadcast_terms
    if few:
        stored = handed_over(postings(docs, id_column, text, [r.term for r in asked.select("term").distinct().collect()]))
    else:
        known = asked.select("term").unionByName(spark.range(1).select(F.lit("").alias("term"))).distinct()
        stored = handed_over(postings(docs, id_column, text).join(known, "term", "left_semi").select("row", "id", "n", "term", "tf"))
    counts = stored.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))
    found = counts.where("term = ''").first()
    total_docs, total_terms = (found["df"], found["total"]) if found else (0, 1)
    weight = F.floor(1000 * F.log(F.lit(2.0 * total_docs + 2) / (2 * F.col("df") + 1)))
    weights = asked.join(counts.where("term <> ''"), "term").select("item", "term", "df", weight.alias("w"))
    most, matches = weights.agg(F.max("df"), F.sum("df")).first()
    slices = 1 if few else max(1, -(-(most or 0) // slice_rows))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(matches or 0) // TASK_MATCHES))
    held = stored.where("term <> ''").withColumn("m", F.expr(f"10L + (90L * n * {total_docs}L) div {total_terms}L")).drop("n")
    if few:
        met = held.repartition(tasks, "row").withColumn("bucket", bucket(1)).join(F.broadcast(weights.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))), ["bucket", "term"])
    else:
        spread = weights.withColumn("row_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        spread = spread.withColumn("bucket", (F.pmod(F.xxhash64("term"), F.lit(BUCKETS)) * slices + F.col("row_slice")).cast("int")).drop("row_slice")
        met = held.withColumn("bucket", bucket(slices)).join(spread, ["bucket", "term"])
    scored = met.groupBy("row", "id", "item").agg(F.sum(F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))")).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id", "row"))
    best = scored.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')"
ORACLE_SQL = f"""WITH d AS (SELECT doc_id, t, len(t)::BIGINT AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM i JOIN f USING (term) JOIN p USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
