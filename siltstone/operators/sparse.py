"""BM25 over a stored inverted index, with an exact search that leaves most postings of common terms unread.

Postings are sorted by term and document across all files, in ranges of even size: a term that most
documents hold lies in many files, and no task writes or reads all of it.  Each term has its largest
number of occurrences and its shortest document, so an upper bound of what it can add to any score.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.text import tokenise
from siltstone.session import spread

#: Rows of query terms that may be broadcast.
BROADCAST_TERMS = 200_000
#: Postings of a batch's terms from which on bounds are used; below it, adding all of them up is faster.
BOUNDED_POSTINGS = 20_000_000
#: Share of a query's postings that its first, rarest terms may have; they give the first threshold.
FIRST_SHARE = 0.1
#: Decimal places of scores.
PLACES = 6


def ranked(scores: DataFrame, n: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first ``n`` rows of each query, with ``rank``; Spark limits each task before the shuffle."""
    w = Window.partitionBy(by).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))


def _counted(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc_id, dl, term, tf): the terms of each row, counted where the row lies, without a shuffle."""
    t = docs.select(F.col(key).alias("doc_id"), F.array_sort(tokenise(F.coalesce(F.col(text), F.lit("")))).alias("t"))
    # in order, equal terms lie side by side: where a run ends, and the one before it, give its length
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == F.size("t")) | (F.get("t", i - 1) != F.get("t", i)))
    t = t.where(F.size("t") > 0).withColumn("ends", ends)
    runs = F.transform("ends", lambda e, k: F.struct(F.get("t", e - 1).alias("term"), (e - F.when(k > 0, F.get("ends", k - 1)).otherwise(0)).cast("long").alias("tf")))
    return t.select("doc_id", F.size("t").alias("dl"), F.inline(runs))


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", ranges: bool = False) -> DataFrame:
    """(doc_id, term, dl, tf): the inverted index; rows of one id and length count together.  With ``ranges`` it lies in even ranges of (term, doc_id), by one shuffle in all."""
    rows = _counted(docs, text, key)
    rows = rows.repartitionByRange("term", "doc_id") if ranges else rows
    return rows.groupBy("doc_id", "term", "dl").agg(F.sum("tf").alias("tf"))


def content(docs: DataFrame, text: str = "text", key: str = "doc_id") -> str:
    """What tells the contents of two tables of documents apart, whatever their order; reads all texts."""
    n, x, total = docs.agg(F.count("*"), F.expr(f"bit_xor(xxhash64({key}, {text}))"), F.sum(F.pmod(F.xxhash64(text, key), F.lit(1 << 40)))).first()
    return f"{n:x}-{(x or 0) & (2**64 - 1):016x}-{total or 0:x}"


def files(table: DataFrame) -> str:
    """What tells two states of a table of files apart: names, sizes and times of its files, without reading its columns.

    Only for a table as it is read: a filter on it does not show.
    """
    one = table.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    n, x = one.agg(F.count("*"), F.bit_xor(F.xxhash64("p", "s", "t"))).first()
    return f"files-{n:x}-{(x or 0) & (2**64 - 1):016x}"


@dataclass(frozen=True)
class SparseIndex:
    """A stored inverted index: ``postings`` (doc_id, term, tf, dl), ``terms`` (term, df, idf, most_tf, least_dl), and numbers of the corpus."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    avgdl: float
    built: bool


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    fs, p = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _complete(spark: SparkSession, at: str) -> str | None:
    """The first build below ``at`` that was written to its end."""
    done = [n for n in _names(spark, at) if "_SUCCESS" in _names(spark, f"{at}/{n}/numbers")]
    return f"{at}/{done[0]}" if done else None


def sparse_index(docs: DataFrame, place: str, floor: float = 0.25, text: str = "text", version: str | None = None) -> SparseIndex:
    """The index of ``docs`` stored under ``place``, written first if none of the same content is there.

    ``version`` names the content (``files`` for a table that is read as it is); without it all texts are
    hashed.  Negative weights become ``floor`` times the mean weight of all terms.  Every build has a folder of
    its own and its numbers, written last, mark its end: builds that run at once do not
    meet, and one that was not written to its end counts as absent.  ``drop_indexes`` removes old ones.
    """
    spark = docs.sparkSession
    home = f"{place}/bm25-{version or content(docs, text)}-{floor:g}"
    at = _complete(spark, home)
    built = at is None
    if built:
        at = f"{home}/{uuid.uuid4().hex}"
        postings(spread(docs.select("doc_id", text)), text, ranges=True).sortWithinPartitions("term", "doc_id").write.parquet(f"{at}/postings")
        index, n_docs = spark.read.parquet(f"{at}/postings"), docs.count()
        raw = index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"))
        raw = raw.withColumn("raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        raw.write.parquet(f"{at}/raw")
        raw = spark.read.parquet(f"{at}/raw")
        mean, total = raw.agg(F.avg("raw"), F.sum("n")).first()
        idf = F.when(F.col("raw") < 0, floor * (mean or 0.0)).otherwise(F.col("raw"))
        raw.select("term", "df", idf.alias("idf"), "most_tf", "least_dl").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        numbers = (n_docs, float(total or 0) / max(n_docs, 1))
        spark.createDataFrame([numbers], "n_docs long, avgdl double").coalesce(1).write.parquet(f"{at}/numbers")  # last: marks the end
    n_docs, avgdl = spark.read.parquet(f"{at}/numbers").first()
    return SparseIndex(spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/terms"), n_docs, avgdl, built)


def drop_indexes(spark: SparkSession, place: str, keep: str | None = None) -> int:
    """Removes the stored indexes under ``place`` but those of the version ``keep``; how many there were.  No search may be using them."""
    gone = [n for n in _names(spark, place) if n.startswith("bm25-") and not (keep and n.startswith(f"bm25-{keep}-"))]
    for n in gone:
        fs, p = _folder(spark, f"{place}/{n}")
        fs.delete(p, True)
    return len(gone)


def _gain(tf: Column, dl: Column, avgdl: float, b: float) -> Column:
    """What a posting adds to a score, from the columns ``times``, ``idf`` and ``k1``."""
    return F.col("times") * F.col("idf") * tf * (F.col("k1") + 1) / (tf + F.col("k1") * (1 - b + b * dl / F.lit(avgdl)))


def _weights(queries: DataFrame, index: SparseIndex, k1: float | Column, b: float) -> tuple[DataFrame, bool, int]:
    """(query_id, k1, term, times, idf, df, bound) of the queries' known terms; whether they may be broadcast; how many postings they have.

    ``bound``: no posting of the term adds more.
    """
    k1 = F.lit(k1) if isinstance(k1, float) else k1
    terms = queries.select("query_id", k1.alias("k1"), F.explode(tokenise(F.col("text"))).alias("term")).groupBy("query_id", "k1", "term").agg(F.count("*").alias("times"))
    few = terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    asked = terms.select("term").distinct()
    known = index.terms.join(F.broadcast(asked) if few else asked, "term", "left_semi")
    weights = terms.join(known, "term").withColumn("bound", F.greatest(F.lit(0.0), _gain(F.col("most_tf"), F.col("least_dl"), index.avgdl, b))).drop("most_tf", "least_dl")
    return weights, few, weights.agg(F.sum("df")).first()[0] or 0


def _added(index: SparseIndex, weights: DataFrame, few: bool, b: float) -> DataFrame:
    """(query_id, doc_id, part): what the postings of some terms add to each pair."""
    met = index.postings.join(F.broadcast(weights) if few else weights, "term")
    return met.groupBy("query_id", "doc_id").agg(F.sum(_gain(F.col("tf"), F.col("dl"), index.avgdl, b)).alias("part"))


def bm25_scores(queries: DataFrame, index: SparseIndex, k1: float | Column = 1.6, b: float = 0.75, places: int = PLACES) -> DataFrame:
    """(query_id, doc_id, score) of all pairs that share a term; each occurrence in the query counts.

    Query terms meet the stored postings in an equi-join on the term and are broadcast while they
    are few, so that only their postings leave the scan.  ``k1`` may be a column of ``queries``.
    """
    weights, few, _ = _weights(queries, index, k1, b)
    return _added(index, weights, few, b).select("query_id", "doc_id", F.round("part", places).alias("score"))


@dataclass(frozen=True)
class Bounded:
    """An exact search by bounds: ``scores`` (query_id, doc_id, score), the ``needed`` terms whose postings were all added up,
    and the ``candidates`` for which the ``other`` terms were looked up."""

    scores: DataFrame
    needed: DataFrame
    other: DataFrame
    candidates: DataFrame


def bounded_search(index: SparseIndex, weights: DataFrame, few: bool, n: int, b: float = 0.75, places: int = PLACES) -> Bounded:
    """Scores of all pairs that may be among the first ``n`` of a query, ties at the end included.

    Sums over a query's rarest terms give a first threshold that its n-th score cannot be below.  Terms
    whose bounds together stay below it cannot lift a document alone: only the others' postings are
    added up.  Their sums raise the threshold; documents that reach it even with all other terms'
    bounds are candidates, and only for these the other terms' postings count.  Terms of
    negative weight are always added up, so partial sums never fall when more is added.
    """
    slack = 2 * 10.0**-places
    by = lambda *order: Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("df").over(by("df", "term")) / F.sum("df").over(Window.partitionBy("query_id"))
    lined = weights.withColumn("first", (share <= FIRST_SHARE) | (F.col("idf") < 0)).withColumn("upto", F.sum("bound").over(by("bound", "term")))

    def nth(sums: DataFrame) -> DataFrame:
        return ranked(sums, n, F.desc("part")).where(F.col("rank") == n).select("query_id", F.col("part").alias("least"))

    near = F.broadcast if few else (lambda df: df)
    first = nth(_added(index, lined.where("first").select(weights.columns), few, b))
    lined = lined.join(near(first), "query_id", "left").withColumn("needed", F.col("first") | F.col("least").isNull() | (F.col("upto") >= F.col("least") - slack))
    needed, other = (lined.where(c).select(weights.columns) for c in ("needed", "not needed"))
    sums = _added(index, needed, few, b)
    rest = other.groupBy("query_id").agg(F.sum("bound").alias("rest"))
    bar = nth(sums).join(rest, "query_id", "left").select("query_id", (F.col("least") - F.coalesce("rest", F.lit(0.0)) - slack).alias("bar"))
    candidates = sums.join(near(bar), "query_id", "left").where("bar is null or part >= bar").drop("bar")
    looked = index.postings.join(near(other), "term").join(candidates.select("query_id", "doc_id"), ["query_id", "doc_id"])
    more = looked.select("query_id", "doc_id", _gain(F.col("tf"), F.col("dl"), index.avgdl, b).alias("part"))
    scores = candidates.unionByName(more).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), places).alias("score"))
    return Bounded(scores, needed, other, candidates)


def bm25_topk(queries: DataFrame, docs: DataFrame, index: SparseIndex, n: int = 10, k1: float | Column = 1.6, b: float = 0.75, bounded_postings: int = BOUNDED_POSTINGS) -> DataFrame:
    """Top ``n`` of every query, rows with score 0 included, in the order of ids.

    From ``bounded_postings`` on the search goes by bounds; its results are the same.  Rows without a
    common term only matter where a query has fewer than ``n`` others; then they come from
    the ``n`` smallest ids, as at most ``n`` are needed.
    """
    weights, few, asked = _weights(queries, index, k1, b)
    if asked >= bounded_postings:
        scores = bounded_search(index, weights, few, n, b).scores
    else:
        scores = _added(index, weights, few, b).select("query_id", "doc_id", F.round("part", PLACES).alias("score"))
    top = ranked(scores, n, F.desc("score"), F.col("doc_id"))
    # whatever its scores, a query needs zeros only if its list is short; at most n * n rows of it meet then
    some = docs.select("doc_id").orderBy("doc_id").limit(n)
    have = queries.select("query_id").distinct().join(top.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left")
    short = have.where(F.coalesce("have", F.lit(0)) < n).select("query_id")
    zeros = short.crossJoin(F.broadcast(some)).join(top.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    every = top.select("query_id", "doc_id", "score").unionByName(zeros.withColumn("score", F.lit(0.0)))
    return ranked(every, n, F.desc("score"), F.col("doc_id"))


def postings_read(queries: DataFrame, index: SparseIndex, n: int = 10, k1: float = 1.6, b: float = 0.75) -> tuple[int, int, int]:
    """Postings (query and term) of a batch: all; those of needed terms; those looked up for candidates."""
    weights, few, asked = _weights(queries, index, k1, b)
    found = bounded_search(index, weights, few, n, b)
    needed = found.needed.agg(F.sum("df")).first()[0] or 0
    looked = index.postings.join(found.other, "term").join(found.candidates, ["query_id", "doc_id"], "left_semi").count()
    return asked, needed, looked
