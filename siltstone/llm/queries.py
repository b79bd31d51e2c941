"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, digest, lexical, mixing, negatives, piece_bpe, quality, simhash, tiff, toxicity, unigram, urls
from .common import WORD, table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return ann.neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded; digests of ids and of the decoded text."""
    model = piece_bpe.read_model()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = piece_bpe.detokenize(piece_bpe.tokenize(docs, model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram tokens of every text, with the pieces and scores of the public 32k model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.count_tokens(docs, piece_bpe.read_model())


def _split(modulus: int, held: int):
    """Whether a row is held out, by the CRC-32 of its id's decimal text."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))


def _judged(scored: DataFrame, held) -> DataFrame:
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; labels of every fifth id hash are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) != 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), train)
    return _judged(quality.score(docs, model), _split(5, 0))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    mixed = mixing.mix(docs, size="size")
    return mixed.select("doc_id", "size", F.col("copies_source_size").alias("source_size"), F.col("copies_target").alias("target"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what reading it back gives."""
    own = spark.sql("SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat.format_turns(chat.turns(rows)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))
    listed = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; labels of every fourth id hash are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(4)) != 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train)
    return _judged(toxicity.score(docs, model), _split(4, 2))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = tiff.pages(tiff.store(docs))
    size = F.length("pixels")
    tail = F.substring("pixels", -32, 32)
    feature = F.format_string("%dx%d samples=%d bits=%d compression=%d predictor=%d mean=%.6f deviation=%.6f", "width", "height", "samples", "bits", "compression", "predictor", "mean", "deviation")
    return read.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op11_improbable_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form; likeness to that and to the next document."""
    made = digest.with_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five positives of every fiftieth vector; some labels are moved first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0)


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_url_rules": op8_url_rules,
    "op9_simhash_dedup": op9_simhash_dedup,
    "op10_tiff": op10_tiff,
    "op11_improbable_digest": op11_improbable_digest,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_lexical": op13_lexical,
}

ORACLE_SQL: dict[str, str] = {
    "op6_chat": chat.ORACLE_SQL,
    "op8_url_rules": urls.ORACLE_SQL,
    "op12_hard_negatives": negatives.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
