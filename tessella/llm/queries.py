"""The registered queries of the training-data operators. Each applies its operator to the whole table and derives digests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import conversations, decontaminate, fill_middle, line_dedup, media, minhash, pii, piece_codec, quality, simhash, substring_dedup, toxicity, warc
from tessella.llm.common import Scratch, fold, read

#: The query's key is public, so that its result can be checked; a caller of the operator brings a secret one.
PII_KEY = "public test key"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of each row, as digests. Null texts count as empty; repeated rows give a row each; no rows give none."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    done = piece_codec.roundtrip(docs)
    return done.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and words removed of each row. Null and empty texts have none; repeated rows repeat each other; no rows give none."""
    done = substring_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each row's stored file, read back. Null and empty texts are one block of zeros; repeated rows give a row each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    stored = media.pack(docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).select("doc_id", "n_bytes", "media")
    found = media.unpack(Scratch(spark).keep(stored, "media"))
    feature = F.concat_ws(";", "codec", "handler", "timescale", "duration", "n_samples", F.size("key_ranges").alias("n"), F.sha2(F.to_json("key_ranges"), 256))
    ok = found.withColumn("codec", F.when(F.col("error").isNull(), F.col("codec")).otherwise(F.raise_error(F.col("error"))))
    return ok.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each row. Null and empty texts get the bias alone; a null doc_id has held_out null and is not learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 3) != 1)
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's text with pseudonyms, and how many. Null texts stay null; equal values have equal pseudonyms in every row."""
    done = pii.pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return done.select("doc_id", "n_private", F.col("private_text").alias("text"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each page, read back from the archive. Null payloads count as empty; of equal payloads the largest page_id is the response."""
    archive = warc.write(read(spark, sf_dir, "pages"))
    return warc.digests(spark, archive).withColumnRenamed("record_key", "page_id")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each row. Null and empty texts have no words and are not contaminated; no items give no hits."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.verdict(decontaminate.find(docs, read(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row. Null and empty texts have fingerprint zero and are linked like any others."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, lines removed and longest repeated run of each row. Null texts have none; rows alike in doc_id and text count as one."""
    done = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", "longest_run", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each row. Null and empty texts score 0; a null doc_id has held_out null and is not learned from."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle-set size and component of each row. Texts that are null or without words link with nothing; a null doc_id is kept if no row of its component has one."""
    found = minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of each damaged conversation. Null roles and texts are one space; one of which damage leaves no turn has zeros."""
    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversations.report(conversations.damage(table)).withColumnRenamed("conv_id", "c")
    every = table.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's fill-in-the-middle example, and the text rebuilt from it. Null texts count as empty and stay plain; repeated rows give a row each."""
    made = fill_middle.restore(fill_middle.transform(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{name}_sha256") for c, name in (("output", "output"), ("restored", "restored"))]
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_substring_dedup, op3_media, op4_quality, op5_pii, op6_warc, op7_decontaminate, op8_simhash, op9_line_dedup, op10_toxicity, op11_minhash, op12_conversations, op13_fill_middle)}
