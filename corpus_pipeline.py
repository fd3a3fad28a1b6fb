"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, line_dedup, piece_codec, simhash, toxicity
from tessella.llm.common import Scratch, fold, read

#: SQL cannot train the first stage's classifier or run the last stage's tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None

#: A repeated line of so many words goes even where its neighbours differ.
PASSAGE_WORDS = 50


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with names for all columns but doc_id and text that no operator uses, and what gives them back their names; columns
    given to it by name take the place of those of the input."""
    inner = [c if c in ("doc_id", "text") else f"__column{i}" for i, c in enumerate(docs.columns)]

    def back(df: DataFrame, **new) -> DataFrame:
        return df.select(*[new.get(name, F.col(c)).alias(name) for name, c in zip(docs.columns, inner, strict=True)])

    return docs.toDF(*inner), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Labels that op10 holds out are not learned from.

    Null, empty and very long texts, repeated rows and null doc_ids are scored like any others; ties are none, for each row is
    judged by itself. Without labels nothing goes. Columns of any names stay as they are; an empty table stays empty.
    """
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic").where(fold("doc_id", 5) != 0)
    rows, back = _apart(docs)
    scored = toxicity.score(rows, toxicity.train(rows, labels), out="toxic_score", spans="toxic_spans")
    return back(scored.where("toxic_score < 0.5"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines and of repeated one-line passages go; every document stays, with the lines it keeps.

    n_chars, if there is such a column, gets the new length where lines went. The first copy is that of the smallest doc_id
    (nulls first); rows alike in doc_id and text count as one and are treated alike. Null and empty texts stay as they
    are, very long ones are split whole, columns of any names stay, and an empty table stays empty.
    """
    rows, back = _apart(docs)
    done = line_dedup.dedup(rows, passage_words=PASSAGE_WORDS)
    changed = F.col("n_removed") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, length).otherwise(F.col(rows.columns[docs.columns.index("n_chars")]))
    return back(done, **new)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: that of the smallest doc_id (nulls first), then text's hash.

    Documents are told apart by doc_id and text, so unlike texts of one doc_id are documents of their own. Of rows alike in
    both, that with the smallest hash of all its columns stays. Null and empty texts and texts without words have one fingerprint
    and are one group. Very long texts are read whole, columns of any names stay, and an empty table stays empty.
    """
    rows, back = _apart(docs)
    # The hash may be null to the planner, as it may be in tables that are read: keys of two types would be shuffled twice.
    h = F.when(F.col("text").isNull() | F.col("text").isNotNull(), F.xxhash64("text"))
    rows = rows.withColumn("__row", F.struct(F.col("doc_id"), h.alias("h")))
    found = simhash.near_duplicates(rows.select("__row", "text"), key="__row")
    keep = found.where(F.col("__row") == F.col("component")).select("__row").distinct()
    whole = F.struct(*[F.col(c) for c in rows.columns if c != "__row"])
    kept = rows.join(keep, "__row", "left_semi").groupBy("__row").agg(F.min_by(whole, F.xxhash64(whole)).alias("__kept"))
    return back(kept.select("__kept.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark windows over a twentieth of their words or more go; others stay as they are.

    Each row is judged by itself, so repeated rows and null doc_ids are like any others. Null and empty texts have no words and
    stay; very long texts are searched whole; columns of any names stay, and an empty table stays empty.
    """
    rows, back = _apart(docs)
    found = decontaminate.verdict(decontaminate.find(rows, read(spark, sf_dir, "benchmark")))
    return back(found.where("not contaminated"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the piece ids of each whole text, and what they decode to.

    Null texts count as empty and have the begin and end ids; repeated rows and null doc_ids are like any others, other
    columns are not returned, and an empty table gives an empty result.
    """
    done = piece_codec.roundtrip(docs.select("doc_id", "text"))
    return done.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's last table. Tables between the stages stand in the shared folder, each until the next is written."""
    scratch, docs, before = Scratch(spark), read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.keep(docs, name)
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
