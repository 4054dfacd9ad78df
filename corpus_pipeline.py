"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of `docs`, whatever they are called; the last returns
the packed pieces. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm import packing, quality_net, secret_scan
from seagrid.llm.minhash import near_duplicates
from seagrid.llm.store import plainly_named, table, written
from seagrid.llm.substring_dedup import without_repeats

#: Words in a row that may stand in one document only.
PASSAGE = 50


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of good quality is at least 0.3; the network
    learns from labelled documents outside the held-out fold."""
    held_out = quality_net.fold(F.col("doc_id"), 5) == 0
    net = quality_net.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    rows = quality_net.scored(plainly_named(docs, "doc_id", "text"), net, quality_net.LEAST)
    return rows.drop("_score").toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near duplicates
    (runs of five words, similarity 0.8 or more). Rows without a doc_id stay."""
    found = near_duplicates(docs, width=5, percent=80)
    gone = found.where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    rows = plainly_named(docs, "doc_id", "text")
    rows = rows.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    return rows.toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE words or more that start earlier elsewhere are cut.
    Texts without any stay as they are; what is left of others is joined by
    single spaces, and a document of which nothing is left goes."""
    rows = plainly_named(docs, "doc_id", "text", "n_chars")
    found = without_repeats(rows, length=PASSAGE)
    columns = {"text": F.col("_kept"), "n_chars": F.when(F.col("_removed") > 0, F.length("_kept")).otherwise(F.col("n_chars")).cast("long")}
    return found.where("_removed = 0 or _removed < _words").select(*(columns.get(c, F.col(c)).alias(c) for c in rows.columns)).toDF(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    new = secret_scan.without_secrets(plainly_named(docs, "doc_id", "text", "n_chars"))
    masked = F.col("text").contains(secret_scan.MARK)
    n_chars = F.when(masked, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return new.withColumn("n_chars", n_chars).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2,048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secrets", secrets),
    ("packing", pack),
]

#: No SQL expresses a trained network or a public tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
