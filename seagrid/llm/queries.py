"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.llm import bpe_tree, centroids, embedding_dedup, filter_audit, language_mix, lm_score, packing, quality_net, rule_ledger, secret_scan
from seagrid.llm import url_filter
from seagrid.llm.minhash import near_duplicates
from seagrid.llm.store import table
from seagrid.llm.substring_dedup import without_repeats

QUERIES = {}
ORACLES = {
    "op9_rule_ledger": rule_ledger.ORACLE,
    "op12_centroids": centroids.oracle(),
    "op13_filter_audit": filter_audit.ORACLE,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = quality_net.fold(F.col("doc_id"), 5) == 0
    net = quality_net.fit(docs.where(~held_out), labels)
    return quality_net.scored(docs, net).select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= quality_net.LEAST).cast("int").alias("predicted"),
    )


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return lm_score.scored(docs, lm_score.fit(docs, target))


@query
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.9)


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


@query
def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@query
def op7_language_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language_mix.fold(F.col("doc_id"), 4) == 2
    model = language_mix.fit(docs.where(~held_out))
    return language_mix.predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = without_repeats(docs, length=20, with_text=False)
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"),
        F.col("_kept").alias("kept_sha256"),
    )


@query
def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ledger.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rule_ledger.rejected("base").alias("base_failed"), (~rule_ledger.rejected("v1")).alias("kept"), "failures",
    )


@query
def op10_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_tree.digests(table(spark, sf_dir, "documents"))


@query
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model, hosts = url_filter.fit(pages)
    return url_filter.judged(pages, model, hosts=hosts)


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
