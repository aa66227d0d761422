"""Registered queries of the operators: each applies one, with production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    clusters,
    fim,
    langid,
    licenses,
    linededup,
    lm,
    mixing,
    neardup,
    packing,
    pii,
    quality,
    sequences,
    topk,
)
from .oracle import ORACLE_SQL
from .text import crc, table


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file on this machine; it is the same on all."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.word_lengths(table(spark, folder, "documents")))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = pii.annotate(docs, pii.fit(docs)).select("doc_id", "base", "spans")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *(count(kind) for kind in pii.BASE_KINDS),
        F.sha2(pii.join_spans("base").cast("binary"), 256).alias("base_sha256"),
        pii.join_spans("spans").alias("spans"),
    )


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    vocabulary = tokenizer_file(langid.VOCABULARY)
    held_out = F.pmod(crc(), F.lit(3)) == 1
    model = langid.fit(docs.where(~held_out & F.col("lang").isNotNull()), vocabulary)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    return langid.predict(rows, model, vocabulary).select("doc_id", "held_out", "lang_pred", "score")


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    found = topk.top_k(rows.where(F.pmod("vec_id", F.lit(50)) == 0), rows)
    return found.select("query_id", "rank", F.col("row_id").alias("vec_id"), "score")


def op5_sequences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    parts = sequences.write_sequences(docs, tokenizer_file("byte_bpe_50k.json"))
    return sequences.read_documents(spark, parts)


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def op7_language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rows = lm.score(docs, F.pmod(crc(), F.lit(10)) != 0)
    return rows.withColumn("train", ~F.col("train")).withColumnRenamed("train", "held_out")


def op8_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    base, newest = quality.POLICIES[0], quality.POLICIES[-1]
    rows = quality.ledger(table(spark, folder, "documents"))
    rows = quality.apply_policy(quality.apply_policy(rows, base, name="base_kept"), newest)
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"),
        "kept",
        F.col("failed").alias("failed_rules"),
    )


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = linededup.drop_lines(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fim.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_pii,
        op3_language,
        op4_topk,
        op5_sequences,
        op6_near_duplicates,
        op7_language_model,
        op8_licenses,
        op9_mixing,
        op10_quality,
        op11_line_dedup,
        op12_fill_in_middle,
        op13_clusters,
    )
}


def queries():
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLE_SQL
