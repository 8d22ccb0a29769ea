"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, divergence, filter_audit, html_text, langid, licenses, mixing, neardup, quality, sharding, warc
from .common import table, words_native


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A public tokenizer's file; FOLIANT_TOKENIZERS names another folder."""
    folder = os.environ.get("FOLIANT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.round_trip(table(spark, sf_dir, "pages")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select("doc_id", "text"), forest).select("doc_id", "quality.*")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    path = tokenizer_path()
    rows = bpe.decode_docs(bpe.encode_docs(docs.select("doc_id", "text"), path), path)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rows = mixing.mixed(docs)
    return rows.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        words_native(F.col("text")).alias("tokens"), F.round("mix_chance", 6).alias("chance"), F.col("mix_kept").alias("kept"),
    )


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    rows = chat.read_back(chat.windows(own.unionByName(extra)))
    return rows.select(
        "conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    rows = langid.identify(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", langid.held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license.*")


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_quality_rules, op3_sharding, op4_minhash_near_dedup, op5_bpe, op6_source_mixing, op7_multi_index, op8_chat_windows, op9_main_text, op10_language_id,
        op11_filter_audit, op12_source_divergence, op13_license_scan,
    )
}
_EXTRA = " UNION ALL ".join(f"SELECT -1, {k}, '{role}', '</s>[INST] ok [/INST]'" for k, role in enumerate(("user", "assistant")))
SQL = {
    "op1_warc": warc.oracle(), "op4_minhash_near_dedup": neardup.oracle(), "op9_main_text": html_text.oracle(), "op6_source_mixing": mixing.oracle(), "op8_chat_windows": chat.oracle(_EXTRA),
    "op11_filter_audit": filter_audit.oracle(), "op12_source_divergence": divergence.oracle(), "op13_license_scan": licenses.oracle(),
}
