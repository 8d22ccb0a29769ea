"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, mixing, neardup, quality, queries
from foliant.llm.common import removed, shared_dir, table, unused


def _own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that fit no learned language; the rest is unchanged."""
    model = langid.fit(docs, ~langid.held_out() & F.col("doc_id").isNotNull())
    out = unused(docs, "language")
    return _own(langid.identify(docs, model, out=out).where(~F.col(out)["rejected"]), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rule or that the trees reject."""
    forest = quality.train(docs, table(spark, sf_dir, "labels"))
    out = unused(docs, "quality")
    return _own(quality.judge(docs, forest, out=out).where(F.col(out)["kept"]), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates."""
    return _own(neardup.keep_first(docs), docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that sources, languages and topics come near their target shares."""
    return mixing.sample(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return queries.bpe_digests(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: SQL expresses neither the trained models nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again; a table goes when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            removed(spark, before)
        before = f"{folder}/{name}"
    return docs
