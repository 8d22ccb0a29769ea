"""Sinks: JSON documents, transcripts, checksummed writes, job folders, stage files."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_escape, markdown_html, safe_filename


def layout_json(pages: DataFrame, engine: str, weight: str, device: str) -> DataFrame:
    """Pages (page, width, height, boxes) to one JSON document each: page, json."""
    dets = F.transform("boxes", lambda b: F.struct(b["label"].alias("label"), b["score"].alias("score"), F.array(*(b[k].cast("int") for k in ("xmin", "ymin", "xmax", "ymax"))).alias("bbox"), b["index"].alias("index")))
    return pages.select("page", F.to_json(F.struct(F.lit(engine).alias("engine"), F.lit(weight).alias("weight"), F.lit(device).alias("device"), F.array("width", "height").alias("page_size"), dets.alias("dets"))).alias("json"))


def transcript_json(slices: DataFrame, model: str, device: str) -> DataFrame:
    """Slices (clip, idx, start, end, text, confidence, duration) to one transcript each: clip, json. A slice without
    times stands for the whole clip; a confidence that is missing is left out."""
    segment = F.struct(
        F.coalesce("start", F.lit(0.0)).alias("start"), F.coalesce("end", "duration").alias("end"), F.col("text").alias("text"),
        F.when(F.col("confidence").isNotNull(), F.struct(F.col("confidence").alias("value"), F.lit("token_probability").alias("source"), F.lit(False).alias("calibrated"))).alias("confidence"),
    )
    own = slices.groupBy("clip").agg(F.array_sort(F.collect_list(F.struct("idx", segment.alias("s")))).alias("s"), F.max("duration").alias("duration"))
    text = F.array_join(F.transform("s", lambda x: x["s"]["text"]), "")
    return own.select("clip", F.to_json(F.struct(F.lit(2).alias("schema_version"), text.alias("text"), F.lit("zh").alias("language"), F.col("duration").alias("duration_sec"), F.lit(model).alias("model"), F.lit(device).alias("device"), F.transform("s", lambda x: x["s"]).alias("segments"))).alias("json"))


SLICES = "array<struct<start:double,end:double,offset:long,n_samples:long>>"


def slices_to_json(c: Column) -> Column:
    return F.to_json(c)


def slices_from_json(c: Column) -> Column:
    """Tolerant: what cannot be read is an empty list."""
    return F.coalesce(F.from_json(c, SLICES), F.array().cast(SLICES))


def write_texts(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder for each input with its text, written by Spark's committer (all or nothing)."""
    df.select(safe_filename(F.col(name)).alias("name"), F.col(text).alias("value")).write.partitionBy("name").text(path)


def write_checksummed(df: DataFrame, path: str, deepest: int | None = None) -> str:
    """JSON lines and, beside them, the digest of their set, whose tree has `deepest` levels at most; both are read back.
    Returns the digest."""
    spark = df.sparkSession
    df.write.mode("errorifexists").json(f"{path}/data")
    digest = digest_of(spark, f"{path}/data", deepest=deepest)
    spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{path}/sha256")
    kept = spark.read.text(f"{path}/sha256").first()[0]
    if digest_of(spark, f"{path}/data", deepest=deepest) != kept:
        raise ValueError(f"{path}: what was written does not read back")
    return kept


#: Digits of a line's digest that name its leaf: up to 16^DEPTH leaves, each of some LEAF lines.
DEPTH, LEAF = 6, 256


def digest_of(spark: SparkSession, path: str, depth: int | None = None, deepest: int | None = None) -> str:
    """A digest of a set of lines in any order and partitioning, whose lines nobody can change unseen: a tree over their
    SHA-256. A leaf digests the sorted digests that begin with the same `depth` digits, a node its children in order, each
    with its digit. Leaves are small groups and nodes have 16 children, so nothing is gathered.
    The depth follows from the number of lines, up to `deepest` (DEPTH) levels; beyond these leaves grow."""
    lines = spark.read.text(path).select(F.sha2(F.col("value").cast("binary"), 256).alias("h"))
    if depth is None:
        n, depth = lines.count(), 0
        while n > LEAF * 16**depth and depth < (DEPTH if deepest is None else deepest):
            depth += 1
    sha = lambda parts: F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "").cast("binary"), 256)
    level = lines.groupBy(F.left("h", F.lit(depth)).alias("at")).agg(sha(F.col("h")).alias("h"))
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.left("at", F.lit(k)).alias("at")).agg(sha(F.concat(F.right("at", F.lit(1)), "h")).alias("h"))
    row = level.first()
    return row["h"] if row else hashlib.sha256(b"").hexdigest()


def job_names(jobs: DataFrame) -> DataFrame:
    """Jobs (id, source, ts) with their folder: stamp and safe stem, _2, _3, ... on a collision."""
    from pyspark.sql import Window

    stem = safe_filename(F.regexp_replace(F.regexp_extract("source", r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    base = F.concat(F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit("_"), stem)
    n = F.row_number().over(Window.partitionBy(base).orderBy("id"))
    return jobs.withColumn("folder", F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))


def preview_html(c: Column, title: Column) -> Column:
    return F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), html_escape(title), F.lit("</title></head><body>"), markdown_html(c), F.lit("</body></html>"))


def write_markdown(blocks: DataFrame, path: str) -> None:
    """Markdown of the page's own blocks first, then the content list, which has the discarded ones too; a marker last."""
    spark = blocks.sparkSession
    own = blocks.where(~F.col("discarded")).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("value"))
    own.write.partitionBy("page").text(f"{path}/markdown")
    blocks.write.json(f"{path}/content_list")
    spark.createDataFrame([("done",)], "value string").coalesce(1).write.text(f"{path}/complete")


STAGES = ("01_layout", "02_orient", "03_extract", "04_post", "05_middle")


def write_stage(df: DataFrame, folder: str, stage: str) -> DataFrame:
    """A stage's rows written and read back, so that a job can go on from there."""
    if stage not in STAGES:
        raise ValueError(stage)
    df.write.mode("overwrite").parquet(f"{folder}/{stage}")
    return df.sparkSession.read.parquet(f"{folder}/{stage}")
