"""Sources: images, audio, manifests, checksums, layouts, tensors, worker events, configuration.

Paths are read by Spark's own readers only, so any store that the session can read will do.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.verify import is_safe_path, is_sha256

IMAGES = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
AUDIO = ("wav", "mp3", "m4a", "flac", "aac", "opus")


def extension_in(path: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1)).isin(*names)


def is_image_path(path: Column) -> Column:
    return extension_in(path, IMAGES)


def is_audio_path(path: Column) -> Column:
    return extension_in(path, AUDIO)


def expand_inputs(spark: SparkSession, paths: list[str], keep=is_image_path) -> DataFrame:
    """Files below the paths: path, length, idx. Each once, in the order of the paths, then by name."""
    parts = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length").where(keep(F.col("path"))).withColumn("given", F.lit(i))
        for i, p in enumerate(paths)
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    from pyspark.sql import Window

    first = found.groupBy("path").agg(F.min("given").alias("given"), F.first("length").alias("length"))
    return first.withColumn("idx", F.row_number().over(Window.orderBy("given", "path"))).select("idx", "path", "length")


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the images below a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_image_path(F.col("path"))).select("path", "length", "content")


def page_scale(width: Column, height: Column, dpi: int = 200, most: int = 3500) -> Column:
    """A page's size in points at `dpi` and the factor that keeps its long edge within `most` pixels."""
    long_edge = F.greatest(width, height)
    return F.struct((width * 72.0 / dpi).alias("width_pt"), (height * 72.0 / dpi).alias("height_pt"), F.least(F.lit(1.0), most / long_edge).alias("scale"))


def read_audio(spark: SparkSession, path: str) -> DataFrame:
    """Audio files of one folder (not below it)."""
    return spark.read.format("binaryFile").load(path).where(is_audio_path(F.col("path"))).select("path", "length", "content")


def sniff_audio(content: Column) -> Column:
    """wav by its first bytes, else compressed."""
    head = F.hex(F.substring(content, 1, 4)), F.hex(F.substring(content, 9, 4))
    return F.when((head[0] == "52494646") & (head[1] == "57415645"), "wav").otherwise("compressed")


def wav_samples(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples [frames, channels] as float32 of a RIFF file: PCM of 8 to 32 bits, or 32-bit float."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            fmt = kind, channels, rate, bits
        elif name == b"data":
            if fmt is None:
                raise ValueError("samples before their format")
            kind, channels, rate, bits = fmt
            width = bits // 8
            body = body[: len(body) // (width * channels) * width * channels]
            if kind == 3 and bits == 32:
                x = np.frombuffer(body, "<f4").astype(np.float32)
            elif kind == 1 and bits == 8:
                x = (np.frombuffer(body, np.uint8).astype(np.float32) - 128) / 128
            elif kind == 1 and bits == 16:
                x = np.frombuffer(body, "<i2").astype(np.float32) / 32768
            elif kind == 1 and bits == 24:
                b = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
                v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
                x = ((v ^ 0x800000) - 0x800000).astype(np.float32) / (1 << 23)
            elif kind == 1 and bits == 32:
                x = (np.frombuffer(body, "<i4") / float(1 << 31)).astype(np.float32)
            else:
                raise ValueError(f"format {kind} of {bits} bits")
            return rate, x.reshape(-1, channels)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def decode_wav(files: DataFrame) -> DataFrame:
    """(path, content) to path, rate, channels, samples (mono, the mean of the channels), error."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                try:
                    rate, x = wav_samples(bytes(content))
                    rows.append((path, rate, x.shape[1], x.mean(axis=1).astype(float).tolist(), None))
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "rate", "channels", "samples", "error"]).astype({"rate": "Int64", "channels": "Int64"})

    return files.select("path", "content").mapInPandas(decode, "path string, rate long, channels long, samples array<double>, error string")


MANIFEST = (
    "schema string, dataset_id string, task_type string, threshold double, normalization struct<remove_whitespace:boolean,ignore_punctuation:boolean,case_sensitive:boolean>,"
    "samples array<struct<id:string,input:string,reference_path:string,reference_text:string,input_sha256:string,reference_sha256:string>>"
)
#: Acceptance manifests of version 1, whatever product wrote them.
MANIFEST_SCHEMA = r"^\w+-Acceptance/1$"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """An acceptance manifest as rows of samples. What is wrong with it raises."""
    return manifest_samples(spark.read.schema(MANIFEST).option("multiLine", "true").json(path))


def manifest_samples(raw: DataFrame) -> DataFrame:
    def required(ok: Column, value: Column, why: str) -> Column:
        return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.lit(why)).cast("string"))

    own = raw.select(
        required(F.col("schema").rlike(MANIFEST_SCHEMA), F.col("schema"), "unknown manifest schema").alias("schema"),
        required(F.trim("dataset_id") != "", F.trim("dataset_id"), "dataset_id is missing").alias("dataset_id"),
        required(F.col("task_type").isin("scan", "voice"), F.col("task_type"), "task_type is neither scan nor voice").alias("task_type"),
        F.when(F.coalesce("threshold", F.lit(0.98)).between(0.98, 1.0), F.coalesce("threshold", F.lit(0.98))).otherwise(F.raise_error(F.lit("threshold outside [0.98, 1]")).cast("double")).alias("threshold"),
        F.coalesce("normalization.remove_whitespace", F.lit(False)).alias("remove_whitespace"),
        F.coalesce("normalization.ignore_punctuation", F.lit(False)).alias("ignore_punctuation"),
        F.coalesce("normalization.case_sensitive", F.lit(True)).alias("case_sensitive"),
        F.when(F.size("samples") > 0, F.col("samples")).otherwise(F.raise_error(F.lit("no samples")).cast(raw.schema["samples"].dataType)).alias("samples"),
    )
    rows = own.select("*", F.posexplode("samples").alias("pos", "s")).drop("samples")
    blank = F.trim(F.coalesce("s.id", F.lit(""))) == ""
    reference = F.coalesce("s.reference_text", "s.reference_path")

    def hash_of(c: str) -> Column:
        v = F.lower(F.col(c))
        return F.when(F.col(c).isNull(), F.lit(None).cast("string")).otherwise(required(is_sha256(v), v, "malformed sha256"))

    return rows.select(
        "schema", "dataset_id", "task_type", "threshold", "remove_whitespace", "ignore_punctuation", "case_sensitive",
        F.when(blank, F.concat(F.lit("sample-"), F.lpad((F.col("pos") + 1).cast("string"), 4, "0"))).otherwise(F.trim("s.id")).alias("id"), F.col("s.input").alias("input"),
        F.when(F.col("s.reference_text").isNull(), F.col("s.reference_path")).alias("reference_path"), F.col("s.reference_text").alias("reference_text"),
        required(F.trim(reference) != "", F.lit("ok"), "reference is missing").alias("reference_state"), hash_of("s.input_sha256").alias("input_sha256"), hash_of("s.reference_sha256").alias("reference_sha256"),
    )


CHECKSUM_LINE = r"^([0-9a-fA-F]{64})[\t ]+(.+?)\r?$"


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    return checksum_rows(spark.read.text(path))


def checksum_rows(lines: DataFrame) -> DataFrame:
    """Lines (value) to sha256, path. Malformed lines, unsafe and repeated paths, or none at all raise where they are read."""
    own = lines.where(F.trim("value") != "")
    sha, path = F.lower(F.regexp_extract("value", CHECKSUM_LINE, 1)), F.regexp_replace(F.regexp_extract("value", CHECKSUM_LINE, 2), r"\\", "/")
    path = F.regexp_replace(path, r"^\*", "")
    own = own.select(sha.alias("sha256"), path.alias("path"))
    checked = F.when(~is_sha256(F.col("sha256")), F.raise_error(F.lit("malformed checksum line")).cast("string")).when(~is_safe_path(F.col("path")), F.raise_error(F.concat(F.lit("unsafe path: "), F.col("path"))).cast("string")).otherwise(F.col("sha256"))
    one = own.select(checked.alias("sha256"), "path").groupBy("path").agg(F.count("*").alias("n"), F.min("sha256").alias("sha256"))
    return one.select("path", F.when(F.col("n") == 1, F.col("sha256")).otherwise(F.raise_error(F.concat(F.lit("path is listed twice: "), F.col("path"))).cast("string")).alias("sha256"))


CONTENT_ITEM = "type string, text string, content string, code_body string, table_body string, " + ", ".join(
    f"{k} array<string>" for k in ("list_items", "table_caption", "table_footnote", "image_caption", "image_footnote", "chart_caption", "chart_footnote", "code_caption")
)


def read_content_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTENT_ITEM).option("multiLine", "true").json(path)


LAYOUT = "engine string, weight string, device string, page_size array<int>, dets array<struct<cls_id:int,label:string,score:double,bbox:array<int>,index:int>>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).option("multiLine", "true").json(path)


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Worker events, one JSON object in a line."""
    return spark.read.schema(schema).json(path)


# The configuration's keys and what holds without them.
CONFIG = {"output_dir": "", "language": "auto", "device": "cuda", "image_analysis": False, "formula": True, "table": True, "threshold": 0.98}


def load_config(text: str | None) -> dict:
    """Known keys of the right kind only; defaults where anything is wrong."""
    try:
        raw = json.loads(text or "")
    except ValueError:
        return dict(CONFIG)
    if not isinstance(raw, dict):
        return dict(CONFIG)
    same = lambda v, d: isinstance(v, bool) == isinstance(d, bool) and isinstance(v, (int, float) if isinstance(d, float) else type(d))
    return {k: raw[k] if k in raw and same(raw[k], d) else d for k, d in CONFIG.items()}
