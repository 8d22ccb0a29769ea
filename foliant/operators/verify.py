"""Checks of file sets: expected against actual, safe paths, unique keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_safe_path(c: Column) -> Column:
    """Relative, not empty, not '.', without '..' and without a drive."""
    parts = F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce((c != "") & (c != ".") & ~c.rlike(r"^([A-Za-z]:|[/\\])") & ~F.array_contains(parts, ".."), F.lit(False))


def reconcile(expected: DataFrame, actual: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """key, state: ok, missing, unexpected or mismatched. One shuffle of both sides on the key."""
    e, a = expected.select(key, F.col(value).alias("want")).withColumn("in_e", F.lit(True)), actual.select(key, F.col(value).alias("have")).withColumn("in_a", F.lit(True))
    both = e.join(a, key, "full_outer")
    state = F.when(F.col("in_a").isNull(), "missing").when(F.col("in_e").isNull(), "unexpected").when(F.col("want").eqNullSafe(F.col("have")), "ok").otherwise("mismatched")
    return both.select(key, state.alias("state"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: pre-aggregated, no sort of a whole key."""
    rest = [c for c in df.columns if c not in (key, order)]
    best = df.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("r"))
    return best.select(key, F.col(f"r.{order}").alias(order), *[F.col(f"r.{c}").alias(c) for c in rest])


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def valid_threshold(c: Column) -> Column:
    """An acceptance threshold within [0.98, 1]; anything else raises."""
    return F.when(c.between(0.98, 1.0), c).otherwise(F.raise_error(F.concat(F.lit("threshold outside [0.98, 1]: "), c.cast("string"))).cast("double"))


def stem_join(audio: DataFrame, references: DataFrame) -> DataFrame:
    """Audio rows (path) with the reference of the same stem (path, text); those without one are left out of a metric."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    refs = references.select(stem.alias("stem"), F.col("text").alias("reference"))
    return audio.withColumn("stem", stem).join(refs, "stem", "left").where(F.col("reference").isNotNull())
