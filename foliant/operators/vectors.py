"""Embedding rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_between(vectors: DataFrame, first: int, count: int, key: str = "vec_id") -> DataFrame:
    """Rows first .. first + count - 1: a range filter that reaches the scan."""
    return vectors.where((F.col(key) >= first) & (F.col(key) < first + count))


def lookup(ids: DataFrame, vectors: DataFrame, id_col: str = "id", key: str = "vec_id") -> DataFrame:
    """The vector of each id; an id without one raises."""
    out = ids.join(vectors.select(F.col(key).alias(id_col), "embedding"), id_col, "left")
    return out.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.concat(F.lit("no row "), F.col(id_col).cast("string"))).cast(vectors.schema["embedding"].dataType)).otherwise(F.col("embedding")))
