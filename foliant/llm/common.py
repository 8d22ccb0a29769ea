"""What the operators of this package share: table access, the shared folder, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word definition in this package: space, tab, LF, VT, FF, CR.
WS = r"\x20\x09-\x0D"
WORD = rf"[^{WS}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none (tests on one machine) a local one is made and set; on a
    cluster that is an error, since executors would not see it.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        known = spark.sparkContext.getCheckpointDir()
        if not known and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        conf = known or tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


#: Bytes of one Arrow batch of texts: a batch of very long texts has fewer of them.
BATCH_BYTES = 1 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds the bytes of the session's Arrow batches, before whole texts go to Python workers.

    Spark reads the bound when it plans a query, so it stays set; no result depends on it."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", conf.get(key, "67108864b").lower())
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))


def unused(df: DataFrame, name: str) -> str:
    """`name`, or the first of name_, name__ ... that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: short lineage that
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to one result; they go when the result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, self.folder)

    def done(self, result: DataFrame, name: str) -> DataFrame:
        out = stored(result, name)
        removed(self.spark, self.folder)
        return out


def words_native(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def runs(lengths: np.ndarray) -> np.ndarray:
    """Offsets of consecutive runs of these lengths, the end included."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
