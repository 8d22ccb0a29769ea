"""A stream that is pushed: a producer appends windows of a timeline to a spool, a streaming query takes them.

The spool is a published dataset (`sources.published`) whose rows have `at`, their place on the timeline in ms. `push`
appends rows that lie after all rows before, and refuses them with Backpressure while that would leave more than
LIMIT ms that the slowest consumer has not taken: the producer waits and tries again. What all consumers have taken goes
from the manifest with the next push, so it does not grow.

The source's offset is a place on the timeline. A batch takes at most `limit` ms, however much lies there: `latestOffset`
admits as much beyond what has been worked on. A batch is planned before it runs and has run when the next one is asked for,
so the reader notes the end of each planned batch in the spool; a query that starts again from its checkpoint goes on
there, and one with a new checkpoint at the beginning.

Trigger by processing time (the default one); `availableNow` asks for the newest offset once, so it takes one batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..sources import published
from ..sources.stores import exists, opened, read_small, replace

FORMAT = "pushed"
#: Milliseconds of timeline that may lie unprocessed (a fixed value of the stream's contract).
LIMIT = 120_000


class Backpressure(RuntimeError):
    """The consumers have too much before them; push again later."""


@dataclass
class Slice(InputPartition):
    file: published.FilePart
    low: int
    high: int


def note(path: str, consumer: str) -> dict:
    """What is known of a consumer: `planned`, the end of its last batch, and `taken`, up to where it has worked."""
    store, at = opened(path)
    name = f"{at}/consumers/{consumer}.json"
    return json.loads(read_small(store, name)) if exists(store, name) else {"planned": 0, "taken": 0}


def noted(path: str, consumer: str, **what: int) -> None:
    store, at = opened(path)
    store.create_dir(f"{at}/consumers", recursive=True)
    replace(store, f"{at}/consumers/{consumer}.json", json.dumps(note(path, consumer) | what).encode(), "next")


def taken_by_all(path: str) -> int:
    """Up to where every consumer has worked; 0 without any."""
    store, at = opened(path)
    names = [i.base_name[:-5] for i in store.get_file_info(fs.FileSelector(f"{at}/consumers", allow_not_found=True)) if i.base_name.endswith(".json")]
    return min((note(path, n)["taken"] for n in names), default=0)


def end_of(held: dict | None) -> int:
    return max((f["high"] + 1 for f in held["files"] if f["rows"]), default=0) if held else 0


def push(rows: DataFrame, path: str, limit: int = LIMIT) -> int:
    """Appends rows with `at` to the spool, and returns where the timeline ends then."""
    held = published.manifest(path)
    begin, taken = end_of(held), taken_by_all(path)
    ends = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count_if(F.col("at").isNull()).alias("nowhere")).first()
    if ends["nowhere"]:
        raise ValueError(f"{ends['nowhere']} rows have no place on the timeline")
    if ends["low"] is None:
        return begin
    if ends["low"] < begin:
        raise ValueError(f"rows at {ends['low']} ms, but the timeline goes to {begin} ms already")
    if ends["high"] + 1 - taken > limit:
        raise Backpressure(f"{begin - taken} ms are not processed yet")
    if held and (open_files := [f for f in held["files"] if f["rows"] and f["high"] >= taken]) and len(open_files) < len(held["files"]):
        published.put(path, held["schema"], held["input"], open_files)
    published.publish(rows, path, range="at")
    return ends["high"] + 1


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.consumer = options["path"], options.get("consumer", "default")
        self.limit = int(options.get("limit", LIMIT))

    def initialOffset(self) -> dict:
        noted(self.path, self.consumer, planned=0, taken=0)  # a new query
        return {"ms": 0}

    def latestOffset(self) -> dict:
        """The batch planned last has run when this is asked."""
        done = note(self.path, self.consumer)["planned"]
        noted(self.path, self.consumer, taken=done)
        end = end_of(published.manifest(self.path))
        return {"ms": max(done, min(end, done + self.limit))}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        noted(self.path, self.consumer, planned=end["ms"])
        held = published.manifest(self.path)
        files = held["files"] if held else []
        return [Slice(published.FilePart(f["file"], f["bytes"], f["sha256"]), start["ms"], end["ms"]) for f in files if f["rows"] and f["low"] < end["ms"] and f["high"] >= start["ms"]]

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        for batch in published.rows_of(self.path, partition.file):
            at = batch.column("at")
            yield batch.filter(pc.and_(pc.greater_equal(at, partition.low), pc.less(at, partition.high)))

    def commit(self, end: dict) -> None:
        pass


class Pushed(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(published.found(self.options["path"])["schema"])

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def read_pushed(spark: SparkSession, path: str, schema: StructType | str | None = None, consumer: str = "default", limit: int = LIMIT) -> DataFrame:
    """The spool as a stream; `schema` is needed only before anything was pushed."""
    spark.dataSource.register(Pushed)
    source = spark.readStream.format(FORMAT).option("consumer", consumer).option("limit", limit)
    return (source.schema(schema) if schema else source).load(path)
