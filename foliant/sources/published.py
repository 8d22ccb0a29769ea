"""Datasets that are published as a whole: written by many tasks, seen by readers at once or not at all.

    <path>/data/<uuid>.arrow          rows of one task, as a stream of Arrow batches
    <path>/manifest-<sha256>.json     schema, files with rows, bytes and digests, the digest of the input; its name is its digest
    <path>/CURRENT                    the name of the manifest that holds

A task writes a file that no manifest names, and sends its digest to the commit. The commit writes the
manifest and then moves CURRENT, the one step that readers see. A task that is lost leaves a file that
nobody reads (`vacuum` deletes such files); when a job fails, the commit's counterpart deletes what its
tasks wrote and CURRENT stays as it was. Readers check the manifest by its name, and every file by its
size and digest while they read it: a changed or missing byte fails the task.

Stages of a job are datasets of this kind. Each names the digest of its input, so a job that is run again goes on
at the first stage that is missing or whose input has changed (`run_stages`).

Scale: the driver sees one line for each file. Files are read one for each task.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import Hashed, batches_of, exists, opened, read_small, replace

FORMAT = "published"


@dataclass
class Written(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    bytes: int
    sha256: str
    low: int | None = None
    high: int | None = None


@dataclass
class FilePart(InputPartition):
    file: str
    bytes: int
    sha256: str


def tree_of(digests: list[str]) -> str:
    """Root of a binary tree over digests in this order."""
    level = digests or [hashlib.sha256(b"").hexdigest()]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[k : k + 2]).encode()).hexdigest() for k in range(0, len(level), 2)]
    return level[0]


def manifest(path: str) -> dict | None:
    """What holds at `path`, checked; None if nothing was published."""
    store, at = opened(path)
    if not exists(store, f"{at}/CURRENT"):
        return None
    name = read_small(store, f"{at}/CURRENT").decode()
    content = read_small(store, f"{at}/{name}")
    if name != f"manifest-{hashlib.sha256(content).hexdigest()}.json":
        raise ValueError(f"{path}: the manifest has been changed")
    found = json.loads(content)
    if found["digest"] != tree_of([f["sha256"] for f in found["files"]]):
        raise ValueError(f"{path}: the digest does not fit the files")
    return found


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.input, self.range = options["path"], options.get("input", ""), options.get("range")
        self.schema, self.overwrite, self.job = schema.jsonValue(), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = opened(self.path)
        store.create_dir(f"{at}/data", recursive=True)
        name = f"data/{self.job}-{uuid.uuid4().hex}.arrow"
        out, rows, writer, ends = Hashed(store.open_output_stream(f"{at}/{name}")), 0, None, []
        try:
            for batch in iterator:
                writer = writer or pa.ipc.new_stream(pa.PythonFile(out, mode="w"), batch.schema)
                writer.write_batch(batch)
                rows += batch.num_rows
                if self.range and batch.num_rows:
                    ends += pc.min_max(batch.column(self.range)).as_py().values()
            if writer:
                writer.close()
            out.close()
        except BaseException:
            out.close()
            store.delete_file(f"{at}/{name}")
            raise
        return Written(TaskContext.get().partitionId(), name, rows, out.size, out.sha.hexdigest(), min(ends, default=None), max(ends, default=None))

    def commit(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        files = [{k: v for k, v in vars(m).items() if k != "partition" and v is not None} for m in sorted(filter(None, messages), key=lambda m: m.partition)]
        before = manifest(self.path)
        if before and not self.overwrite:
            if before["schema"] != self.schema:
                raise ValueError(f"{self.path}: another schema than what was published before")
            files = before["files"] + files
        put(self.path, self.schema, self.input, files)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = opened(self.path)
        for info in store.get_file_info(fs.FileSelector(f"{at}/data", allow_not_found=True)):
            if info.base_name.startswith(self.job):  # also of tasks whose message never came
                store.delete_file(info.path)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["file"], f["bytes"], f["sha256"]) for f in found(self.path)["files"] if f["rows"]]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:  # else nothing was planned
            yield from rows_of(self.path, partition)


def rows_of(path: str, f: FilePart) -> Iterator[pa.RecordBatch]:
    """A file's batches; its digest is checked at its end."""
    store, at = opened(path)
    raw = Hashed(store.open_input_stream(f"{at}/{f.file}"))
    try:
        yield from batches_of(raw)
        while raw.read(1 << 20):
            pass
    finally:
        raw.close()
    if (raw.size, raw.sha.hexdigest()) != (f.bytes, f.sha256):
        raise ValueError(f"{path}: {f.file} has been changed")


def put(path: str, schema: dict, input: str, files: list[dict]) -> None:
    """Makes these files what holds at `path`."""
    store, at = opened(path)
    content = json.dumps({"schema": schema, "input": input, "rows": sum(f["rows"] for f in files), "digest": tree_of([f["sha256"] for f in files]), "files": files}).encode()
    name, mark = f"manifest-{hashlib.sha256(content).hexdigest()}.json", uuid.uuid4().hex
    replace(store, f"{at}/{name}", content, mark)
    replace(store, f"{at}/CURRENT", name.encode(), mark)


def found(path: str) -> dict:
    out = manifest(path)
    if out is None:
        raise FileNotFoundError(f"{path}: nothing is published here")
    return out


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return StructType.fromJson(found(self.options["path"])["schema"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), schema, overwrite)


def publish(df: DataFrame, path: str, mode: str = "append", input: str = "", range: str | None = None) -> dict:
    """Publishes the rows of `df` and returns the manifest; with `range` it has each file's smallest and largest value of that column."""
    df.sparkSession.dataSource.register(Published)
    df.write.format(FORMAT).mode(mode).options(input=input, **({"range": range} if range else {})).save(path)
    return found(path)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(Published)
    return spark.read.format(FORMAT).load(path)


def vacuum(path: str) -> int:
    """Deletes data files and manifests that do not hold; not while a job writes there. Returns their number."""
    store, at = opened(path)
    now = found(path)
    kept = {f["file"].rsplit("/", 1)[1] for f in now["files"]} | {read_small(store, f"{at}/CURRENT").decode(), "CURRENT"}
    gone = [i.path for i in store.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and i.base_name not in kept]
    for f in gone:
        store.delete_file(f)
    return len(gone)


def run_stages(spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], first: DataFrame, input: str = "") -> tuple[DataFrame, list[str]]:
    """The last stage's rows, and the names of the stages that ran. `input` names the state of `first`: a stage whose input
    differs from what it was made of runs again, and so do those after it."""
    rows, ran = first, []
    for name, stage in stages:
        path = f"{folder}/{name}"
        held = manifest(path)
        if held is None or held["input"] != input:
            held = publish(stage(rows), path, "overwrite", input)
            ran.append(name)
        rows, input = read_published(spark, path), held["digest"]
    return rows, ran
