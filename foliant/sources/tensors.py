"""Files of named tensors as a data source: ranges are planned from headers, and only their bytes are read.

A file is a length (8 bytes), a JSON header of that length (name to dtype, shape and range of bytes) and the
tensors' bytes; it may be cut anywhere into parts `<file>.part1`, `.part2`, ... that are read as one.

Reading plans byte ranges: headers alone are read on the driver, and everything in them is checked before any
task starts. A filter on `row`, `tensor` or `file` is taken by the source, so a range of rows is as many bytes as it
has. A partition is at most `partitionBytes` long and sends batches of at most `chunkBytes`, so memory does not
grow with a tensor.

    rows     file, tensor, row, values      rows of the matrices
    chunks   file, tensor, begin, values    runs of values of tensors of any rank, `begin` the first one's place

`as` says what values become: `float` takes BF16, F16 and F32, `long` the whole numbers; other tensors are
refused if they are asked for by name, and left out if they are not. `shape` (`500,64`) is refused if it is not the tensor's.

Writing makes one file of parts: each task writes the raw bytes of its rows, a file for each column, in the order of
the partitions. The commit names them parts in order, and the header last: without it nothing can be read. Columns are
array<float> (`dtype` BF16, F16 or F32), all of one length, and long (I64, a matrix of one column).
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import LongType, StructType

from .stores import exists, opened

FORMAT = "tensors"
WIDTHS = {"F64": 8, "F32": 4, "F16": 2, "BF16": 2, "I64": 8, "U64": 8, "I32": 4, "U32": 4, "I16": 2, "U16": 2, "I8": 1, "U8": 1, "BOOL": 1}
TAKEN = {"float": {"BF16", "F16", "F32"}, "long": {"I64", "I32", "U32", "I16", "U16", "I8", "U8", "BOOL"}}
LONGEST_HEADER = 64 << 20
PARTITION_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    begin: int  # from the start of the file
    end: int


@dataclass(frozen=True)
class Parts:
    """A file in one or several pieces."""

    name: str
    paths: tuple[str, ...]
    sizes: tuple[int, ...]

    def read(self, store: fs.FileSystem, offset: int, length: int) -> bytes:
        out, at = [], 0
        for path, size in zip(self.paths, self.sizes):
            low, high = max(offset, at), min(offset + length, at + size)
            if low < high:
                with store.open_input_file(path) as f:
                    out.append(f.read_at(high - low, low - at))
            at += size
        got = b"".join(out)
        if len(got) != length:
            raise ValueError(f"{self.name}: {len(got)} bytes where {length} should be")
        return got


@dataclass
class Run(InputPartition):
    """Values of one tensor from `first` on, `count` of them (rows or values, `width` bytes each)."""

    file: Parts
    tensor: Tensor
    first: int
    count: int
    width: int

    @property
    def offset(self) -> int:
        return self.tensor.begin + self.first * self.width

    @property
    def length(self) -> int:
        return self.count * self.width


def header(store: fs.FileSystem, file: Parts) -> list[Tensor]:
    """The tensors of a file, all of the header checked."""
    total = sum(file.sizes)
    if total < 8:
        raise ValueError(f"{file.name}: too short")
    size = struct.unpack("<Q", file.read(store, 0, 8))[0]
    if not 0 < size <= min(LONGEST_HEADER, total - 8):
        raise ValueError(f"{file.name}: a header of {size} bytes")
    head = json.loads(file.read(store, 8, size))
    if not isinstance(head, dict):
        raise ValueError(f"{file.name}: the header is no object")
    out = []
    for name, t in head.items():
        if name == "__metadata__":
            continue
        begin, end = (8 + size + int(x) for x in t["data_offsets"])
        shape = tuple(int(n) for n in t["shape"])
        if t["dtype"] not in WIDTHS or min(shape, default=0) < 0 or not 8 + size <= begin <= end <= total or end - begin != WIDTHS[t["dtype"]] * math.prod(shape):
            raise ValueError(f"{file.name}: dtype, shape and range of {name} do not agree")
        out.append(Tensor(name, t["dtype"], shape, begin, end))
    return out


def files_of(store: fs.FileSystem, at: str) -> list[Parts]:
    """Files below a folder, or the one named; parts are put together, and must be complete."""
    if exists(store, at):
        infos = [store.get_file_info(at)]
    else:
        alone = store.get_file_info(f"{at}.part1").type == fs.FileType.File
        top = at.rsplit("/", 1)[0] if alone else at
        infos = [i for i in store.get_file_info(fs.FileSelector(top, recursive=not alone)) if i.type == fs.FileType.File and i.base_name[0] not in "._" and not i.base_name.endswith(".json")]
        if alone:
            infos = [i for i in infos if re.fullmatch(re.escape(at) + r"\.part\d+", i.path)]
    whole: dict[str, dict[int, fs.FileInfo]] = {}
    for i in infos:
        m = re.fullmatch(r"(.*)\.part(\d+)", i.path)
        whole.setdefault(m[1] if m else i.path, {})[int(m[2]) if m else 1] = i
    for name, parts in whole.items():
        if sorted(parts) != list(range(1, len(parts) + 1)):
            raise ValueError(f"{name}: a part is missing")
    return [Parts(name, tuple(p[k].path for k in sorted(p)), tuple(p[k].size for k in sorted(p))) for name, p in sorted(whole.items())]


def values_of(raw: bytes, dtype: str) -> np.ndarray:
    if dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    if dtype in TAKEN["float"]:
        return np.frombuffer(raw, "<f2" if dtype == "F16" else "<f4").astype(np.float32)
    return np.frombuffer(raw, "?" if dtype == "BOOL" else f"<{dtype[0].lower()}{WIDTHS[dtype]}").astype(np.int64)


def bytes_of(values: np.ndarray, dtype: str) -> bytes:
    """BF16 rounds to the nearest, ties to even."""
    if dtype == "BF16":
        bits = values.astype("<f4").view(np.uint32).astype(np.uint64)
        near = ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16).astype("<u2")
        return np.where(np.isnan(values), np.uint16(0x7FC0), near).astype("<u2").tobytes()
    return values.astype({"F16": "<f2", "F32": "<f4", "I64": "<i8"}[dtype]).tobytes()


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mode, self.kind = options["path"], options.get("mode", "rows"), options.get("as", "float")
        self.at_most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.chunk = int(options.get("chunkbytes", CHUNK_BYTES))
        self.shape = tuple(map(int, options["shape"].split(","))) if "shape" in options else None
        if self.mode not in ("rows", "chunks") or self.kind not in TAKEN or self.chunk < 8 or self.at_most < 8:
            raise ValueError(f"mode, as or sizes are not known: {options}")
        self.place = "row" if self.mode == "rows" else "begin"
        self.only: dict[str, set] = {"tensor": {options["tensor"]}} if "tensor" in options else {}
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self.taken(f):
                yield f

    def taken(self, f: Filter) -> bool:
        name = f.attribute[0] if len(f.attribute) == 1 else ""
        if name in ("tensor", "file") and isinstance(f, (EqualTo, In)):
            values = set(f.value if isinstance(f, In) else [f.value])
            self.only[name] = self.only.get(name, values) & values
            return True
        if name != "row" or self.mode != "rows":
            return False  # a chunk is known by where it begins, which depends on how it is planned
        bounds = {EqualTo: lambda v: (v, v + 1), GreaterThan: lambda v: (v + 1, self.high), GreaterThanOrEqual: lambda v: (v, self.high), LessThan: lambda v: (0, v), LessThanOrEqual: lambda v: (0, v + 1)}
        if type(f) not in bounds:
            return False
        low, high = bounds[type(f)](f.value)
        self.low, self.high = max(self.low, low), min(self.high, high)
        return True

    def partitions(self) -> list[Run]:
        store, at = opened(self.path)
        files = [f for f in files_of(store, at) if "file" not in self.only or f.name in self.only["file"]]
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(lambda f: header(store, f), files))
        out, seen = [], set()
        for file, tensors in zip(files, heads):
            for t in tensors:
                named = "tensor" in self.only
                if named and t.name not in self.only["tensor"]:
                    continue
                seen.add(t.name)
                fits = t.dtype in TAKEN[self.kind] and (self.mode == "chunks" or len(t.shape) == 2)
                if named and not fits:
                    raise ValueError(f"{t.name} of {t.dtype} and shape {t.shape} is not read as {self.mode} of {self.kind}")
                if named and self.shape not in (None, t.shape):
                    raise ValueError(f"{t.name} has shape {t.shape}, not {self.shape}")
                if fits:
                    out += self.runs(file, t)
        if missing := self.only.get("tensor", set()) - seen:
            if "file" not in self.only:
                raise ValueError(f"there is no tensor {sorted(missing)}")
        return out

    def runs(self, file: Parts, t: Tensor) -> list[Run]:
        width = WIDTHS[t.dtype] * (math.prod(t.shape[1:]) if self.mode == "rows" else 1)
        total = t.shape[0] if self.mode == "rows" else math.prod(t.shape)
        low, high = max(self.low, 0), min(self.high, total)
        step = max(1, self.at_most // max(width, 1))
        return [Run(file, t, first, min(step, high - first), width) for first in range(low, high, step)]

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was planned
            return
        store, _ = opened(self.path)
        p, kind = partition, pa.float32() if self.kind == "float" else pa.int64()
        each = p.width // WIDTHS[p.tensor.dtype]
        step = max(1, self.chunk // max(p.width, 1))
        for first in range(p.first, p.first + p.count, step):
            n = min(step, p.first + p.count - first)
            values = values_of(p.file.read(store, p.tensor.begin + first * p.width, n * p.width), p.tensor.dtype)
            ends = np.arange(n + 1) * each if self.mode == "rows" else np.array([0, n])
            places = np.arange(first, first + n) if self.mode == "rows" else np.array([first])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
            same = [pa.array([x] * len(places), pa.string()) for x in (p.file.name, p.tensor.name)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(places, pa.int64()), lists], names=["file", "tensor", self.place, "values"])


@dataclass
class Rows(WriterCommitMessage):
    partition: int
    rows: int
    columns: dict[str, tuple[str, int, int]]  # file, values in a row, bytes


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite
        dtype = options.get("dtype", "F32")
        if dtype not in TAKEN["float"]:
            raise ValueError(f"vectors are not written as {dtype}")
        self.dtypes = {f.name: "I64" if isinstance(f.dataType, LongType) else dtype for f in schema}
        for f in schema:
            if f.dataType.simpleString() not in ("bigint", "array<float>"):
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} is no tensor")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Rows:
        from pyspark import TaskContext

        store, at = opened(self.path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        names = {c: f"{at}.{self.job}-{uuid.uuid4().hex}" for c in self.dtypes}
        out, widths, rows = {c: store.open_output_stream(n) for c, n in names.items()}, {}, 0
        try:
            for batch in iterator:
                rows += batch.num_rows
                for c, dtype in self.dtypes.items():
                    column = batch.column(c)
                    vectors = not pa.types.is_integer(column.type)
                    flat = column.flatten() if vectors else column
                    sizes = set(np.diff(column.offsets.to_numpy()).tolist()) if vectors else {1}
                    widths.setdefault(c, next(iter(sizes), 0))
                    if column.null_count or flat.null_count or (batch.num_rows and sizes != {widths[c]}):
                        raise ValueError(f"{c}: null, or vectors of several lengths")
                    out[c].write(bytes_of(flat.to_numpy(zero_copy_only=False), dtype))
            for f in out.values():
                f.close()
        except BaseException:
            for c, f in out.items():
                f.close()
                store.delete_file(names[c])
            raise
        return Rows(TaskContext.get().partitionId(), rows, {c: (n, widths.get(c, 0), store.get_file_info(n).size) for c, n in names.items()})

    def commit(self, messages: list[Rows | None]) -> None:
        store, at = opened(self.path)
        told = sorted((m for m in messages if m), key=lambda m: m.partition)
        full = [m for m in told if m.rows]
        head, place, parts = {}, 0, []
        for c, dtype in self.dtypes.items():
            widths = {m.columns[c][1] for m in full}
            if len(widths) > 1:
                raise ValueError(f"{c}: vectors of several lengths")
            size = sum(m.columns[c][2] for m in full)
            head[c] = {"dtype": dtype, "shape": [sum(m.rows for m in full), *(widths or {1})], "data_offsets": [place, place + size]}
            place += size
            parts += [m.columns[c][0] for m in full]
        for m in told:
            if not m.rows:
                for name, _, _ in m.columns.values():
                    store.delete_file(name)
        self.remove(rf"\.part\d+|")
        for k, name in enumerate(parts, 2):
            store.move(name, f"{at}.part{k}")
        body = json.dumps(head).encode()
        with store.open_output_stream(f"{at}.{self.job}-head") as f:
            f.write(struct.pack("<Q", len(body)) + body)
        store.move(f"{at}.{self.job}-head", f"{at}.part1")

    def abort(self, messages: list[Rows | None]) -> None:
        self.remove(rf"\.{self.job}-.*")

    def remove(self, ending: str) -> None:
        store, at = opened(self.path)
        for i in store.get_file_info(fs.FileSelector(at.rsplit("/", 1)[0], allow_not_found=True)):
            if i.type == fs.FileType.File and re.fullmatch(re.escape(at) + f"({ending})", i.path):
                if not self.overwrite and self.job not in i.path:
                    raise FileExistsError(i.path)
                store.delete_file(i.path)


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        place = "row" if self.options.get("mode", "rows") == "rows" else "begin"
        return f"file string, tensor string, {place} long, values array<{'float' if self.options.get('as', 'float') == 'float' else 'bigint'}>"

    def reader(self, schema: StructType) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer({k.lower(): v for k, v in self.options.items()}, schema, overwrite)


def read_tensors(spark: SparkSession, path: str, tensor: str | None = None, **options) -> DataFrame:
    """Rows (`mode="rows"`) or runs of values (`mode="chunks"`) of the tensors at `path`."""
    spark.dataSource.register(Tensors)
    spark.conf.set(PUSHDOWN, "true")
    named = {"tensor": tensor} if tensor else {}
    return spark.read.format(FORMAT).options(**named, **{k.rstrip("_"): str(v) for k, v in options.items()}).load(path)


def write_tensors(df: DataFrame, path: str, dtype: str = "F32", mode: str = "append") -> None:
    """The columns of `df` as tensors of one file at `path`, rows in the order of the partitions."""
    df.sparkSession.dataSource.register(Tensors)
    df.write.format(FORMAT).mode(mode).option("dtype", dtype).save(path)
