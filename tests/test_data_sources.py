"""The package's own data sources: tensors by ranges of bytes, and datasets published as a whole."""

import json
import os
import random
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.sources import published as P
from foliant.sources import stores
from foliant.sources import tensors as X


def tensor_file(arrays):
    """A file of named (dtype, array) as bytes; arrays hold their raw values."""
    head, body = {"__metadata__": {"format": "x"}}, b""
    for name, (dtype, a) in arrays.items():
        raw = a.tobytes()
        head[name] = {"dtype": dtype, "shape": list(a.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + body


RNG = np.random.default_rng(8)
MATRIX = RNG.standard_normal((1000, 7)).astype("<f4")
HALF = RNG.standard_normal((30, 3)).astype("<f2")
BRAIN = (RNG.standard_normal((20, 4)).astype("<f4").view(np.uint32) >> 16).astype("<u2")
FILE = {"m": ("F32", MATRIX), "h": ("F16", HALF), "b": ("BF16", BRAIN), "ids": ("I64", np.arange(9, dtype="<i8").reshape(9, 1)), "v": ("F32", np.arange(5, dtype="<f4")), "none": ("F32", np.zeros((0, 4), "<f4"))}


@pytest.fixture()
def cut(tmp_path):
    """The file in parts that end anywhere, the header's bytes included."""
    data = tensor_file(FILE)
    rng = random.Random(3)
    ends = [0, 5, *sorted(rng.sample(range(6, len(data)), 9)), len(data)]
    (tmp_path / "in").mkdir()
    for k, (a, b) in enumerate(zip(ends, ends[1:]), 1):
        (tmp_path / "in" / f"x.bin.part{k}").write_bytes(data[a:b])
    return str(tmp_path / "in" / "x.bin"), len(data)


def rows(df):
    return {r["row"]: r["values"] for r in df.collect()}


def test_ranges_are_pushed_and_equal(spark, cut):
    path, _ = cut
    df = X.read_tensors(spark, path, "m", partitionBytes=28 * 64, chunkBytes=28 * 5)
    assert {k: np.float32(v).tolist() for k, v in rows(df).items()} == {k: v.tolist() for k, v in enumerate(MATRIX)}
    part = df.where("row >= 100 and row < 300 and values[0] > 0")
    assert sorted(rows(part)) == [k for k in range(100, 300) if MATRIX[k, 0] > 0]
    assert part.rdd.getNumPartitions() == 4  # 200 rows of 28 bytes
    assert rows(df.where("row = 7")) == {7: MATRIX[7].tolist()} and rows(df.where("row in (3, 900)")).keys() == {3, 900}
    assert df.where("row > 5 and row < 5").count() == 0 and df.where("row >= 999").count() == 1 and df.where("row < 0").count() == 0
    for name, want in (("h", HALF.astype(float)), ("b", (BRAIN.astype(np.uint32) << 16).view(np.float32))):
        assert list(rows(X.read_tensors(spark, path, name)).values()) == want.tolist()
    assert [r["values"] for r in X.read_tensors(spark, path, "ids", as_="long").collect()] == [[k] for k in range(9)]
    every = X.read_tensors(spark, path)  # matrices of floats; others are left out
    assert {r["tensor"]: r["n"] for r in every.groupBy("tensor").agg(F.count("*").alias("n")).collect()} == {"m": 1000, "h": 30, "b": 20}
    assert every.where("tensor = 'h'").count() == 30


class Counting:
    """The local store, with a note of every range that is read."""

    def __init__(self, store, log):
        self.store, self.log = store, log

    def __getattr__(self, name):
        return getattr(self.store, name)

    def open_input_file(self, path):
        f, log = self.store.open_input_file(path), self.log

        class File:
            def read_at(self, n, at):
                log.append((path, at, n))
                return f.read_at(n, at)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                f.close()

        return File()


def test_only_the_bytes_of_the_range_are_read(cut, monkeypatch):
    path, size = cut
    log = []
    real = stores.opened
    monkeypatch.setattr(X, "opened", lambda p: (Counting(real(p)[0], log), real(p)[1]))
    reader = X.Reader({"path": path, "tensor": "m", "partitionbytes": "1000", "chunkbytes": "300"})
    assert list(reader.pushFilters([X.GreaterThanOrEqual(("row",), 400), X.LessThan(("row",), 420), X.GreaterThan(("values",), 1)])) == [X.GreaterThan(("values",), 1)]
    plan = reader.partitions()
    planned = sum(n for _, _, n in log)
    assert planned < 700 and sum(r.length for r in plan) == 20 * 28  # headers only, until now
    log.clear()
    got = [v for r in plan for b in reader.read(r) for v in b.column("values").to_pylist()]
    assert np.array_equal(np.float32(got), MATRIX[400:420])
    assert sum(n for _, _, n in log) == 20 * 28 and max(n for _, _, n in log) <= 300


def test_chunks(spark, cut):
    path, _ = cut
    df = X.read_tensors(spark, path, "m", mode="chunks", chunkBytes=100, partitionBytes=3000, shape="1000,7")
    got = df.orderBy("begin").collect()
    assert max(len(r["values"]) for r in got) == 25
    assert np.array_equal(np.float32([v for r in got for v in r["values"]]), MATRIX.ravel())
    assert [r["values"] for r in X.read_tensors(spark, path, "v", mode="chunks").collect()] == [[0, 1, 2, 3, 4]]


@pytest.mark.parametrize("options", [{"tensor": "v"}, {"tensor": "ids"}, {"tensor": "m", "as_": "long"}, {"tensor": "gone"}, {"tensor": "m", "shape": "7,1000"}, {"tensor": "m", "mode": "other"}])
def test_refused_reads(spark, cut, options):
    with pytest.raises(PySparkException):
        X.read_tensors(spark, cut[0], **options).collect()


@pytest.mark.parametrize("spoil", ["short", "length", "range", "dtype", "shape", "part", "json"])
def test_headers_are_checked_before_any_read(tmp_path, spoil):
    data = tensor_file({"m": ("F32", MATRIX)})
    size = struct.unpack("<Q", data[:8])[0]
    head = json.loads(data[8 : 8 + size])
    change = {"range": {"data_offsets": [0, 10**9]}, "dtype": {"dtype": "F99"}, "shape": {"shape": [3, 3]}}.get(spoil)
    if change:
        head["m"] |= change
        text = json.dumps(head).encode()
        data = struct.pack("<Q", len(text)) + text + data[8 + size :]
    data = {"short": data[:4], "length": struct.pack("<Q", 1 << 40) + data[8:], "json": data[:8] + b"[" + data[9:]}.get(spoil, data)
    (tmp_path / ("x.part2" if spoil == "part" else "x")).write_bytes(data)
    with pytest.raises(ValueError):
        X.Reader({"path": str(tmp_path)}).partitions()


def test_written_tensors_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/out/e.bin"
    df = spark.range(500).select("id", F.array(*[(F.col("id") * k / 3).cast("float") for k in range(6)]).alias("vector")).repartitionByRange(5, "id").sortWithinPartitions("id")
    X.write_tensors(df, path)
    assert rows(X.read_tensors(spark, path, "vector").where("row < 2")) == {0: [0.0] * 6, 1: np.float32([k / 3 for k in range(6)]).tolist()}
    both = X.read_tensors(spark, path, "vector").withColumnRenamed("values", "vector").join(X.read_tensors(spark, path, "id", as_="long").select("row", "values"), "row")
    assert both.count() == 500 and both.where("values[0] <> row").count() == 0
    with pytest.raises(PySparkException):
        X.write_tensors(df, path)  # is there already
    X.write_tensors(df.limit(3), path, "BF16", "overwrite")
    assert X.read_tensors(spark, path, "vector").count() == 3
    X.write_tensors(df.where("false"), path, mode="overwrite")
    assert X.read_tensors(spark, path, "vector").count() == 0


def test_failed_tensor_write_leaves_nothing_to_read(spark, tmp_path):
    ragged = spark.range(40).repartition(4).select(F.array_repeat(F.lit(1.0).cast("float"), F.when(F.col("id") == 33, 2).otherwise(3)).alias("v"))
    with pytest.raises(PySparkException):
        X.write_tensors(ragged, str(tmp_path / "x"))
    assert os.listdir(tmp_path) == []


def test_bf16_rounds_to_even():
    x = np.float32([1.0, 1.00390625, 1.01171875, -2.5, np.inf, 3.0e-39, 0])
    back = X.values_of(X.bytes_of(x, "BF16"), "BF16")
    assert back.tolist()[:5] == [1.0, 1.0, 1.015625, -2.5, np.inf]
    assert np.isnan(X.values_of(X.bytes_of(np.float32([np.nan]), "BF16"), "BF16")).all()


def test_published_and_read(spark, tmp_path):
    path = f"{tmp_path}/p"
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("x"), "id")).alias("t"), F.array("id").alias("a")).repartition(4)
    first = P.publish(df, path)
    assert first["rows"] == 1000 and len(first["files"]) == 4
    assert P.read_published(spark, path).schema == df.schema and P.read_published(spark, path).exceptAll(df).count() == 0
    assert P.publish(df, path)["rows"] == 2000 and P.read_published(spark, path).count() == 2000
    assert P.publish(df.limit(5), path, "overwrite")["rows"] == 5 and P.read_published(spark, path).count() == 5
    assert P.vacuum(path) == 8 + 2 and P.read_published(spark, path).count() == 5
    with pytest.raises(PySparkException):
        P.publish(df.select("id"), path)  # another schema
    assert P.read_published(spark, path).count() == 5
    assert P.publish(df.where("false"), path, "overwrite")["rows"] == 0 and P.read_published(spark, path).count() == 0
    with pytest.raises(PySparkException):
        P.read_published(spark, f"{tmp_path}/none").count()


def test_killed_tasks_publish_nothing(spark, tmp_path):
    """A task fails while others write: nothing of the job can be read, and what a task wrote after the job's end goes by vacuum."""
    path = f"{tmp_path}/p"

    @F.udf("long")
    def fails(x):
        if x == 77:
            raise RuntimeError("lost")
        return x

    df = spark.range(100).repartition(4).select(fails("id").alias("id"))
    with pytest.raises(PySparkException):
        P.publish(df, path)
    assert P.manifest(path) is None
    P.publish(spark.range(10), path)
    with pytest.raises(PySparkException):
        P.publish(df, path, "overwrite")
    assert P.read_published(spark, path).count() == 10
    P.vacuum(path)
    assert {f"data/{f}" for f in os.listdir(f"{path}/data")} == {f["file"] for f in P.manifest(path)["files"]}


@pytest.mark.parametrize("what", ["byte", "cut", "gone", "manifest", "longer"])
def test_changes_are_found_at_read(spark, tmp_path, what):
    path = f"{tmp_path}/p"
    held = P.publish(spark.range(1000).repartition(2), path)
    name = f"{path}/{held['files'][1]['file']}"
    if what == "manifest":
        name = f"{path}/{open(f'{path}/CURRENT').read()}"
    data = bytearray(open(name, "rb").read())
    if what == "gone":
        os.remove(name)
    else:
        data[-40] ^= 1
        open(name, "wb").write(bytes(data[:-100]) if what == "cut" else bytes(data) + b"more" if what == "longer" else bytes(data))
    with pytest.raises(PySparkException):
        P.read_published(spark, path).agg(F.sum("id")).collect()


def test_a_job_goes_on_at_the_first_missing_stage(spark, tmp_path):
    calls, broken = [], [True]

    def stage(name, f):
        def run(df):
            calls.append(name)
            if name == "c" and broken[0]:
                raise RuntimeError("stopped")
            return f(df)

        return name, run

    stages = [stage("a", lambda d: d.where("id % 2 = 0")), stage("b", lambda d: d.withColumn("x", F.col("id") + 1)), stage("c", lambda d: d.where("x > 5")), stage("d", lambda d: d.agg(F.sum("x").alias("s")))]
    first, folder = spark.range(20), f"{tmp_path}/job"
    with pytest.raises(RuntimeError):
        P.run_stages(spark, folder, stages, first, "v1")
    broken[0] = False
    out, ran = P.run_stages(spark, folder, stages, first, "v1")
    assert ran == ["c", "d"] and calls == ["a", "b", "c", "c", "d"] and out.first()["s"] == sum(x + 1 for x in range(6, 20, 2))
    assert P.run_stages(spark, folder, stages, first, "v1")[1] == []
    assert P.run_stages(spark, folder, stages, spark.range(40), "v2")[1] == ["a", "b", "c", "d"]  # the input is another
