"""Manifests, checksums, configuration, sinks, tokens, checks."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.operators import tokens as K
from foliant.operators import vectors as V
from foliant.operators import verify as C
from foliant.operators.bytepair import merge
from foliant.sources import readers as R
from foliant.sources import writers as W

GOOD = {"schema": "Any-Acceptance/1", "dataset_id": " d ", "task_type": "scan", "samples": [{"id": " ", "input": "a.png", "reference_text": "x", "reference_path": "y", "input_sha256": "AB" * 32}, {"id": "k", "input": "b.png", "reference_path": "r.txt"}]}


def manifest(spark, tmp_path, **change):
    path = tmp_path / "m.json"
    path.write_text(json.dumps(GOOD | change, indent=1))
    return R.read_manifest(spark, str(path))


def test_manifest(spark, tmp_path):
    rows = manifest(spark, tmp_path).collect()
    assert [r["id"] for r in rows] == ["sample-0001", "k"] and rows[0]["dataset_id"] == "d" and rows[0]["threshold"] == 0.98
    assert rows[0]["reference_path"] is None and rows[0]["reference_text"] == "x" and rows[0]["input_sha256"] == "ab" * 32 and rows[1]["case_sensitive"] is True


@pytest.mark.parametrize("change", [{"threshold": 0.9}, {"schema": "other"}, {"task_type": "x"}, {"samples": []}, {"dataset_id": " "}, {"samples": [{"id": "a", "input": "i"}]}, {"samples": [{"id": "a", "reference_text": "x", "input_sha256": "12"}]}])
def test_bad_manifests(spark, tmp_path, change):
    with pytest.raises(PySparkException):
        manifest(spark, tmp_path, **change).collect()


def test_checksums(spark):
    lines = lambda *v: R.checksum_rows(spark.createDataFrame([(x,) for x in v], "value string"))
    assert {r["path"]: r["sha256"] for r in lines("A" * 64 + "  d/x.txt\r", "b" * 64 + "\ty", "").collect()} == {"d/x.txt": "a" * 64, "y": "b" * 64}
    for bad in (["z" * 64 + " x"], ["a" * 64 + " ../escape.bin"], ["a" * 64 + " /abs"], ["a" * 64 + " x", "b" * 64 + " x"]):
        with pytest.raises(PySparkException):
            lines(*bad).collect()


def test_reconcile(spark):
    e = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    a = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, sha256 string")
    assert {r["path"]: r["state"] for r in C.reconcile(e, a).collect()} == {"a": "ok", "b": "mismatched", "c": "missing", "d": "unexpected"}


def test_config():
    assert R.load_config("{") == R.CONFIG and R.load_config("[1]") == R.CONFIG
    out = R.load_config('{"device": "cpu", "other": 1, "table": "no", "threshold": 1}')
    assert out == R.CONFIG | {"device": "cpu", "threshold": 1}


def test_paths(spark, tmp_path):
    for name in ("b.PNG", "sub/a.jpg", "sub/n.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    out = R.expand_inputs(spark, [str(tmp_path / "sub"), str(tmp_path)]).orderBy("idx").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in out] == ["a.jpg", "b.PNG"]
    assert R.read_images(spark, str(tmp_path)).count() == 2


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id int, text string")
    a, b = W.write_checksummed(df, str(tmp_path / "x")), W.write_checksummed(df.repartition(3), str(tmp_path / "y"))
    assert a == b != W.write_checksummed(df.where("id < 19"), str(tmp_path / "z"))
    W.write_texts(df.selectExpr("concat('n/', id) AS name", "text"), str(tmp_path / "t"))
    assert {(r["name"], r["value"]) for r in spark.read.text(str(tmp_path / "t")).collect()} == {(f"n_{i}", f"t{i}") for i in range(20)}
    assert W.write_stage(df, str(tmp_path / "s"), "01_layout").count() == 20
    blocks = spark.createDataFrame([(1, 1, "b", False), (1, 0, "a", False), (1, 2, "c", True)], "page int, idx int, markdown string, discarded boolean")
    W.write_markdown(blocks, str(tmp_path / "m"))
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "m/markdown"), wholetext=True).collect()).strip() == "a\n\nb"
    assert spark.read.json(str(tmp_path / "m/content_list")).count() == 3
    jobs = spark.createDataFrame([(1, "d/a b.png", "2024-01-02 03:04:05"), (2, "e/a b.jpg", "2024-01-02 03:04:05")], "id int, source string, t string").withColumn("ts", F.to_timestamp("t"))
    assert [r["folder"] for r in W.job_names(jobs).orderBy("id").collect()] == ["20240102-030405_a b", "20240102-030405_a b_2"]


def test_transcript(spark):
    rows = [("c", 1, 2.0, 3.0, "b", None, 9.0), ("c", 0, None, None, "a", 0.5, 9.0)]
    j = json.loads(W.transcript_json(spark.createDataFrame(rows, "clip string, idx int, start double, end double, text string, confidence double, duration double"), "m", "cpu").first()["json"])
    assert j["text"] == "ab" and j["schema_version"] == 2 and j["segments"][0]["end"] == 9.0 and j["segments"][0]["confidence"]["value"] == 0.5 and "confidence" not in j["segments"][1]


def test_tokens(spark, one):
    array = lambda *v: F.array(*map(F.lit, v))
    assert one(K.banned_tokens(array(1, 2, 9, 1, 2), 3)) == [9] and one(K.banned_tokens(array(1, 2), 0)) == [] and one(K.banned_tokens(array(1), 3)) == []
    assert one(K.banned_tokens(array(3, 4, 3), 1)) == [3, 4, 3]
    rng = random.Random(1)
    for _ in range(20):
        h, n = [rng.randrange(3) for _ in range(rng.randint(1, 12))], rng.randint(2, 4)
        last = h[len(h) - n + 1 :] if len(h) >= n - 1 else None
        want = [h[i + n - 1] for i in range(len(h) - n + 1) if h[i : i + n - 1] == last]
        assert one(K.banned_tokens(array(*h), n)) == want, (h, n)
    assert one(K.expand_pads(array(1, 9, 9), 9, 3)) == [1, 9, 9, 9, 9]
    assert merge(list("abcab"), {("a", "b"): 1, ("ab", "c"): 2}) == ["abc", "ab"]
    assert K.features(b"short") is None and K.features(b" " * 20) is None
    f = K.features(b"  " + b"x" * 3000 + b"\n")
    assert len(f) == 2048 and f[0] == ord("x") and f[-1] == ord("x")
    assert K.features(b"12345678")[:9] == [*b"12345678", 256]
    texts = ["Hello  world's e\u0301t\u00e9", "a\n\n b 12", "你好 world"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(K.pieces(F.col("t")).alias("p")).collect()
    assert [r["p"] for r in got] == [K.python_pieces(t) for t in texts]


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i)]) for i in range(10)], "vec_id long, embedding array<double>")
    assert sorted(r["vec_id"] for r in V.rows_between(v, 3, 2).collect()) == [3, 4]
    with pytest.raises(PySparkException):
        V.lookup(spark.createDataFrame([(99,)], "id long"), v).collect()
