"""Edits of long texts, aggregates with partial states, functions of tables, walks through nested documents."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foliant.functions import edit, jsonx
from foliant.operators import extension as E


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_distance_and_edits(seed):
    rng = random.Random(seed)
    for _ in range(400):
        a, b = ("".join(rng.choice("abé日😀"[: rng.randrange(1, 6)]) for _ in range(rng.randrange(30))) for _ in range(2))
        d = plain_distance(a, b)
        e = edit.edits(a, b)
        assert edit.distance(a, b) == d == sum(e), (a, b)
        assert e.added - e.removed == len(b) - len(a) and min(e) >= 0 and e.replaced + e.removed <= len(a) and e.replaced + e.added <= len(b)


def test_long_texts():
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    b = list(a)
    for k in range(0, 40_000, 400):
        b[k] = "X"
    del b[777:787]
    b = "".join(b[:20_000]) + "YYYYY" + "".join(b[20_000:])
    assert edit.distance(a, b) == 100 + 10 + 5 and edit.edits(a, b) == (100, 5, 10)


def test_edit_columns(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), (None, "x"), ("", "abc"), ("same", "same")], "a string, b string")
    out = rows.select(edit.long_distance(F.col("a"), F.col("b")).alias("d"), edit.edit_counts(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r["d"] for r in out] == [3, None, 3, 0] and out[0]["e"] == (2, 1, 0) and out[1]["e"] is None and out[2]["e"] == (0, 3, 0)


@pytest.mark.parametrize("flush", [1, 1 << 16])
def test_partial_states(spark, monkeypatch, flush):
    monkeypatch.setattr(E, "FLUSH", flush)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2]), rng.choice([None, 1e9 + rng.random(), rng.random()])) for _ in range(500)] + [("only", 1, None)]
    df = spark.createDataFrame(rows, "k string, n int, x double").repartition(4)
    got = {(r["k"], r["n"]): (r["n_"], r["mean"], r["variance"]) for r in E.aggregated(df, ["k", "n"], "x", E.Aggregate("n_ long, mean double, variance double", E._moments, E._both, E.MOMENTS.finish)).collect()}
    groups = {}
    for k, n, x in rows:
        groups.setdefault((k, n), []).extend([] if x is None else [x])
    assert got.keys() == groups.keys()
    for key, own in groups.items():
        n, mean, variance = got[key]
        assert n == len(own) and (mean is None if not own else math.isclose(mean, np.mean(own), rel_tol=1e-9) and math.isclose(variance, np.var(own), rel_tol=1e-9))
    most = E.Aggregate("top double", lambda x: x.max(initial=-np.inf), max, lambda s: (s,))
    assert {r["k"]: r["top"] for r in E.aggregated(df.where("x is not null"), ["k"], "x", most).collect()} == {k: max(x for c, _, x in rows if c == k and x is not None) for k in ("a", "b", None)}
    assert E.aggregated(df.where("false"), ["k"], "x", E.MOMENTS).count() == 0


def test_table_function(spark):
    E.register(spark)
    rows = [("u", 1, "x"), ("u", 2, "x"), ("u", 3, None), ("u", 4, None), ("u", 5, "x"), ("v", 9, "x"), (None, 1, "y")]
    spark.createDataFrame(rows, "who string, at int, what string").repartition(3).createOrReplaceTempView("some_rows")
    out = spark.sql("SELECT * FROM runs_of(TABLE(some_rows), 'who', 'at', 'what')")
    assert out.columns == ["who", "what", "first", "last", "n"] and [t for _, t in out.dtypes] == ["string", "string", "int", "int", "bigint"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [("u", "x", 1, 2, 2), ("u", None, 3, 4, 2), ("u", "x", 5, 5, 1), ("v", "x", 9, 9, 1), (None, "y", 1, 1, 1)]))
    for bad in ("SELECT * FROM runs_of(TABLE(some_rows), 'who', 'nothing', 'what')", "SELECT * FROM runs_of(1, 'who', 'at', 'what')"):
        with pytest.raises(PySparkException):
            spark.sql(bad).collect()


def test_walked_scores(spark):
    rng = random.Random(7)

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return rng.choice([0.5, 1, 0, 2, -0.1, "0.5", True, None, 0.25])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 3 else {rng.choice(["score", "confidence", "a", "Score"]): value(depth - 1) for _ in range(4)}

    texts = [json.dumps(value(6)) for _ in range(150)] + [None, "", "{", '{"score": 0.5} x', "0.5", "[]", json.dumps({"score": {"score": [{"confidence": 0.125}]}})]
    want = []
    for k, t in enumerate(texts):
        found = []
        try:
            jsonx._scores(json.loads(t), frozenset(("score", "confidence")), found) if t else None
        except ValueError:
            pass
        want += [(k, x) for x in found if 0 <= x <= 1]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert sorted((r["id"], r["score"]) for r in jsonx.walked_scores(df, "k", "t").collect()) == sorted(want)
    assert "Python" not in jsonx.walked_scores(df.limit(3), "k", "t")._jdf.queryExecution().executedPlan().toString()


def test_strict_json_is_one_value(spark):
    good = ["1", "null", '"a"', " [1, 2] ", '{"a": {"b": []}}', "-0.5e3", '"]"', '"}"']
    bad = ["", " ", "1 2", "1, 2", "1], [2", '1, "b": 2', '1} {"x": 1', "[1", "[1]]", "{}}", '{"a": 1, "a": 2}', "1]", "a", '{"a":1} x', None]
    out = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "k int, t string").select("k", jsonx.is_json(F.col("t")).alias("ok")).collect()
    assert [bool(r["ok"]) for r in sorted(out)] == [True] * len(good) + [False] * len(bad)
