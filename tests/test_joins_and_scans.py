"""Spatial joins, scans in two levels and exact selection against plain computations."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import scans as C
from foliant.operators import signal as S
from foliant.operators import spatial as G

BOXES = "id int, page string, xmin double, ymin double, xmax double, ymax double"


def some_boxes(seed, n):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w, h = rng.uniform(-50, 50), rng.choice([0.0, 8.0, 16.0, rng.uniform(-9, 30)]), rng.choice([0.0, 1.0, 2.0, 8.0, rng.uniform(0, 4), 70.0]), rng.choice([0.0, 2.0, 4.0, rng.uniform(0, 9)])
        out.append((k, rng.choice(["a", "b", "b"]), x, y, x + w, y + h))
    return out + [(n, None, 0.0, 0.0, 9.0, 9.0), (n + 1, "a", None, 0.0, 9.0, 9.0), (n + 2, "a", float("nan"), 0.0, 9.0, 9.0), (n + 3, "a", 5.0, 0.0, 1.0, 9.0), (n + 4, "a", 0.0, 0.0, float("inf"), 1.0)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("page", ["page", None])
def test_boxes_that_meet(spark, closed, page):
    a, b = some_boxes(1, 150), some_boxes(2, 150)
    b += [(900, "b", x, y, X, Y) for _, _, x, y, X, Y in a[:5]]
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in G.boxes_meeting(spark.createDataFrame(a, BOXES).withColumn("level", F.lit(1)), spark.createDataFrame(b, BOXES).withColumn("group", F.lit("g")), page, closed).collect())

    def sound(x):
        return None not in x[2:] and all(abs(v) < 1e9 for v in x[2:]) and x[2] <= x[4] and x[3] <= x[5]

    def meet(x, y):
        if page and (x[1] is None or x[1] != y[1]):
            return False
        ends = [(max(x[k], y[k]), min(x[k + 2], y[k + 2])) for k in (2, 3)]
        return all(p <= q if closed else p < q for p, q in ends)

    assert got == sorted((x[0], y[0]) for x in a if sound(x) for y in b if sound(y) and meet(x, y))


def test_small_boxes_do_not_meet_in_a_large_ones_cell(spark):
    """A large box over 2,000 small ones that lie apart: a row for each small box, not for each two of them."""
    small = [(k, "p", float(3 * k), 0.0, 3.0 * k + 1, 1.0) for k in range(2000)]
    boxes = spark.createDataFrame([*small, (5000, "p", 0.0, 0.0, 6000.0, 1.0)], BOXES)
    assert G.boxes_meeting(boxes, boxes).count() == 2 * 2000 + 2001
    best = G.covering(boxes.where("id < 5000"), boxes, 0.5, "id", "id").collect()
    assert len(best) == 2000 and all(r["outer"] == r["id"] and r["covered"] == 1.0 for r in best)


def test_intervals(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice("xy"), b, b + rng.choice([0, 1, 5, 400])) for k, b in enumerate(rng.choices(range(-300, 300), k=200))]
    df = spark.createDataFrame(rows, "id int, k string, begin long, end long")
    got = sorted((r["l"]["id"], r["r"]["id"]) for r in G.intervals_meeting(df, df, on="k").collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2])
    assert G.intervals_meeting(df.where("false"), df).count() == 0


def clip_rows(seed):
    rng = random.Random(seed)
    return [(c, 3 * i - 50, rng.choice([None, 0.0, 0.1, 0.2, 0.5, rng.random()])) for c, n in (("a", 300), ("b", 7), (None, 40)) for i in range(n) if rng.random() < 0.8]


@pytest.mark.parametrize("size", [5, 1 << 16])
def test_scans_do_not_depend_on_blocks(spark, size):
    rows = clip_rows(3)
    df = spark.createDataFrame(rows, "clip string, frame long, rms double")
    want_low, want_run, seen = {}, {}, {}
    for c, f, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        low, voiced, first = seen.get(c, (None, None, f))
        low = min(filter(None, [low, (x, f) if x is not None else None]), default=None)
        voiced = f if x is not None and x >= 0.4 else voiced
        seen[c] = low, voiced, first
        want_low[c, f], want_run[c, f] = low or (None, None), f - first + 1 if voiced is None else f - voiced
    assert {(r["clip"], r["frame"]): (r["low"], r["low_frame"]) for r in C.running_minimum(df, size).collect()} == want_low
    assert {(r["clip"], r["frame"]): r["silence"] for r in C.silence_runs(df, 0.4, size).collect()} == want_run
    assert C.running_minimum(df.where("false")).count() == 0


def test_one_clip_is_many_tasks(spark):
    df = spark.range(200_000).select(F.lit("only").alias("clip"), F.col("id").alias("frame"), F.rand(1).alias("rms"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        full = [r[0] for r in C.running_minimum(df, 1000).groupBy(F.spark_partition_id().alias("p")).count().select("count").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(full) == 4 and max(full) < 100_000


@pytest.mark.parametrize("span", [60, 86_400])
def test_sessions_do_not_depend_on_blocks(spark, span):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, None]), rng.randrange(0, 40_000)) for _ in range(400)] + [(1, None), (2, 5), (2, 5)]
    df = spark.createDataFrame(rows, "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted(map(repr, C.sessions(df, "k", "ts", 200, span).collect()))
    assert got == sorted(map(repr, S.sessions(df.where("ts is not null"), "k", "ts", 200).collect()))


@pytest.mark.parametrize("leaf,bins", [(2, 8), (4096, 32)])
def test_selection_is_exact(spark, leaf, bins):
    rng = random.Random(6)
    clips = {
        "equal": [2.5] * 400, "spread": [rng.uniform(-1, 1) for _ in range(501)], "powers": [10.0 ** rng.randrange(-300, 300) * rng.choice([1, -1]) for _ in range(300)], "two": [1.0, 2.0] * 90,
        "huge": [-1.7e308, 1.7e308, 0.0, 1.0, 5e-324] * 20, "one": [7.0], None: [3.0, 1.0, 2.0], "next": [1.0, 1.0 + 2**-52] * 30,
    }
    rows = [(c, x) for c, own in clips.items() for x in own] + [("one", None), ("none", None)]
    rng.shuffle(rows)
    out = C.upper_median(spark.createDataFrame(rows, "clip string, x double"), leaf, bins).collect()
    assert {r["clip"]: (r["n"], r["median"]) for r in out} == {c: (len(own), sorted(own)[len(own) // 2]) for c, own in clips.items()} and len(out) == len(clips)
    least = C.selected(spark.createDataFrame(rows, "clip string, x double"), F.lit(0), leaf, bins).collect()
    assert {r["clip"]: r["value"] for r in least} == {c: min(own) for c, own in clips.items()}


def test_window_orders_match(spark):
    """The scans of `signal` and of this module are the same."""
    df = spark.createDataFrame([r for r in clip_rows(5) if r[2] is not None], "clip string, frame long, rms double")
    key = lambda d: sorted(map(repr, d.select("clip", "frame", *d.columns[3:]).collect()))
    assert key(C.running_minimum(df, 16)) == key(S.running_minimum(df)) and key(C.silence_runs(df, 0.3, 16)) == key(S.silence_runs(df, 0.3))
