"""Sidecars by stem and damaged packets."""

import json

from pyspark.sql import functions as F

from foliant.operators import sidecars as D


def test_confidence_by_stem(spark):
    items = spark.createDataFrame([("d/a", 1, 0, "text", [0, 1, 2, 3], 0, "x", 1.0), ("d/a", 0, 1, "text", [0, 1, 2, 3], 0, "y", 0.5), ("d/a", 0, 0, "text", [0, 1, 2, 3], 0, "z", 2.0)], "stem string, page int, idx int, type string, bbox array<int>, angle int, content string, score double")
    model = D.model_documents(items)
    text = model.first()["json"]
    assert [[i["content"] for i in p] for p in json.loads(text)] == [["z", "y"], ["x"]] and '"bbox":[0.0,1.0,2.0,3.0]' in text and '"score":1.0' in text
    blocks = spark.createDataFrame([("d/a", 0, 0, "text", "t", 0.25), ("e_middle", 0, 0, "text", None, None)], "stem string, page int, idx int, type string, text string, confidence double")
    middle = D.middle_documents(blocks)
    lists = spark.createDataFrame([(f"{s}_content_list.json", "[]") for s in ("d/a", "e_middle", "none", "d/a")] + [("broken_content_list.json", None), ("broken_model.json", "[{"), ("x.json", "[]"), (None, None)], "path string, json string")
    out = {r["stem"]: (r["n"], r["mean"]) for r in D.confidence_by_stem(model.unionByName(middle).unionByName(lists)).collect()}
    assert out == {"d/a": (3, (1.0 + 0.5 + 0.25) / 3), "e_middle": (0, None), "none": (0, None), "broken": (0, None)}


def test_packets(spark):
    rows = [("a", 1, "0080"), ("a", 2, "008"), ("a", 3, "FF7F0100"), ("a", 4, None), ("b", 1, "xy"), ("c", 1, "")]
    frames, told = D.decoded_packets(spark.createDataFrame(rows, "clip string, seq int, payload string"), D.pcm16(F.col("payload")))
    assert {(r["clip"], r["seq"]): r["samples"] for r in frames.collect()} == {("a", 1): [-1.0], ("a", 3): [32767 / 32768, 1 / 32768], ("c", 1): []}
    assert {r["clip"]: (r["kept"], r["skipped"], r["error"]) for r in told.collect()} == {"a": (2, 2, None), "b": (0, 1, "no sound is left"), "c": (1, 0, "no sound is left")}


def test_images_that_are_there(spark):
    rows = [(1, "![a](x.png) ![b](y.png) ![c](http://x.png) ![d](a/x.png)"), (2, "none"), (3, None), (4, '![a](x.png "title") [link](x.png) ![a](x.pngs)')]
    files = spark.createDataFrame([("x.png",), ("x.png",), ("a/x.png",)], "name string")
    out = {r["id"]: r["text"] for r in D.present_images(spark.createDataFrame(rows, "id int, text string"), files, "/b/").collect()}
    assert out == {1: "![a](file:///b/x.png) ![b](y.png) ![c](http://x.png) ![d](file:///b/a/x.png)", 2: "none", 3: None, 4: '![a](file:///b/x.png "title") [link](file:///b/x.png) ![a](x.pngs)'}
