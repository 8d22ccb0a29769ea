"""Model seams, table functions, SQL names."""

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import seams


def test_model_seam(spark):
    df = spark.createDataFrame([("text", "ab"), ("table", "cd"), ("list", "x")], "type string, crop string")
    out = seams.extract_with(df, lambda: 3, lambda m, xs: [None if x is None else x * m for x in xs], skip=["text"]).collect()
    assert [r["content"] for r in out] == [None, "cdcdcd", None]
    n = seams.model_udf(lambda: None, lambda m, xs: [len(x) for x in xs], T.LongType())
    assert [r["n"] for r in df.select(n(F.col("crop")).alias("n")).collect()] == [2, 2, 1]


def test_choice():
    assert seams.first_position([1.0, 3.0, 3.0], set())[0] == 1 and seams.first_position([1.0, 3.0, math.nan], {1})[0] == 0 and seams.first_position([], set()) == (-1, 0.0)


def test_sql_names(spark):
    seams.register(spark)
    assert spark.sql("select nfc('é') AS a, casefold_text('ß') AS b, json_error('{}') AS c").first() == ("é", "ss", None)
    rows = spark.sql("select * from grid_cells('<table><tr><td colspan=\"2\">a</td></tr></table>')").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 2, "a")]


def test_image_tokens(one):
    tags = F.create_map(F.lit("ACDG"), F.lit("<img>"))
    assert one(seams.image_tokens(F.col("s"), tags), s="a [ACDG] [HHHH] [ABCD]") == "a <img> [HHHH] [ABCD]"
