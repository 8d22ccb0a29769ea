"""Boxes as columns: a box is a struct with xmin, ymin, xmax, ymax. Zero denominators give 0."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(xmin.alias("xmin"), ymin.alias("ymin"), xmax.alias("xmax"), ymax.alias("ymax"))


def _positive(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def width(a: Column) -> Column:
    return _positive(a["xmax"] - a["xmin"])


def height(a: Column) -> Column:
    return _positive(a["ymax"] - a["ymin"])


def area(a: Column) -> Column:
    return width(a) * height(a)


def x_overlap(a: Column, b: Column) -> Column:
    return _positive(F.least(a["xmax"], b["xmax"]) - F.greatest(a["xmin"], b["xmin"]))


def intersection(a: Column, b: Column) -> Column:
    return x_overlap(a, b) * _positive(F.least(a["ymax"], b["ymax"]) - F.greatest(a["ymin"], b["ymin"]))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return _ratio(inter, area(a) + area(b) - inter)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return _ratio(intersection(a, b), F.least(area(a), area(b)))


def cover_ratio(inner: Column, outer: Column) -> Column:
    return _ratio(intersection(inner, outer), area(inner))


def x_overlap_ratio(a: Column, b: Column) -> Column:
    return _ratio(x_overlap(a, b), F.least(width(a), width(b)))


def x_cover_ratio(anchor: Column, candidate: Column) -> Column:
    return _ratio(x_overlap(anchor, candidate), width(candidate))


def rounded(digits: int):
    """Python's round of the exact binary value (half to even), which the JVM's rounding is not."""

    @F.arrow_udf(T.DoubleType())
    def exact(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None or not math.isfinite(v) else round(v, digits) for v in values.to_pylist()], pa.float64())

    return exact


round3, round4 = rounded(3), rounded(4)


def half_even(c: Column) -> Column:
    return F.rint(c).cast("int")


def _is_unit(a: Column) -> Column:
    return a["xmin"].between(0, 1) & a["ymin"].between(0, 1) & a["xmax"].between(0, 1) & a["ymax"].between(0, 1)


def to_unit(a: Column, page_w: Column, page_h: Column) -> Column:
    """The box in the unit square at 3 digits; null if the page or the box is empty."""
    unit = _is_unit(a)

    def side(name: str, size: Column) -> Column:
        return round3(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(unit, a[name]).otherwise(a[name] / size).cast("double"))))

    out = box(side("xmin", page_w), side("ymin", page_h), side("xmax", page_w), side("ymax", page_h))
    return F.when((page_w > 0) & (page_h > 0) & (out["xmax"] > out["xmin"]) & (out["ymax"] > out["ymin"]), out)


def from_centre(cx: Column, cy: Column, w: Column, h: Column, page_w: Column, page_h: Column) -> Column:
    return box((cx - w / 2) * page_w, (cy - h / 2) * page_h, (cx + w / 2) * page_w, (cy + h / 2) * page_h)


def clip(a: Column, page_w: Column, page_h: Column) -> Column:
    """Floor of the minima, ceiling of the maxima, inside the page; null if empty."""

    def side(c: Column, most: Column) -> Column:
        return F.greatest(F.lit(0), F.least(c.cast("int"), most.cast("int")))

    out = box(side(F.floor(a["xmin"]), page_w), side(F.floor(a["ymin"]), page_h), side(F.ceil(a["xmax"]), page_w), side(F.ceil(a["ymax"]), page_h))
    return F.when((out["xmax"] > out["xmin"]) & (out["ymax"] > out["ymin"]), out)


def norm_angle(c: Column) -> Column:
    v = c.cast("string").try_cast("int")
    return F.when(v.isin(0, 90, 180, 270), v).otherwise(0)


def to_pixels(values: Column, page_w: Column, page_h: Column) -> Column:
    """A box of four values (numbers, 'true' or numeric strings, as strings) in pixels; null if it is none."""
    v = F.transform(values, lambda x: F.when(F.lower(x) == "true", 1.0).when(F.lower(x) == "false", 0.0).otherwise(x.try_cast("double")))
    raw = box(F.get(v, 0), F.get(v, 1), F.get(v, 2), F.get(v, 3))
    unit = _is_unit(raw)
    x0, x1 = (F.when(unit, raw[k] * page_w).otherwise(raw[k]) for k in ("xmin", "xmax"))
    y0, y1 = (F.when(unit, raw[k] * page_h).otherwise(raw[k]) for k in ("ymin", "ymax"))
    out = box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))
    known = ~F.exists(v, lambda x: x.isNull()) & (F.size(values) == 4)
    return F.when(known & (out["xmax"] > out["xmin"]) & (out["ymax"] > out["ymin"]), out)


def smart_resize(h: Column, w: Column, factor: int = 28, least: int = 56 * 56, most: int = 14 * 14 * 4 * 1280) -> Column:
    """Height and width as multiples of `factor` with the number of pixels in bounds and the shape nearly kept."""
    h, w = h.cast("double"), w.cast("double")
    h0, w0 = (F.rint(x / factor) * factor for x in (h, w))
    shrink, grow = F.sqrt(h * w / most), F.sqrt(F.lit(float(least)) / (h * w))
    small = [F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor) for x in (h, w)]
    large = [F.ceil(x * grow / factor) * factor for x in (h, w)]
    pick = lambda i, plain: F.when(h0 * w0 > most, small[i]).when(h0 * w0 < least, large[i]).otherwise(plain).cast("int")
    return F.struct(pick(0, h0).alias("height"), pick(1, w0).alias("width"))


def sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))
