"""Scores and confidences as columns and aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def accuracy(edits: Column, length: Column) -> Column:
    """1 - edits / length of one pair; 0 without reference characters."""
    return F.when(length > 0, 1 - edits / length).otherwise(F.lit(0.0))


def micro_accuracy(edits: Column, length: Column) -> Column:
    """1 - sum of edits / sum of reference characters over a group; 0 without any."""
    return accuracy(F.sum(edits), F.sum(length))


def error_rate(edits: Column, length: Column) -> Column:
    """Sum of edits / sum of lengths over a group; 0 without any."""
    return F.when(F.sum(length) > 0, F.sum(edits) / F.sum(length)).otherwise(F.lit(0.0))


def summary(score: Column) -> list[Column]:
    """count, mean, minimum, maximum; zeros for an empty group."""
    zero = F.lit(0.0)
    return [F.count(score).alias("count"), F.coalesce(F.avg(score), zero).alias("mean"), F.coalesce(F.min(score), zero).alias("minimum"), F.coalesce(F.max(score), zero).alias("maximum")]


def geometric_mean(p: Column) -> Column:
    """Of the positive probabilities of a group."""
    return F.exp(F.avg(F.when(p > 0, F.ln(p))))


def softmax_at(scores: Column, index: Column) -> Column:
    """Softmax probability of one element of an array, shifted by the maximum."""
    top = F.array_max(scores)
    return F.exp(F.get(scores, index) - top) / F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))


def argmax_first(scores: Column) -> Column:
    """0-based position of the largest element, the first on a tie; NaN never wins, null if nothing is left."""
    known = F.transform(scores, lambda x: F.when(F.isnan(x), F.lit(None)).otherwise(x))
    return F.nullif(F.array_position(known, F.array_max(known)) - 1, F.lit(-1)).cast("int")


def upper_median(values: Column) -> Column:
    """sorted[n / 2] of an array."""
    return F.element_at(F.array_sort(values), F.floor(F.size(values) / 2).cast("int") + 1)


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def nearest_millis(ts: Column | str) -> Column:
    """The nearest millisecond since the epoch, halves away from zero, as SQL's epoch_ms has it; unix_millis cuts them off."""
    us = F.unix_micros(ts)
    return F.call_function("div", us + F.when(us < 0, -500).otherwise(500), F.lit(1000))
