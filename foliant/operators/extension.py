"""What users add themselves: aggregates with partial states, and functions of whole tables.

`aggregated` takes an aggregate written as three functions over numpy columns. Tasks keep a state for each of their
groups, states are merged where a group's meet, and only they are shuffled: a group of a third of all rows is one state for
each task and flush. A task holds FLUSH states at most before it sends them on.

`Runs` is a function of a table: its result's columns and the way its rows are dealt follow from the table and from the
names it is called with. It is registered under an SQL name (`register`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

FLUSH = 1 << 16


@dataclass(frozen=True)
class Aggregate:
    """`state` of some rows' values, `merge` of two states, and `finish`: the result's fields, as `schema` names them."""

    schema: str
    state: Callable[[np.ndarray], object]
    merge: Callable[[object, object], object]
    finish: Callable[[object], tuple]


def aggregated(df: DataFrame, keys: list[str], value: str, how: Aggregate) -> DataFrame:
    """keys and the fields of the aggregate for each group; nulls of `value` are left out."""
    own = df.select(*keys, F.col(value).cast("double").alias("value_"))
    kept = own.select(*keys).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, object] = {}

        def told() -> pa.RecordBatch:
            rows = [{**dict(zip(keys, k)), "state_": pickle.dumps(s)} for k, s in held.items()]
            return pa.RecordBatch.from_pylist(rows, schema=wanted)

        wanted = None
        for b in batches:
            wanted = pa.schema([*(b.schema.field(k) for k in keys), ("state_", pa.binary())])
            if not b.num_rows:
                continue
            columns = [b[k].to_pylist() for k in keys]
            groups: dict[tuple, list[int]] = {}
            for i, k in enumerate(zip(*columns)):
                groups.setdefault(k, []).append(i)
            values = b["value_"].to_numpy(zero_copy_only=False)
            there = ~np.asarray(b["value_"].is_null())
            for k, at in groups.items():
                new = how.state(values[[i for i in at if there[i]]])
                held[k] = how.merge(held[k], new) if k in held else new
            if len(held) > FLUSH:
                yield told()
                held = {}
        if held:
            yield told()

    def final(table: pa.Table) -> pa.Table:
        states = [pickle.loads(s) for s in table["state_"].to_pylist()]
        out = states[0]
        for s in states[1:]:
            out = how.merge(out, s)
        names = [x.split()[0] for x in how.schema.split(", ")]
        one = table.slice(0, 1).drop_columns(["state_"])
        for name, v in zip(names, how.finish(out)):
            one = one.append_column(name, pa.array([v], pa.int64() if isinstance(v, int) else pa.float64()))
        return one

    states = own.mapInArrow(partial, f"{ddl}, state_ binary")
    return states.groupBy(*keys).applyInArrow(final, f"{ddl}, {how.schema}")


def _moments(x: np.ndarray) -> tuple[int, float, float]:
    return (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum())) if len(x) else (0, 0.0, 0.0)


def _both(a: tuple[int, float, float], b: tuple[int, float, float]) -> tuple[int, float, float]:
    n = a[0] + b[0]
    if not n:
        return a
    apart = b[1] - a[1]
    return n, a[1] + apart * b[0] / n, a[2] + b[2] + apart**2 * a[0] * b[0] / n


#: Number, mean and variance, from sums of squares about each part's own mean.
MOMENTS = Aggregate("n long, mean double, variance double", _moments, _both, lambda s: (s[0], s[1] if s[0] else None, s[2] / s[0] if s[0] else None))


class Runs:
    """runs_of(TABLE(t), key, place, value): for each key, in the order of `place`, the runs of equal values:
    the key, the value, the first and last place, the number of rows. Null is a value of its own."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, place: AnalyzeArgument, value: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = [x.value for x in (key, place, value)]
        fields = {f.name: f for f in rows.dataType.fields}
        if unknown := [n for n in names if n not in fields]:
            raise ValueError(f"the table has no column {unknown}")
        of = lambda name, n: StructField(name, fields[n].dataType, True)
        schema = StructType([of(names[0], names[0]), of(names[2], names[2]), of("first", names[1]), of("last", names[1]), StructField("n", LongType())])
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(names[0])], orderBy=[OrderingColumn(names[1])])

    def __init__(self):
        self.run: list | None = None

    def eval(self, rows: Row, key: str, place: str, value: str):
        if self.run and self.run[1] == rows[value]:
            self.run[3], self.run[4] = rows[place], self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [rows[key], rows[value], rows[place], rows[place], 1]

    def terminate(self):
        if self.run:
            yield tuple(self.run)


def register(spark: SparkSession) -> None:
    """Makes `runs_of` known to SQL."""
    spark.udtf.register("runs_of", F.udtf(Runs))
