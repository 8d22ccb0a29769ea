"""Joins of boxes and of intervals that meet, without testing every pair of a page.

A box has a level, the power of four that its longer side fills at most, and lies in the cells of that size that it
touches: four at most. A pair is found at the level of its larger box: the larger one stands in its own cells, the smaller one
visits the cells of each larger level that occurs. So the join is one on equal keys (group, level, cell), a box
is some four rows for each level (some forty levels for any data, a few for boxes of a page), and two small boxes never meet in a large
one's cell. A pair that shares several cells is kept in that of its reference point alone, the upper left corner of what
the two have in common, so it comes once and nothing needs to be made distinct.

Scale: work grows with boxes and with pairs that meet, however many boxes a page or an interval's key has. A key of a
third of all rows is spread over its cells. Boxes without area and intervals without length have the lowest level.

Cases: a box with a null or NaN corner, or with its ends reversed, meets nothing; null groups meet nothing; boxes
that only touch meet (`closed`) or not; repeated rows are pairs of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sides from 2^LOWEST to 2^HIGHEST have levels of their own.
LOWEST, HIGHEST = -20, 60
#: Levels that lie this far apart have cells of their own, those between go up: each level that occurs is a row more for each smaller box.
STEP = 2
Axis = tuple[str, str]


def level_of(longest: Column) -> Column:
    """The smallest multiple k of STEP with longest <= 2^k, within the bounds."""
    k = F.ceil(F.log2(F.greatest(longest, F.lit(2.0**LOWEST)))).cast("int")
    k = F.when(F.pow(F.lit(2.0), k) < longest, k + 1).otherwise(k)  # a logarithm may round down
    k = (F.ceil(k / STEP) * STEP).cast("int")
    return F.least(F.greatest(k, F.lit(LOWEST)), F.lit(HIGHEST))


def cell_of(x: Column, level: Column) -> Column:
    return F.floor(x / F.pow(F.lit(2.0), level))


def placed(rows: DataFrame, axes: list[Axis], side: str) -> DataFrame:
    """Rows as one struct `side` with their level; those that can meet anything."""
    ends = [F.col(c).cast("double") for a in axes for c in a]
    whole = reduce(lambda x, y: x & y, [F.coalesce(~F.isnan(e) & (F.abs(e) < 2.0**52), F.lit(False)) for e in ends] + [F.col(a).cast("double") <= F.col(b).cast("double") for a, b in axes])
    sides = [F.col(b).cast("double") - F.col(a).cast("double") for a, b in axes]
    return rows.where(whole).select(F.struct("*").alias(side), level_of(F.greatest(*sides) if len(sides) > 1 else sides[0]).alias(f"{side}_level"))


def in_cells(rows: DataFrame, axes: list[Axis], side: str, on: str | None, level: Column) -> DataFrame:
    """A row for each cell of `level` that the box touches."""
    out = rows.withColumn("level", level)
    for k, (a, b) in enumerate(axes):
        low, high = (cell_of(F.col(f"{side}.{c}").cast("double"), F.col("level")) for c in (a, b))
        out = out.withColumn(f"c{k}", F.explode(F.sequence(low, high)))
    return out.withColumn("group", F.col(f"{side}.{on}")) if on else out


def in_common(axes: list[Axis], closed: bool) -> Column:
    """Whether l and r meet, and this cell is that of their reference point."""
    meets = []
    for k, (a, b) in enumerate(axes):
        begin = F.greatest(F.col(f"l.{a}").cast("double"), F.col(f"r.{a}").cast("double"))
        end = F.least(F.col(f"l.{b}").cast("double"), F.col(f"r.{b}").cast("double"))
        meets += [begin <= end if closed else begin < end, cell_of(begin, F.col("level")) == F.col(f"c{k}")]
    return reduce(lambda x, y: x & y, meets)


def meeting_each_other(rows: DataFrame, axes: list[Axis], id: str, on: str | None = None, closed: bool = True) -> DataFrame:
    """Pairs (l, r) of rows of one table that meet, each pair once and l's `id` the smaller: one join instead of `meeting`'s two,
    since a pair of two levels is found from its smaller box alone. Rows of one id are no pair."""
    r = placed(rows, axes, "r")
    levels = sorted(x[0] for x in r.select("r_level").distinct().collect())
    l = r.withColumnsRenamed({"r": "l", "r_level": "l_level"})
    larger = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda k: k >= F.col("l_level"))
    visits = in_cells(l.withColumn("at", F.explode(larger)), axes, "l", on, F.col("at")).drop("at")
    keys = [*(["group"] if on else []), "level", *[f"c{k}" for k in range(len(axes))]]
    pairs = visits.join(in_cells(r, axes, "r", on, F.col("r_level")).drop("r_level"), keys)
    first = F.col(f"l.{id}") < F.col(f"r.{id}")
    # of one level both rows visit each other, so the pair comes in its order as well
    pairs = pairs.where(in_common(axes, closed) & F.when(F.col("l_level") == F.col("level"), first).otherwise(F.col(f"l.{id}") != F.col(f"r.{id}")))
    return pairs.select(F.when(first, F.col("l")).otherwise(F.col("r")).alias("l"), F.when(first, F.col("r")).otherwise(F.col("l")).alias("r"))


def meeting(left: DataFrame, right: DataFrame, axes: list[Axis], on: str | None = None, closed: bool = True) -> DataFrame:
    """Pairs (l, r), structs of the two sides' columns, of equal `on` whose ranges meet on every axis."""
    l, r = placed(left, axes, "l"), placed(right, axes, "r")
    # the levels that occur: some 80 numbers at most
    levels = lambda d, side: sorted(x[0] for x in d.select(f"{side}_level").distinct().collect())
    all_of = {"l": levels(l, "l"), "r": levels(r, "r")}
    keys = [*(["group"] if on else []), "level", *[f"c{k}" for k in range(len(axes))]]

    def visits(rows: DataFrame, side: str, other: str, equal: bool) -> DataFrame:
        larger = F.filter(F.array(*map(F.lit, all_of[other])).cast("array<int>"), lambda k: k >= F.col(f"{side}_level") if equal else k > F.col(f"{side}_level"))
        return in_cells(rows.withColumn("at", F.explode(larger)), axes, side, on, F.col("at")).drop("at")

    own = lambda rows, side: in_cells(rows, axes, side, on, F.col(f"{side}_level"))
    pairs = own(l, "l").join(visits(r, "r", "l", True), keys).select("l", "r", *keys).unionByName(visits(l, "l", "r", False).join(own(r, "r"), keys).select("l", "r", *keys))
    return pairs.where(in_common(axes, closed)).select("l", "r")


BOX: list[Axis] = [("xmin", "xmax"), ("ymin", "ymax")]


def boxes_meeting(left: DataFrame, right: DataFrame, page: str | None = "page", closed: bool = False) -> DataFrame:
    """Pairs (l, r) of boxes (xmin, ymin, xmax, ymax) of a page that have area in common, with `shared`, that area."""
    return shared_area(meeting(left, right, BOX, page, closed))


def boxes_meeting_each_other(boxes: DataFrame, id: str, page: str | None = "page", closed: bool = False) -> DataFrame:
    """The same of one table's boxes, each pair once, l's `id` the smaller."""
    return shared_area(meeting_each_other(boxes, BOX, id, page, closed))


def shared_area(pairs: DataFrame) -> DataFrame:
    width, height = (F.least(F.col(f"l.{b}"), F.col(f"r.{b}")) - F.greatest(F.col(f"l.{a}"), F.col(f"r.{a}")) for a, b in BOX)
    return pairs.withColumn("shared", width * height)


def covering(inner: DataFrame, outer: DataFrame, share: float, key: str, rank: str, page: str | None = "page") -> DataFrame:
    """For each box of `inner` that boxes of `outer` cover by `share` of its area or more, the one that covers
    most, ties to the smallest `rank`: (key, outer's rank, covered)."""
    area = (F.col("l.xmax") - F.col("l.xmin")) * (F.col("l.ymax") - F.col("l.ymin"))
    columns = [c for a in BOX for c in a] + ([page] if page else [])  # of a box only these travel
    inner, outer = inner.select(*dict.fromkeys([key, *columns])), outer.select(*dict.fromkeys([rank, *columns]))
    pairs = boxes_meeting(inner, outer, page).withColumn("covered", F.try_divide("shared", area)).where(F.col("covered") >= share)
    best = pairs.groupBy(F.col(f"l.{key}").alias(key)).agg(F.min(F.struct((-F.col("covered")).alias("less"), F.col(f"r.{rank}").alias("rank"))).alias("best"))
    return best.select(key, F.col("best.rank").alias("outer"), (-F.col("best.less")).alias("covered"))


def intervals_meeting(left: DataFrame, right: DataFrame, begin: str = "begin", end: str = "end", on: str | None = None, closed: bool = True) -> DataFrame:
    """Pairs (l, r) of intervals of one key that meet."""
    return meeting(left, right, [(begin, end)], on, closed)
