"""Queries over layout boxes. Boxes are made from order lines: a page is an order, its boxes the lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scoring
from ..operators import blocks as B
from ..operators import layout as L
from .base import query, table

LABELS = ["text", "display_formula", "inline_formula", "table", "header", "footer", "footnote", "number", "doc_title", "paragraph_title", "seal"]
ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PAGE_W, PAGE_H = 150, 100

BOXES = f"""boxes AS (SELECT l_orderkey AS page, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS INTEGER) AS idx,
  list_extract({LABELS!r}, CAST(l_partkey % {len(LABELS)} + 1 AS BIGINT)) AS label, (l_extendedprice % 1000) / 1000 AS score,
  CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0, l_partkey % 60 + 40 + l_quantity AS x1, l_suppkey % 40 + 30 + round(l_discount * 200) AS y1 FROM lineitem)"""
NEAR = BOXES.replace("l_partkey % 60 + 40 + l_quantity AS x1, l_suppkey % 40 + 30 + round(l_discount * 200) AS y1", "CAST((l_partkey % 4) * 3 + 60 + CAST(l_quantity AS INTEGER) % 5 AS DOUBLE) AS x1, CAST((l_suppkey % 4) * 3 + 40 + l_linenumber % 3 AS DOUBLE) AS y1").replace(
    "CAST(l_partkey % 60 AS DOUBLE) AS x0, CAST(l_suppkey % 40 AS DOUBLE) AS y0", "CAST((l_partkey % 4) * 3 AS DOUBLE) AS x0, CAST((l_suppkey % 4) * 3 AS DOUBLE) AS y0"
)


def boxes(spark, sf_dir, near: bool = False) -> DataFrame:
    """page, index, label, score and corners."""
    line = table(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % len(LABELS) + 1).cast("int"))
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER)
    if near:
        x0, y0 = (F.col("l_partkey") % 4) * 3, (F.col("l_suppkey") % 4) * 3
        x1, y1 = x0 + 60 + F.col("l_quantity").cast("int") % 5, y0 + 40 + F.col("l_linenumber") % 3
    else:
        x0, y0 = F.col("l_partkey") % 60, F.col("l_suppkey") % 40
        x1, y1 = x0 + 40 + F.col("l_quantity"), y0 + 30 + F.round(F.col("l_discount") * 200)
    return line.select(
        F.col("l_orderkey").alias("page"), F.row_number().over(w).alias("index"), label.alias("label"), ((F.col("l_extendedprice") % 1000) / 1000).alias("score"),
        x0.cast("double").alias("xmin"), y0.cast("double").alias("ymin"), x1.cast("double").alias("xmax"), y1.cast("double").alias("ymax"),
    )


def _box(alias: str = "") -> Column:
    return G.box(*(F.col(f"{alias}{k}") for k in ("xmin", "ymin", "xmax", "ymax")))


def _sql_inter(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


def _sql_area(a: str) -> str:
    return f"(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"


@query(
    f"""WITH {BOXES} SELECT a.page, count(*) AS pairs, sum(CASE WHEN {_sql_inter('a', 'b')} / ({_sql_area('a')} + {_sql_area('b')} - {_sql_inter('a', 'b')}) > 0.5 THEN 1 ELSE 0 END)::BIGINT AS alike,
  sum(CASE WHEN {_sql_inter('a', 'b')} / least({_sql_area('a')}, {_sql_area('b')}) >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS overlapping, round(max({_sql_inter('a', 'b')} / {_sql_area('a')}), 6) AS most_cover
FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx GROUP BY a.page"""
)
def box_overlaps(spark, sf_dir):
    """Overlap measures of all pairs on a page. The pairs of a page are bounded by its boxes."""
    own = boxes(spark, sf_dir)
    pairs = own.alias("a").join(own.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.index") < F.col("b.index")))
    a, b = _box("a."), _box("b.")
    return pairs.groupBy(F.col("a.page").alias("page")).agg(
        F.count("*").alias("pairs"), F.sum((G.iou(a, b) > 0.5).cast("int")).alias("alike"), F.sum((G.overlap_ratio(a, b) >= 0.7).cast("int")).alias("overlapping"), F.round(F.max(G.cover_ratio(a, b)), 6).alias("most_cover")
    )


_IOU_FOLD = "greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0))"


@query(
    f"""WITH RECURSIVE {NEAR}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx) AS r FROM boxes),
fold AS (SELECT page, CAST(0 AS BIGINT) AS r, CAST([] AS STRUCT(idx INTEGER, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM (SELECT DISTINCT page FROM boxes)
  UNION ALL SELECT b.page, b.r, CASE WHEN len(list_filter(f.kept, lambda k: {_IOU_FOLD} / ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU_FOLD}) > 0.9)) > 0 THEN f.kept
    ELSE list_append(f.kept, struct_pack(idx := b.idx, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) END FROM fold f JOIN ranked b ON b.page = f.page AND b.r = f.r + 1)
SELECT page, CAST(len(arg_max(kept, r)) AS INTEGER) AS kept, CAST(list_sum(list_transform(arg_max(kept, r), lambda k: k.idx)) AS BIGINT) AS idx_sum FROM fold GROUP BY page"""
)
def greedy_suppression(spark, sf_dir):
    pages = L.pages_of(boxes(spark, sf_dir, near=True)).select("page", L.nms(F.col("boxes"), 0.9).alias("b"))
    return pages.select("page", F.size("b").alias("kept"), F.aggregate("b", F.lit(0).cast("long"), lambda acc, x: acc + x["index"]).alias("idx_sum"))


@query(
    f"""WITH {BOXES} SELECT page, idx AS index, label FROM boxes WHERE score >= 0.45 AND label <> 'reference' AND score >= CASE WHEN label IN ('display_formula', 'inline_formula', 'doc_title', 'paragraph_title', 'text') THEN CASE label WHEN 'doc_title' THEN 0.4 ELSE 0.4 END
  WHEN label = 'seal' THEN 0.45 ELSE 0.5 END AND ((x1 - x0 >= 6 AND y1 - y0 >= 6) OR label = 'inline_formula')"""
)
def confident_boxes(spark, sf_dir):
    return L.large_enough(L.without_references(L.class_confident(L.confident(boxes(spark, sf_dir))))).select("page", "index", "label")


_PARENT = "('display_formula', 'inline_formula', 'formula_number', 'reference')"


@query(
    f"""WITH {BOXES} SELECT a.page, a.idx AS index, CASE WHEN a.label NOT IN ('display_formula', 'inline_formula') THEN a.label
  WHEN EXISTS (SELECT 1 FROM boxes p WHERE p.page = a.page AND p.label NOT IN {_PARENT} AND {_sql_inter('a', 'p')} / {_sql_area('a')} >= 0.7) THEN 'inline_formula' ELSE 'display_formula' END AS label FROM boxes a"""
)
def formulas_relabelled(spark, sf_dir):
    pages = L.pages_of(boxes(spark, sf_dir))
    return L.rows_of(pages.select("page", L.relabel_formulas(F.col("boxes")).alias("boxes"))).select("page", "index", "label")


@query(
    f"""WITH {BOXES} SELECT a.page, a.idx AS index, CASE WHEN a.label NOT IN {L.REGIONS!r} AND EXISTS (SELECT 1 FROM boxes n WHERE n.page = a.page AND n.label = 'footnote' AND a.y0 >= n.y0
  AND greatest(0, least(n.x1, a.x1) - greatest(n.x0, a.x0)) / (a.x1 - a.x0) >= 0.7) THEN 'footnote' ELSE a.label END AS label FROM boxes a"""
)
def footnotes_relabelled(spark, sf_dir):
    pages = L.pages_of(boxes(spark, sf_dir))
    return L.rows_of(pages.select("page", L.relabel_footnotes(F.col("boxes")).alias("boxes"))).select("page", "index", "label")


@query(
    f"""WITH {BOXES} SELECT a.page, a.idx AS index, CASE WHEN EXISTS (SELECT 1 FROM boxes d WHERE d.page = a.page AND d.label = 'doc_title' AND {_sql_inter('a', 'd')} / least({_sql_area('a')}, {_sql_area('d')}) >= 0.8)
  THEN 'doc_title' ELSE 'paragraph_title' END AS type FROM boxes a WHERE a.label IN ('doc_title', 'paragraph_title')"""
)
def titles_split(spark, sf_dir):
    own = boxes(spark, sf_dir)
    blocks = own.where(F.col("label").isin("doc_title", "paragraph_title")).select("page", F.col("index").alias("id"), F.lit("title").alias("type"), "xmin", "ymin", "xmax", "ymax")
    return L.title_split(blocks, own).select("page", F.col("id").alias("index"), "type")


@query(
    f"""WITH {BOXES}, p AS (SELECT a.page, a.idx AS index, b.idx AS outer_index, row_number() OVER (PARTITION BY a.page, a.idx ORDER BY {_sql_inter('a', 'b')} / {_sql_area('a')} DESC, {_sql_area('b')}, b.idx) AS r
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.label = 'seal' AND b.label = 'table' AND {_sql_inter('a', 'b')} / {_sql_area('a')} >= 0.6) SELECT page, index, outer_index FROM p WHERE r = 1"""
)
def images_in_tables(spark, sf_dir):
    own = boxes(spark, sf_dir).withColumn("id", F.col("index"))
    out = L.best_container(own.where("label = 'seal'"), own.where("label = 'table'"), 0.6)
    return out.select("page", F.col("id").alias("index"), F.col("outer_id").alias("outer_index"))


@query(f"WITH {BOXES} SELECT a.page, a.idx AS index FROM boxes a WHERE a.label = 'footnote' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = a.page AND b.label IN ('table', 'seal') AND {_sql_inter('a', 'b')} / {_sql_area('a')} >= 0.9)")
def captions_uncovered(spark, sf_dir):
    own = boxes(spark, sf_dir)
    return L.without_covered(own.where("label = 'footnote'"), own.where(F.col("label").isin("table", "seal"))).select("page", "index")


@query(
    f"""WITH {BOXES}, h AS (SELECT page, max(struct_pack(e := y1, i := idx)) AS m FROM boxes WHERE label = 'header' GROUP BY page), f AS (SELECT page, min(struct_pack(e := y0, i := idx)) AS m FROM boxes WHERE label = 'footer' GROUP BY page)
SELECT p.page, h.m.e AS header_edge, h.m.i AS header_index, f.m.e AS footer_edge, f.m.i AS footer_index FROM (SELECT DISTINCT page FROM boxes) p LEFT JOIN h USING (page) LEFT JOIN f USING (page)"""
)
def margin_anchors(spark, sf_dir):
    pages = L.pages_of(boxes(spark, sf_dir)).select("page", L.lowest(F.col("boxes"), ("header",)).alias("h"), L.highest(F.col("boxes"), ("footer",)).alias("f"))
    return pages.select("page", F.col("h.ymax").alias("header_edge"), F.col("h.index").alias("header_index"), F.col("f.ymin").alias("footer_edge"), F.col("f.index").alias("footer_index"))


_APART = "(a.label <> b.label AND (a.visual OR b.visual) AND NOT ((a.label = 'table' OR b.label = 'table') AND NOT (a.visual AND b.visual)))"


_FILTERED = f"""v AS (SELECT *, label IN ('image', 'table', 'seal', 'chart') AS visual, label = 'inline_formula' AS inl, row_number() OVER (PARTITION BY page ORDER BY idx) AS i FROM boxes WHERE label <> 'reference'),
l AS (SELECT a.page, a.i, any_value(least(a.x1 - a.x0, a.y1 - a.y0) < 6 AND NOT a.inl) AS speck,
  coalesce(list(struct_pack(j := b.i, own := {_sql_area('a')} < {_sql_area('b')}) ORDER BY b.i) FILTER (b.i IS NOT NULL AND NOT a.inl AND NOT b.inl AND {_sql_inter('a', 'b')} / least({_sql_area('a')}, {_sql_area('b')}) > 0.7 AND NOT {_APART}), []) AS p
  FROM v a LEFT JOIN v b ON a.page = b.page AND b.i > a.i GROUP BY a.page, a.i),
r AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone FROM v
  UNION ALL SELECT page, i, CASE WHEN list_contains(gone, i) THEN gone WHEN speck THEN list_append(gone, i)
    WHEN len(ends) > 0 THEN list_concat(gone, [x.j FOR x IN live IF NOT x.own AND x.j < ends[1].j], [i]) ELSE list_concat(gone, [x.j FOR x IN live]) END
  FROM (SELECT *, [x FOR x IN live IF x.own] AS ends FROM (SELECT l.page, l.i, gone, speck, [x FOR x IN p IF NOT list_contains(gone, x.j)] AS live FROM r JOIN l ON l.page = r.page AND l.i = r.i + 1))),
filtered AS (SELECT v.page, CAST(row_number() OVER (PARTITION BY v.page ORDER BY v.i) AS INTEGER) AS idx, label, CAST(score AS DOUBLE) AS score, x0, y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1
  FROM v JOIN (SELECT page, max_by(gone, i) AS gone FROM r GROUP BY page) g ON g.page = v.page WHERE NOT list_contains(gone, v.i))"""


@query(f"WITH RECURSIVE {BOXES}, {_FILTERED} SELECT page, idx AS index, label, x0 AS xmin, y0 AS ymin FROM filtered")
def overlap_filtered(spark, sf_dir):
    return L.rows_of(L.pages_of(boxes(spark, sf_dir)).withColumn("boxes", L.overlap_filter("boxes"))).select("page", "index", "label", "xmin", "ymin")


def _common(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0)) * greatest(0, least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"



def _merged(table: str) -> str:
    return f"""g AS (SELECT page, list(struct_pack(idx := idx, label := label, score := CAST(score AS DOUBLE), x0 := CAST(x0 AS DOUBLE), y0 := CAST(y0 AS DOUBLE), x1 := CAST(x1 AS DOUBLE), y1 := CAST(y1 AS DOUBLE)) ORDER BY idx) AS s FROM {table} GROUP BY page),
mr AS (SELECT page, 0 AS k, s FROM g
  UNION ALL SELECT page, k + 1, list_transform(list_filter(range(1, len(s) + 1), lambda x: x <> low), lambda x: CASE WHEN x = keep THEN struct_pack(idx := s[x].idx, label := s[x].label, score := CAST(format('{{:.4f}}', greatest(a.score, b.score)) AS DOUBLE),
      x0 := floor(least(a.x0, b.x0)), y0 := floor(least(a.y0, b.y0)), x1 := ceil(greatest(a.x1, b.x1)), y1 := ceil(greatest(a.y1, b.y1))) ELSE s[x] END)
  FROM (SELECT *, CASE WHEN other THEN p.j ELSE p.i END AS keep, CASE WHEN other THEN p.i ELSE p.j END AS low
  FROM (SELECT *, {_sql_area('b')} > {_sql_area('a')} OR ({_sql_area('b')} = {_sql_area('a')} AND b.score > a.score) AS other
  FROM (SELECT *, s[p.i] AS a, s[p.j] AS b FROM (SELECT page, k, s, list_filter(flatten(list_transform(range(1, len(s) + 1), lambda i: list_transform(range(i + 1, len(s) + 1), lambda j: struct_pack(i := i, j := j)))),
    lambda p: s[p.i].label IN ('inline_formula', 'display_formula') AND s[p.j].label IN ('inline_formula', 'display_formula')
      AND {_common('s[p.i]', 's[p.j]')} >= 0.7 * least({_sql_area('s[p.i]')}, {_sql_area('s[p.j]')}))[1] AS p FROM mr) WHERE p IS NOT NULL)))),
merged AS (SELECT page, b.idx AS idx, b.label AS label, b.score AS score, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1 FROM (SELECT page, unnest(max_by(s, k)) AS b FROM mr GROUP BY page))"""


@query(f"WITH RECURSIVE {BOXES}, {_merged('boxes')} SELECT page, idx AS index, label, score, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM merged")
def formulas_merged(spark, sf_dir):
    return L.rows_of(L.pages_of(boxes(spark, sf_dir)).withColumn("boxes", L.merge_nested("boxes")))


_IN = lambda *labels: "(" + ", ".join(f"'{x}'" for x in labels) + ")"


def _best(name: str, source: str, where: str, order: str) -> str:
    """One anchor for each page, or none."""
    return f"{name} AS (SELECT * FROM {source} WHERE {where} QUALIFY row_number() OVER (PARTITION BY page ORDER BY {order}) = 1)"


_ROW = "page, idx, score, x0, y0, x1, y1"
_A_ROW = ", ".join(f"a.{c}" for c in _ROW.split(", "))
#: The margins, a table for each step, over `named` boxes of pages with two boxes or more.
_MARGINS = f"""halved AS (SELECT {_ROW}, CASE WHEN n < 2 THEN label WHEN (y0 + y1) / 2 < {PAGE_H / 2} THEN CASE label WHEN 'footer' THEN 'header' WHEN 'footer_image' THEN 'header_image' ELSE label END
  ELSE CASE label WHEN 'header' THEN 'footer' WHEN 'header_image' THEN 'footer_image' ELSE label END END AS label, n FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM named)),
{_best("head", "halved", f"label IN {_IN(*L.HEADERS)}", "y1 DESC, idx DESC")}, {_best("foot", "halved", f"label IN {_IN(*L.FOOTERS)}", "y0, idx")},
m1 AS (SELECT {_A_ROW}, a.n, a.label IN {_IN(*L.HEADERS, *L.FOOTERS)} AS anchor, CASE WHEN a.n > 1 AND a.label NOT IN {_IN(*L.EXEMPT, *L.HEADERS)} AND a.y1 <= head.y1 THEN 'header' ELSE a.label END AS label FROM halved a LEFT JOIN head ON head.page = a.page),
m2 AS (SELECT {_A_ROW}, a.n, a.anchor, CASE WHEN a.n > 1 AND a.label NOT IN {_IN(*L.REGIONS)} AND EXISTS (SELECT 1 FROM m1 k WHERE k.page = a.page AND k.label = 'footnote' AND a.y0 >= k.y0
  AND greatest(0, least(k.x1, a.x1) - greatest(k.x0, a.x0)) / (a.x1 - a.x0) >= 0.7) THEN 'footnote' ELSE a.label END AS label FROM m1 a),
m3 AS (SELECT {_A_ROW}, a.n, a.anchor, CASE WHEN a.n > 1 AND a.label NOT IN {_IN(*L.EXEMPT, *L.FOOTERS)} AND a.y0 >= foot.y0 AND ((foot.x1 - foot.x0) / {PAGE_W} >= 0.7
  OR greatest(0, least(foot.x1, a.x1) - greatest(foot.x0, a.x0)) / least(foot.x1 - foot.x0, a.x1 - a.x0) >= 0.3) THEN 'footer' ELSE a.label END AS label FROM m2 a LEFT JOIN foot ON foot.page = a.page),
{_best('"first"', "m3", f"label = 'number' AND (y0 + y1) / 2 <= {PAGE_H} * 0.3", "y1 DESC, idx DESC")}, {_best('"last"', "m3", f"label = 'number' AND (y0 + y1) / 2 > {PAGE_H} * 0.3 AND (y0 + y1) / 2 >= {PAGE_H} * 0.7", "y0, idx")},
m4 AS (SELECT {_A_ROW}, a.n, a.anchor, CASE WHEN a.n > 1 AND NOT a.anchor AND a.label NOT IN {_IN(*L.EXEMPT)} AND a.y1 <= f.y0 THEN 'header' ELSE a.label END AS label FROM m3 a LEFT JOIN "first" f ON f.page = a.page),
m5 AS (SELECT {_A_ROW}, CASE WHEN a.n > 1 AND NOT a.anchor AND a.label NOT IN {_IN(*L.EXEMPT)} AND a.y0 >= l.y1 THEN 'footer' ELSE a.label END AS label FROM m4 a LEFT JOIN "last" l ON l.page = a.page)"""


@query(
    f"""WITH RECURSIVE {BOXES}, {_FILTERED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx) AS rank FROM filtered),
fold AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(idx INTEGER, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM filtered
  UNION ALL SELECT b.page, b.rank, CASE WHEN len(list_filter(f.kept, lambda k: {_IOU_FOLD} / ((k.x1 - k.x0) * (k.y1 - k.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU_FOLD}) > 0.9)) > 0 THEN f.kept
    ELSE list_append(f.kept, struct_pack(idx := b.idx, x0 := b.x0, y0 := b.y0, x1 := b.x1, y1 := b.y1)) END FROM fold f JOIN ranked b ON b.page = f.page AND b.rank = f.rank + 1),
alone AS (SELECT x.* FROM filtered x JOIN (SELECT page, [k.idx FOR k IN max_by(kept, rank)] AS ids FROM fold GROUP BY page) o ON o.page = x.page AND list_contains(o.ids, x.idx)), {_merged('alone')},
named AS (SELECT {_A_ROW}, CASE WHEN a.label NOT IN ('display_formula', 'inline_formula') THEN a.label
  WHEN EXISTS (SELECT 1 FROM merged p WHERE p.page = a.page AND p.label NOT IN {_PARENT} AND {_sql_inter('a', 'p')} / {_sql_area('a')} >= 0.7) THEN 'inline_formula' ELSE 'display_formula' END AS label FROM merged a), {_MARGINS}
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY idx) AS INTEGER) AS index, label, score, x0 AS xmin, y0 AS ymin, x1 AS xmax, y1 AS ymax FROM m5"""
)
def layout_post_process(spark, sf_dir):
    return L.rows_of(L.post_process(L.pages_of(boxes(spark, sf_dir)), F.lit(PAGE_W), F.lit(PAGE_H)))


@query(f"WITH {BOXES}, s AS (SELECT page, idx, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx * 25) AS rank FROM boxes) SELECT page, idx AS query, rank FROM s WHERE rank <= 2")
def detections_top_k(spark, sf_dir):
    own = boxes(spark, sf_dir).select("page", F.col("index").alias("query"), F.lit(0).alias("cls"), "score")
    return L.top_k(own, 2).select("page", "query", "rank")


@query(
    f"""WITH {BOXES}, p AS (SELECT a.page, a.idx AS i, b.idx AS j, a.score - b.score AS z FROM boxes a JOIN boxes b ON a.page = b.page AND a.idx < b.idx),
v AS (SELECT page, j AS box, 1 / (1 + exp(-z)) AS v FROM p UNION ALL SELECT page, i, 1 - 1 / (1 + exp(-z)) FROM p)
SELECT page, box, round(total, 6) AS votes, row_number() OVER (PARTITION BY page ORDER BY total, box) AS rank FROM (SELECT page, box, sum(v) AS total FROM v GROUP BY page, box)"""
)
def reading_order_votes(spark, sf_dir):
    own = boxes(spark, sf_dir)
    pairs = own.alias("a").join(own.alias("b"), (F.col("a.page") == F.col("b.page")) & (F.col("a.index") != F.col("b.index")))
    return L.vote_rank(pairs.select("a.page", F.col("a.index").alias("i"), F.col("b.index").alias("j"), (F.col("a.score") - F.col("b.score")).alias("logit"))).select("page", "box", F.round("votes", 6).alias("votes"), "rank")


@query(f"WITH {BOXES} SELECT page, idx AS index, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN score >= 0.5 THEN 0 ELSE 1 END, idx) AS position FROM boxes")
def kept_first_order(spark, sf_dir):
    return L.kept_first(boxes(spark, sf_dir), F.col("score") >= 0.5).select("page", "index", "position")


@query(
    f"""WITH {BOXES}, u AS (SELECT page, idx, label, least(1, greatest(0, x0 / {PAGE_W})) AS a, least(1, greatest(0, y0 / {PAGE_H})) AS b, least(1, greatest(0, x1 / {PAGE_W})) AS c, least(1, greatest(0, y1 / {PAGE_H})) AS d FROM boxes)
SELECT page, idx AS index, CASE label WHEN 'display_formula' THEN 'equation' WHEN 'footnote' THEN 'page_footnote' WHEN 'number' THEN 'page_number' WHEN 'doc_title' THEN 'title' WHEN 'paragraph_title' THEN 'title' WHEN 'seal' THEN 'image' ELSE label END AS type,
  CASE WHEN label = 'seal' THEN 'seal' END AS sub_type, round(c - a, 1) AS width FROM u WHERE label <> 'inline_formula' AND c > a AND d > b"""
)
def content_blocks(spark, sf_dir):
    own = B.build_blocks(boxes(spark, sf_dir), F.lit(PAGE_W), F.lit(PAGE_H))
    # widths at one digit: rounding of the corners at three digits is Python's, which SQL does not have
    unit = F.least(F.lit(1.0), F.col("xmax") / PAGE_W) - F.least(F.lit(1.0), F.col("xmin") / PAGE_W)
    return own.select("page", "index", "type", "sub_type", F.round(unit, 1).alias("width"))


@query(
    f"""WITH {BOXES} SELECT page, idx AS index, CAST(least(120, greatest(0, floor(x0 / 3))) AS INTEGER) AS xmin, CAST(least(80, greatest(0, floor(y0 / 3))) AS INTEGER) AS ymin, CAST(least(120, greatest(0, ceil(x1 / 3))) AS INTEGER) AS xmax, CAST(least(80, greatest(0, ceil(y1 / 3))) AS INTEGER) AS ymax FROM boxes"""
)
def clipped_boxes(spark, sf_dir):
    own = boxes(spark, sf_dir)
    c = G.clip(G.box(*(F.col(k) / 3 for k in ("xmin", "ymin", "xmax", "ymax"))), F.lit(120), F.lit(80))
    return own.select("page", "index", c.alias("c")).where("c IS NOT NULL").select("page", "index", "c.*")


@query(f"WITH {BOXES} SELECT page, idx AS index, (x0 / 150 - y0 / 300) * 800 AS xmin, (x0 / 150 + y0 / 300) * 800 AS xmax FROM boxes")
def boxes_from_centres(spark, sf_dir):
    c = G.from_centre(F.col("xmin") / 150, F.lit(0.5), F.col("ymin") / 150, F.lit(0.5), F.lit(800), F.lit(1000))
    return boxes(spark, sf_dir).select("page", "index", c["xmin"].alias("xmin"), c["xmax"].alias("xmax"))


@query(f"WITH {BOXES} SELECT page, idx AS index, x0 / 60 * CASE WHEN x0 <= 60 THEN 200 ELSE 1 END AS left, CAST(CASE WHEN idx % 5 = 0 THEN 90 ELSE 0 END AS INTEGER) AS angle FROM boxes WHERE x0 > 0 AND y0 > 0")
def boxes_to_pixels(spark, sf_dir):
    own = boxes(spark, sf_dir).where("xmin > 0 AND ymin > 0")
    values = F.array(F.lit("1.0"), F.lit("true"), (F.col("xmin") / 60).cast("string"), F.lit("0"))
    p = G.to_pixels(values, F.lit(200), F.lit(100))
    angle = G.norm_angle(F.when(F.col("index") % 5 == 0, "90").when(F.col("index") % 5 == 1, "45").otherwise("x"))
    return own.select("page", "index", F.coalesce(p["xmin"], F.lit(200.0)).alias("left"), angle.alias("angle"))


@query(
    f"""WITH {BOXES}, s AS (SELECT page, idx, x1 * 7 AS w, y1 * 11 AS h FROM boxes) SELECT page, idx AS index, CAST(round_even(h / 28, 0) * 28 AS INTEGER) AS height, CAST(round_even(w / 28, 0) * 28 AS INTEGER) AS width FROM s WHERE round_even(h / 28, 0) * 28 * round_even(w / 28, 0) * 28 BETWEEN 3136 AND 1003520"""
)
def smart_sizes(spark, sf_dir):
    own = boxes(spark, sf_dir).withColumn("s", G.smart_resize(F.col("ymax") * 11, F.col("xmax") * 7))
    plain = F.rint(F.col("ymax") * 11 / 28) * 28 * F.rint(F.col("xmax") * 7 / 28) * 28
    return own.where(plain.between(3136, 1003520)).select("page", "index", "s.height", "s.width")


@query(
    """SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 6) AS confidence FROM embeddings"""
)
def vector_measures(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    best = scoring.argmax_first(F.col("v"))
    return table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(scoring.vector_sum(F.col("v")), 6).alias("total"), F.round(scoring.l2_norm(F.col("v")), 6).alias("norm"), best.alias("best"), F.round(scoring.softmax_at(F.col("v"), best), 6).alias("confidence"))


@query(
    """WITH b AS (SELECT conv_id AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, list_extract(['text', 'equation', 'formula_number', 'equation', 'formula_number', 'formula_number'], CAST((conv_id + turn) % 6 + 1 AS BIGINT)) AS type,
  CASE WHEN (conv_id * 7 + turn) % 11 = 0 THEN '' ELSE 'f' || turn END AS content FROM conversations),
w AS (SELECT *, lag(type) OVER o AS bt, lead(type) OVER o AS at_, lead(type, 2) OVER o AS tt, lag(content) OVER o AS bc, lead(content) OVER o AS ac FROM b WINDOW o AS (PARTITION BY page ORDER BY idx)),
u AS (SELECT *, type = 'formula_number' AND ((bt = 'equation' AND bc <> '') OR (coalesce(bt, '') <> 'equation' AND at_ = 'equation' AND coalesce(tt, '') <> 'formula_number' AND ac <> '')) AS used, bt = 'equation' AS back FROM w),
x AS (SELECT *, lag(used) OVER o AND NOT coalesce(lag(back) OVER o, false) AS from_b, lead(used) OVER o AND coalesce(lead(back) OVER o, false) AS from_a FROM u WINDOW o AS (PARTITION BY page ORDER BY idx))
SELECT page, idx, CASE WHEN type = 'formula_number' THEN 'text' ELSE type END AS type, CASE WHEN type = 'equation' THEN content || CASE WHEN coalesce(from_b, false) THEN '\\tag{' || bc || '}' ELSE '' END || CASE WHEN coalesce(from_a, false) THEN '\\tag{' || ac || '}' ELSE '' END ELSE content END AS content
FROM x WHERE NOT coalesce(used, false)"""
)
def formula_numbers_attached(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    kinds = F.array(*map(F.lit, ["text", "equation", "formula_number", "equation", "formula_number", "formula_number"]))
    own = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("page"), F.row_number().over(w).cast("long").alias("idx"), F.element_at(kinds, ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int")).alias("type"),
        F.when((F.col("conv_id") * 7 + F.col("turn")) % 11 == 0, "").otherwise(F.concat(F.lit("f"), F.col("turn").cast("string"))).alias("content"),
    )
    return B.attach_numbers(own)


@query("SELECT o_orderstatus AS status, count(*) AS n, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS DOUBLE) AS progress FROM orders GROUP BY o_orderstatus")
def status_progress(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return own.withColumn("progress", B.progress(F.when(F.col("status") == "F", "completed").otherwise("queued")))


@query("SELECT doc_id, lang IN ('de', 'fr') AS skipped, CAST(CASE WHEN lang = 'en' THEN 0.005 ELSE 0.05 END AS DOUBLE) AS penalty FROM documents")
def extract_plan(spark, sf_dir):
    kind = F.when(F.col("lang") == "de", "image").when(F.col("lang") == "fr", "list").otherwise("table")
    own = table(spark, sf_dir, "documents")
    return own.select("doc_id", B.skip_extract(kind).alias("skipped"), B.sampling(F.when(F.col("lang") == "en", "table").otherwise("text"))["frequency"].alias("penalty"))
