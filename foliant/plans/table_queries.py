"""Queries over token grids. Grids are made from order lines: a table is an order, a row for each line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tables as T
from .base import query, table

# each row: a filled cell, then one that goes on from it, up or is filled, then an empty one for odd lines
_ROWS = """lines AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS r, l_partkey AS a,
  CASE WHEN l_suppkey % 3 = 0 THEN 'l' WHEN l_suppkey % 3 = 1 THEN 'u' ELSE 'f' END AS k, l_suppkey AS b, l_linenumber % 2 = 1 AS extra FROM lineitem)"""


def grids(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    k = F.col("l_suppkey") % 3
    middle = F.when(k == 0, "<lcel>").when((k == 1) & (F.col("r") > 0), "<ucel>").when(k == 1, "<ecel>").otherwise(F.concat(F.lit("<fcel>"), F.col("l_suppkey").cast("string")))
    own = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w) - 1)
    row = F.concat(F.lit("<fcel>"), F.col("l_partkey").cast("string"), middle, F.when(F.col("l_linenumber") % 2 == 1, "<ecel>").otherwise(""), F.lit("<nl>"))
    rows = own.select("l_orderkey", "r", row.alias("row")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", "row"))).alias("g"))
    return rows.select(F.col("l_orderkey").alias("table_id"), F.array_join(F.transform("g", lambda x: x["row"]), "").alias("otsl"))


_CELLS = f"""WITH {_ROWS}, m AS (SELECT l_orderkey, max(CASE WHEN extra THEN 3 ELSE 2 END) AS cols, count(*) AS n FROM lines GROUP BY 1),
g AS (SELECT l_orderkey, r, 0 AS c, 'f' AS k, CAST(a AS VARCHAR) AS t FROM lines UNION ALL SELECT l_orderkey, r, 1, CASE WHEN k = 'u' AND r = 0 THEN 'e' ELSE k END, CASE WHEN k = 'f' THEN CAST(b AS VARCHAR) ELSE '' END FROM lines
  UNION ALL SELECT l_orderkey, r, 2, 'e', '' FROM lines JOIN m USING (l_orderkey) WHERE cols = 3),
d AS (SELECT *, sum(CASE WHEN k <> 'u' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey, c ORDER BY r) AS run FROM g),
s AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, c, run) AS down, coalesce(CASE WHEN c = 0 THEN lead(k) OVER (PARTITION BY l_orderkey, r ORDER BY c) = 'l' END, false) AS wide FROM d)"""


@query(f"{_CELLS} SELECT l_orderkey AS table_id, CAST(r AS INTEGER) AS start_row, CAST(c AS INTEGER) AS start_col, CAST(down AS INTEGER) AS row_span, CAST(CASE WHEN wide THEN 2 ELSE 1 END AS INTEGER) AS col_span, t AS text FROM s WHERE k IN ('f', 'e')")
def otsl_cells(spark, sf_dir):
    return T.otsl_cells(grids(spark, sf_dir))


@query(
    f"""{_CELLS}, h AS (SELECT l_orderkey, r, string_agg('<td' || CASE WHEN down > 1 THEN ' rowspan="' || down || '"' ELSE '' END || CASE WHEN wide THEN ' colspan="2"' ELSE '' END || '>' || t || '</td>', '' ORDER BY c) AS tr FROM s WHERE k IN ('f', 'e') GROUP BY ALL)
SELECT l_orderkey AS table_id, '<table>' || string_agg('<tr>' || tr || '</tr>', '' ORDER BY r) || '</table>' AS html FROM h GROUP BY 1"""
)
def otsl_html(spark, sf_dir):
    return T.otsl_html(grids(spark, sf_dir))


@query(f"{_CELLS} SELECT l_orderkey AS table_id, r AS row, down AS row_span, CASE WHEN wide THEN 2 ELSE 1 END AS col_span, t AS text FROM s WHERE k IN ('f', 'e')")
def html_grid(spark, sf_dir):
    """Back from markup to a grid. Columns are left out: a row that goes on up into a wide cell moves in markup."""
    html = T.otsl_html(grids(spark, sf_dir))
    return html.select("table_id", F.inline(T.html_grid(F.col("html")))).select("table_id", "row", "row_span", "col_span", "text")


@query("SELECT p_partkey AS idx, p_brand AS book, CASE WHEN row_number() OVER w = 1 THEN left(s, 31) ELSE left(left(s, 31), CAST(31 - length('_' || row_number() OVER w) AS BIGINT)) || '_' || row_number() OVER w END AS sheet FROM (SELECT *, regexp_replace(p_name || p_type, '[:\\\\/?*\\[\\]]', '', 'g') AS s FROM part) WINDOW w AS (PARTITION BY p_brand, lower(left(s, 31)) ORDER BY p_partkey)")
def sheet_names(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_brand").alias("book"), F.concat("p_name", "p_type").alias("name"))
    return T.unique_names(own).select("idx", "book", "sheet")


_TRIM = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"


@query(f"SELECT doc_id, md5('a <eq>' || {_TRIM} || '</eq> b <eq>' || text || '</eq> ' || lang) AS marked, md5('a  $' || {_TRIM} || '$  b') AS shown FROM documents")
def table_formulas(spark, sf_dir):
    """Whole texts as formulas."""
    text = F.col("text")
    own = F.concat(F.lit("a \\("), text, F.lit("\\) b <eq>"), text, F.lit("</eq> "), F.col("lang"))
    shown = X.embedded_table(F.concat(F.lit("a <eq>"), X.trim_all(text), F.lit("</eq> b")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.formula_delimiters(own).cast("binary")).alias("marked"), F.md5(shown.cast("binary")).alias("shown"))


@query(
    f"""SELECT doc_id, md5({_TRIM}) AS formula, md5('p $x' || replace(replace(replace(translate(text, '$' || chr(10), '--'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '$ c<d') AS escaped FROM documents"""
)
def latex_spans(spark, sf_dir):
    """Whole texts as isolated formulas, and as formulas whose signs are escaped."""
    text = F.col("text")
    line = F.concat(F.lit("p $x"), F.translate(text, "$\n", "--"), F.lit("$ c<d"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.isolated_formula(F.concat(F.lit("\\[ "), text, F.lit(" \\]"))).cast("binary")).alias("formula"), F.md5(X.escape_latex(line).cast("binary")).alias("escaped"))


@query(f"SELECT doc_id, md5({_TRIM}) AS code FROM documents")
def code_fences(spark, sf_dir):
    """Whole texts in fences, every other one closed."""
    closing = F.when(F.col("doc_id") % 2 == 0, "\r\n```  \n").otherwise("\n")
    # dealt out first: a file is read by as many tasks as it has row groups, which may be one
    own = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return own.select("doc_id", F.md5(X.code_content(F.concat(F.lit("```python\n  "), "text", closing)).cast("binary")).alias("code"))


@query(
    f"""{_CELLS}, h AS (SELECT l_orderkey, r, string_agg('<td' || CASE WHEN down > 1 THEN ' rowspan="' || down || '"' ELSE '' END || CASE WHEN wide THEN ' colspan="2"' ELSE '' END || '>' || t || '</td>', '' ORDER BY c) AS tr FROM s WHERE k IN ('f', 'e') GROUP BY ALL),
block AS (SELECT l_orderkey AS id, '<table>' || string_agg('<tr>' || tr || '</tr>', '' ORDER BY r) || '</table>' AS content FROM h GROUP BY 1)
SELECT id, 'table' AS type, content FROM block WHERE id % 3 > 0 UNION ALL SELECT DISTINCT l_orderkey, 'text', '<fcel>' || l_orderkey FROM lineitem WHERE l_orderkey % 3 = 0"""
)
def table_blocks(spark, sf_dir):
    """Blocks of a page: tables become markup, texts stay as they are, whatever they hold."""
    own = grids(spark, sf_dir).select(F.col("table_id").alias("id"), F.when(F.col("table_id") % 3 > 0, "table").otherwise("text").alias("type"), "otsl")
    return T.table_blocks(own.select("id", "type", F.when(F.col("type") == "table", F.col("otsl")).otherwise(F.concat(F.lit("<fcel>"), F.col("id").cast("string"))).alias("content")))


@query("SELECT conv_id, CASE WHEN count(*) FILTER (role = 'user') > 0 THEN list(text ORDER BY turn) FILTER (role = 'user') WHEN count(*) FILTER (role = 'system') > 0 THEN list(text ORDER BY turn) FILTER (role = 'system') ELSE ['none'] END AS sheets FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def workbook_tables(spark, sf_dir):
    """Sheets of a workbook from the first source that has any."""
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"])
    own = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(of("user").alias("content"), of("system").alias("markdown"))
    return own.select("conv_id", T.sheet_tables(F.col("content"), F.col("markdown"), F.lit("none")).alias("sheets"))
