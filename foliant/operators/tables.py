"""Tables from token grids, and grids from table markup."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .layout import let

# Tokens of a grid: row end, filled cell, empty cell, goes on left, up, both.
TOKENS = ["<nl>", "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>"]
_CELL_TOKEN = "<(?:fcel|ecel|lcel|ucel|xcel)>"


def tokens(c: Column) -> Column:
    """Array of (token, text that follows it) of a row: its tokens, and what stands between them."""
    texts = F.split(c, _CELL_TOKEN)  # the first one stands before any token
    return F.zip_with(F.regexp_extract_all(c, F.lit(_CELL_TOKEN), 0), F.slice(texts, F.lit(2), F.size(texts) - 1), lambda k, t: F.struct(k.alias("token"), X.trim_all(t).alias("text")))


def grid(c: Column) -> Column:
    """Rows of (token, text); short rows are filled with empty cells, a row end before any row begins none."""
    empty = F.struct(F.lit("<ecel>").alias("token"), F.lit("").alias("text"))

    def begun(rows: Column) -> Column:
        """Without the rows before the first that has a cell, and without a last one that has none."""
        first = F.array_min(F.transform(rows, lambda r, i: F.when(F.size(r) > 0, i + 1)))
        last = F.size(rows) - F.when(F.size(F.element_at(rows, -1)) > 0, 0).otherwise(1)
        return F.slice(rows, F.coalesce(first, F.lit(1)), F.when(first.isNull(), 0).otherwise(last - first + 1))

    def filled(rows: Column) -> Column:
        widest = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
        return let(F.struct(rows.alias("rows"), widest.alias("widest")), lambda g: F.transform(g["rows"], lambda r: F.concat(r, F.array_repeat(empty, g["widest"] - F.size(r)))))

    return let(let(F.transform(F.split(c, "<nl>"), tokens), begun), filled)


_CELL = T.StructType([T.StructField(n, k) for n, k in (("token", T.StringType()), ("text", T.StringType()), ("row_span", T.IntegerType()), ("col_span", T.IntegerType()))])
_NUMBERS = T.ArrayType(T.IntegerType())


def _runs(values: Column, start: Column, step) -> Column:
    """For each value from the last to the first what `step` has made of those after it, in the order of the values."""
    kind = T.ArrayType(_NUMBERS) if step.__name__ == "down" else _NUMBERS
    state = F.struct(start.alias("run"), F.array().cast(kind).alias("out"))
    return F.reverse(F.aggregate(F.reverse(values), state, lambda s, v: F.struct(step(s["run"], v).alias("run"), F.concat(s["out"], F.array(s["run"])).alias("out")), lambda s: s["out"]))


def spanned(c: Column) -> Column:
    """The grid's rows as arrays of (token, text, row_span, col_span): spans are runs of tokens that go on to the right
    and down, counted from the end of each row and from the last row up."""

    def right(run: Column, cell: Column) -> Column:
        return F.when(cell["token"].isin("<lcel>", "<xcel>"), run + 1).otherwise(0)

    def down(runs: Column, row: Column) -> Column:
        return F.zip_with(runs, row, lambda n, cell: F.when(cell["token"].isin("<ucel>", "<xcel>"), n + 1).otherwise(0))

    def rows(g: Column) -> Column:
        below = _runs(g, F.transform(F.get(g, 0), lambda x: F.lit(0)), down)
        cell = lambda x, n: F.struct(x["cell"]["token"].alias("token"), F.when(x["cell"]["token"] == "<ecel>", "").otherwise(x["cell"]["text"]).alias("text"), (1 + n).alias("row_span"), (1 + x["n"]).alias("col_span"))
        with_right = lambda row: F.zip_with(row, _runs(row, F.lit(0), right), lambda x, n: F.struct(x.alias("cell"), n.alias("n")))
        return F.when(F.size(g) > 0, F.zip_with(g, below, lambda row, ns: F.zip_with(with_right(row), ns, cell))).otherwise(F.array().cast(T.ArrayType(T.ArrayType(_CELL))))

    return let(grid(c), rows)


def _is_cell(x: Column) -> Column:
    return x["token"].isin("<fcel>", "<ecel>")


def otsl_cells(tables: DataFrame, table_id: str = "table_id", otsl: str = "otsl") -> DataFrame:
    """A row for each cell: table_id, start_row, start_col, row_span, col_span, text."""
    rows = tables.select(table_id, F.posexplode(spanned(F.col(otsl))).alias("start_row", "row"))
    cells = rows.select(table_id, "start_row", F.posexplode("row").alias("start_col", "cell")).where(_is_cell(F.col("cell")))
    return cells.select(table_id, "start_row", "start_col", "cell.row_span", "cell.col_span", "cell.text")


# What `trim_all` takes for white space, in Python's terms.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_TOKEN = re.compile(f"({_CELL_TOKEN})")


def markup_of(otsl: str | None) -> str:
    """The markup of one table's tokens: the rules of `spanned`, a row at a time from the last one up."""
    if otsl is None:
        return ""
    if otsl.startswith("<table") and otsl.endswith("</table>"):
        return otsl
    rows = [_TOKEN.split(r) for r in otsl.split("<nl>")]  # what stands before any token, then tokens and texts in turn
    begin = next((k for k, r in enumerate(rows) if len(r) > 1), len(rows))
    rows = rows[begin : len(rows) - (len(rows[-1]) == 1)]
    widest = max((len(r) // 2 for r in rows), default=0)
    below, lines = [0] * widest, []
    for r in reversed(rows):
        right, cells = 0, []
        for k in range(widest - 1, -1, -1):
            token = r[2 * k + 1] if 2 * k + 1 < len(r) else "<ecel>"
            if token in ("<fcel>", "<ecel>"):
                down = f' rowspan="{below[k] + 1}"' if below[k] else ""
                across = f' colspan="{right + 1}"' if right else ""
                text = escape(r[2 * k + 2].strip(_WHITE)) if token == "<fcel>" else ""
                cells.append(f"<td{down}{across}>{text}</td>")
            right = right + 1 if token in ("<lcel>", "<xcel>") else 0
            below[k] = below[k] + 1 if token in ("<ucel>", "<xcel>") else 0
        if cells or lines:
            lines.append("<tr>" + "".join(reversed(cells)) + "</tr>")
    return "<table>" + "".join(reversed(lines)) + "</table>" if lines else ""


@F.arrow_udf(T.StringType())
def markup(tables: pa.Array) -> pa.Array:
    return pa.array([markup_of(t) for t in tables.to_pylist()], pa.string())


def otsl_html(tables: DataFrame, table_id: str = "table_id", otsl: str = "otsl") -> DataFrame:
    """table_id, html, within the table's own row. Markup passes through; no cell gives ''; rows end with the last that has a cell."""
    return tables.select(table_id, markup(F.col(otsl)).alias("html"))


def table_blocks(blocks: DataFrame) -> DataFrame:
    """Table blocks (id, type, content) with grid tokens as markup and formulas marked; other blocks untouched."""
    grid_tokens = F.when((F.col("type") == "table") & (F.coalesce(F.length("content"), F.lit(0)) > 0), F.col("content"))
    out = blocks.withColumn("grid_", grid_tokens).withColumn("html_", markup(F.col("grid_")))
    # few tables have formulas
    marked = F.when(F.contains("html_", F.lit("\\(")) | F.contains("html_", F.lit("\\[")), X.formula_delimiters(F.col("html_"))).otherwise(F.col("html_"))
    return out.withColumn("content", F.when(F.col("grid_").isNotNull(), marked).otherwise(F.col("content"))).drop("grid_", "html_")


class _Grid(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            a = dict(attrs)
            number = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and int(a[k]) > 0 else 1
            self.cell = ["", number("rowspan"), number("colspan")]
            self.tables[-1][-1].append(self.cell)
        elif tag == "br" and self.cell is not None:
            self.cell[0] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "th"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[0] += data


#: Markup as `markup_of` makes it; all else is for the parser.
_PLAIN = re.compile(r"<table>(?:<tr>(?:<td(?: rowspan=\"[1-9][0-9]{0,8}\")?(?: colspan=\"[1-9][0-9]{0,8}\")?>[^<&\r\0]*+</td>)*+</tr>)*+</table>")
_PLAIN_CELL = re.compile(r"<td(?: rowspan=\"([0-9]+)\")?(?: colspan=\"([0-9]+)\")?>([^<]*)</td>")


def cells_of(markup: str) -> list[list[list]]:
    """Of each table its rows of (text, row span, column span)."""
    if _PLAIN.fullmatch(markup):
        return [[[(text, int(down or 1), int(right or 1)) for down, right, text in _PLAIN_CELL.findall(r)] for r in markup.split("<tr>")[1:]]]
    parser = _Grid()
    parser.feed(markup)
    return parser.tables


def grid_of(markup: str) -> list[tuple[int, int, int, int, int, str]]:
    """(table, row, col, row_span, col_span, text) of each cell, placed in the first free place of its row."""
    out = []
    for k, rows in enumerate(cells_of(markup or "")):
        taken: set[tuple[int, int]] = set()
        for r, row in enumerate(rows):
            c = 0
            for text, down, right in row:
                while (r, c) in taken:
                    c += 1
                taken |= {(r + i, c + j) for i in range(down) for j in range(right)}
                out.append((k, r, c, down, right, text.strip()))
    return out


CELLS = "array<struct<table:int,row:int,col:int,row_span:int,col_span:int,text:string>>"


def html_grid(c: Column) -> Column:
    """Cells of the tables in a text of markup."""

    @F.arrow_udf(CELLS)
    def cells(texts: pa.Array) -> pa.Array:
        names, found, ends = ["table", "row", "col", "row_span", "col_span", "text"], [], [0]
        for t in texts.to_pylist():
            found += grid_of(t)
            ends.append(len(found))
        columns = [pa.array(c, pa.string() if n == "text" else pa.int32()) for n, c in zip(names, zip(*found) if found else [[]] * 6)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names))

    return cells(c)


def sheet_tables(content_tables: Column, markdown_tables: Column, text: Column) -> Column:
    """Tables of a workbook: those of the content list, else those of the Markdown, else one sheet of text."""
    return F.when(F.size(content_tables) > 0, content_tables).when(F.size(markdown_tables) > 0, markdown_tables).otherwise(F.array(text))


def sheet_name(c: Column) -> Column:
    """Without characters that names of sheets may not have, 31 characters at most."""
    return F.left(F.regexp_replace(c, r"[:\\/?*\[\]]", ""), F.lit(31))


def unique_names(sheets: DataFrame, name: str = "name", order: str = "idx", book: str = "book") -> DataFrame:
    """Names of a book made unique by _2, _3, ..., 31 characters at most."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(book, F.lower(sheet_name(F.col(name)))).orderBy(order))
    end = F.concat(F.lit("_"), n.cast("string"))
    own = sheet_name(F.col(name))
    return sheets.withColumn("sheet", F.when(n == 1, own).otherwise(F.concat(F.left(own, 31 - F.length(end)), end)))
