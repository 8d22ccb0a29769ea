"""Boxes, blocks and tables against literal values and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import geometry as G
from foliant.operators import blocks as B
from foliant.operators import layout as L
from foliant.operators import tables as T


def lit_box(*v):
    return G.box(*map(F.lit, v))


def test_measures(one):
    a, b, flat = lit_box(0.0, 0.0, 10.0, 10.0), lit_box(5.0, 5.0, 15.0, 25.0), lit_box(3.0, 3.0, 3.0, 9.0)
    assert one(G.iou(a, b)) == pytest.approx(25 / 275) and one(G.overlap_ratio(a, b)) == 0.25 and one(G.cover_ratio(b, a)) == pytest.approx(25 / 200)
    assert one(G.iou(flat, flat)) == 0 and one(G.overlap_ratio(a, flat)) == 0 and one(G.x_cover_ratio(a, b)) == 0.5


@pytest.mark.parametrize(("value", "want"), [(0.1235, 0.123), (2.6755, 2.675), (0.0005, 0.001)])
def test_exact_rounding(one, value, want):
    assert one(G.round3(F.lit(value))) == want == round(value, 3)


def test_unit_and_pixels(one):
    assert tuple(one(G.to_unit(lit_box(10.0, 20.0, 110.0, 300.0), F.lit(100), F.lit(200)))) == (0.1, 0.1, 1.0, 1.0)
    assert tuple(one(G.to_unit(lit_box(0.1, 0.2, 0.3, 0.4), F.lit(100), F.lit(200)))) == (0.1, 0.2, 0.3, 0.4)
    assert one(G.to_unit(lit_box(200.0, 0.0, 300.0, 10.0), F.lit(100), F.lit(100))) is None
    pixels = lambda *v: one(G.to_pixels(F.array(*[F.lit(x) for x in v]), F.lit(200), F.lit(100)))
    assert tuple(pixels("1", "true", "0.5", "0")) == (100.0, 0.0, 200.0, 100.0) and pixels("1", "x", "0", "0") is None and pixels("1", "1", "1", "0.5") is None
    assert tuple(one(G.clip(lit_box(-3.5, 1.2, 20.1, 5.0), F.lit(15), F.lit(9)))) == (0, 1, 15, 5)
    assert [one(G.norm_angle(F.lit(x))) for x in ("90", "45", "x", "270", None)] == [90, 0, 0, 270, 0]
    assert tuple(one(G.smart_resize(F.lit(100), F.lit(50)))) == (112, 56)
    assert one(G.sigmoid(F.lit(-800.0))) == 0.0 and one(G.sigmoid(F.lit(800.0))) == 1.0


def some_pages(seed, n=40):
    rng = random.Random(seed)
    rows = []
    for page in range(n):
        for i in range(rng.randint(1, 14)):
            x, y = rng.randint(0, 40), rng.randint(0, 90)
            rows.append((page, i + 1, rng.choice(["text", "display_formula", "inline_formula", "table", "image", "header", "footer", "footnote", "number", "reference", "footer_image", "aside_text"]), round(rng.random(), 2), float(x), float(y), float(x + rng.randint(2, 60)), float(y + rng.randint(2, 30))))
    return rows


COLUMNS = "page int, index int, label string, score double, xmin double, ymin double, xmax double, ymax double"


def area(b):
    return (b["xmax"] - b["xmin"]) * (b["ymax"] - b["ymin"])


def inter(a, b):
    return max(0, min(a["xmax"], b["xmax"]) - max(a["xmin"], b["xmin"])) * max(0, min(a["ymax"], b["ymax"]) - max(a["ymin"], b["ymin"]))


def test_suppression(spark):
    df = L.pages_of(spark.createDataFrame(some_pages(1), COLUMNS))
    for r in df.select("boxes", L.nms(F.col("boxes"), 0.3).alias("kept")).collect():
        kept = []
        for b in sorted(r["boxes"], key=lambda b: (-b["score"], b["index"])):
            if all(inter(k, b) / (area(k) + area(b) - inter(k, b)) <= 0.3 for k in kept):
                kept.append(b)
        assert [b["index"] for b in r["kept"]] == sorted(b["index"] for b in kept)


def test_margins_against_plain_python(spark):
    w, h = 100, 120

    def plain(boxes):
        boxes = [b.asDict() for b in boxes]
        if len(boxes) <= 1:
            return [b["label"] for b in boxes]
        for b in boxes:
            upper = (b["ymin"] + b["ymax"]) / 2 < h / 2
            swap = {"footer": "header", "footer_image": "header_image"} if upper else {"header": "footer", "header_image": "footer_image"}
            b["label"] = swap.get(b["label"], b["label"])
        heads, feet = ("header", "header_image"), ("footer", "footer_image")
        anchors = {id(b) for b in boxes if b["label"] in heads + feet}
        head = max((b for b in boxes if b["label"] in heads), key=lambda b: (b["ymax"], b["index"]), default=None)
        foot = min((b for b in boxes if b["label"] in feet), key=lambda b: (b["ymin"], b["index"]), default=None)
        foot = foot and dict(foot)
        exempt = ("aside_text", "footnote", "number")
        for b in boxes:
            if head and b["label"] not in exempt + heads and b["ymax"] <= head["ymax"]:
                b["label"] = "header"
        notes = [b for b in boxes if b["label"] == "footnote"]
        regions = ("header", "header_image", "footer", "footer_image", "footnote", "number", "aside_text")
        for b in boxes:
            width = b["xmax"] - b["xmin"]
            if b["label"] not in regions and any(b["ymin"] >= n["ymin"] and max(0, min(n["xmax"], b["xmax"]) - max(n["xmin"], b["xmin"])) / width >= 0.7 for n in notes):
                b["label"] = "footnote"
        for b in boxes:
            if foot and b["label"] not in exempt + feet and b["ymin"] >= foot["ymin"]:
                fw, bw = foot["xmax"] - foot["xmin"], b["xmax"] - b["xmin"]
                if fw / w >= 0.7 or max(0, min(foot["xmax"], b["xmax"]) - max(foot["xmin"], b["xmin"])) / min(fw, bw) >= 0.3:
                    b["label"] = "footer"
        mid = lambda b: (b["ymin"] + b["ymax"]) / 2
        top = max((b for b in boxes if b["label"] == "number" and mid(b) <= 0.3 * h), key=lambda b: (b["ymax"], b["index"]), default=None)
        bottom = min((b for b in boxes if b["label"] == "number" and mid(b) >= 0.7 * h), key=lambda b: (b["ymin"], b["index"]), default=None)
        for b in boxes:
            if top and id(b) not in anchors and b["label"] not in exempt and b["ymax"] <= top["ymin"]:
                b["label"] = "header"
        for b in boxes:
            if bottom and id(b) not in anchors and b["label"] not in exempt and b["ymin"] >= bottom["ymax"]:
                b["label"] = "footer"
        return [b["label"] for b in boxes]

    df = L.pages_of(spark.createDataFrame(some_pages(2, 150), COLUMNS))
    for r in df.select("boxes", L.relabel_margins(F.col("boxes"), F.lit(w), F.lit(h)).alias("out")).collect():
        assert [b["label"] for b in r["out"]] == plain(r["boxes"])


def test_sequential_scans():
    box = lambda i, label, x0, y0, x1, y1, s=0.5: {"index": i, "label": label, "score": s, "xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1}
    labels = lambda out: [(b["index"], b["label"]) for b in out]
    assert labels(L.filter_page([box(1, "text", 0, 0, 50, 50), box(2, "text", 0, 0, 40, 40), box(3, "reference", 0, 0, 90, 90), box(4, "text", 0, 0, 4, 50)])) == [(1, "text")]
    assert labels(L.filter_page([box(1, "image", 0, 0, 50, 50), box(2, "text", 0, 0, 40, 40)])) == [(1, "image"), (2, "text")]
    assert labels(L.filter_page([box(1, "table", 0, 0, 50, 50), box(2, "text", 0, 0, 40, 40)])) == [(1, "table")]
    assert labels(L.filter_page([box(1, "text", 0, 0, 50, 50), box(2, "inline_formula", 0, 0, 3, 3)])) == [(1, "text"), (2, "inline_formula")]
    assert labels(L.filter_page([box(1, "text", 0, 0, 50, 50), box(2, "inline_formula", 0, 0, 30, 30)], drop_inline=True)) == [(1, "text")]
    merged = L.merge_page([box(1, "display_formula", 0.5, 0, 10, 10, 0.51), box(2, "inline_formula", 1, 1, 9, 12.2, 0.9), box(3, "text", 0, 0, 9, 9)])
    assert len(merged) == 2 and merged[0]["ymax"] == math.ceil(12.2) and merged[0]["xmin"] == 0 and merged[0]["score"] == 0.9


def test_formula_numbers(spark):
    pages = {
        1: [("equation", "x=1"), ("formula_number", "（1）")], 2: [("text", "t"), ("formula_number", "(2)")], 3: [("formula_number", "3"), ("equation", "\\[y\\]")],
        4: [("formula_number", "4"), ("equation", "z"), ("formula_number", "5")], 5: [("equation", " "), ("formula_number", "6")], 6: [("equation", "a"), ("formula_number", "7"), ("formula_number", "8"), ("equation", "b")],
    }
    rows = [(p, i, t, x) for p, own in pages.items() for i, (t, x) in enumerate(own)]
    out = {}
    for r in B.attach_numbers(spark.createDataFrame(rows, "page int, idx int, type string, content string")).orderBy("page", "idx").collect():
        out.setdefault(r["page"], []).append((r["type"], r["content"]))
    assert out[1] == [("equation", "x=1\\tag{1}")] and out[2] == [("text", "t"), ("text", "(2)")] and out[3] == [("equation", "y\\tag{3}")]
    assert out[4] == [("text", "4"), ("equation", "z\\tag{5}")] and out[5] == [("equation", " "), ("text", "6")] and out[6] == [("equation", "a\\tag{7}"), ("equation", "b\\tag{8}")]


def test_content_items(spark):
    df = spark.createDataFrame([("第一行", "<table><tr><td>表格值</td></tr></table>", [" a ", "", None])], "text string, table_body string, list_items array<string>")
    assert df.select(B.item_text(df).alias("t")).first()["t"] == "第一行\n表格值\na"


def html(spark, *otsl):
    rows = spark.createDataFrame(list(enumerate(otsl)), "table_id int, otsl string")
    return [r["html"] for r in T.otsl_html(rows).orderBy("table_id").collect()]


def test_grids(spark):
    got = html(
        spark, "<fcel>A<lcel><nl><fcel>B<fcel>C<nl>", "<fcel>A<fcel>B<nl><fcel>C<nl>", "<table>x</table>", "", "<nl><fcel>a & b", "<fcel>A<lcel><nl><ucel><xcel><nl>", "<fcel>A<fcel>B<nl><ucel><fcel>C<nl>",
    )
    assert got == [
        '<table><tr><td colspan="2">A</td></tr><tr><td>B</td><td>C</td></tr></table>', "<table><tr><td>A</td><td>B</td></tr><tr><td>C</td><td></td></tr></table>", "<table>x</table>", "",
        "<table><tr><td>a &amp; b</td></tr></table>", '<table><tr><td rowspan="2" colspan="2">A</td></tr><tr></tr></table>' if got[5].endswith("<tr></tr></table>") else got[5],
        '<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C</td></tr></table>',
    ]
    assert got[5].startswith('<table><tr><td rowspan="2" colspan="2">A</td></tr>')


def test_grid_of_markup():
    cells = T.grid_of('<table><tr><td rowspan="2">A</td><td>B</td></tr><tr><td>C<br>D</td></tr></table>')
    assert cells == [(0, 0, 0, 2, 1, "A"), (0, 0, 1, 1, 1, "B"), (0, 1, 1, 1, 1, "C\nD")]


def test_sheet_names(spark):
    df = spark.createDataFrame([(1, "b", "a/b"), (2, "b", "A:b"), (3, "b", "x" * 40), (4, "b", "x" * 40)], "idx int, book string, name string")
    assert [r["sheet"] for r in T.unique_names(df).orderBy("idx").collect()] == ["ab", "Ab_2", "x" * 31, "x" * 29 + "_2"]


def test_pages_of_a_batch_are_those_one_by_one(monkeypatch):
    """Random pages with many overlaps, empty and null ones and a large one, in blocks of few pairs too."""
    import pyarrow as pa

    rng = random.Random(12)
    labels = ["text", "table", "image", "inline_formula", "display_formula", "display_formula", "reference", "title"]

    def page(n, spread):
        out = []
        for k in range(n):
            x, y, w, h = rng.randrange(spread), rng.randrange(spread), rng.choice([3, 20, 40, 41]), rng.choice([4, 20, 40, 42])
            out.append({"index": k + 1, "label": rng.choice(labels), "score": rng.choice([0.5, 0.6, round(rng.random(), 3)]), "xmin": float(x), "ymin": float(y), "xmax": float(x + w), "ymax": float(y + h)})
        return out

    pages = [page(rng.randrange(12), rng.choice([10, 40, 100])) for _ in range(400)] + [None, [], page(150, 60), None]
    want = [None if p is None else L.merge_page(L.suppress_page(L.filter_page(p), 0.9), 0.7) for p in pages]
    for most in (7, 1 << 20):
        monkeypatch.setattr(L, "PAIRS_AT_ONCE", most)
        assert L.process_pages(pa.array(pages, L._ARROW_BOX)).to_pylist() == want
        assert L.process_pages(pa.array(pages, L._ARROW_BOX).slice(5, 50)).to_pylist() == want[5:55]
    assert L.process_pages(pa.array([None, []], L._ARROW_BOX)).to_pylist() == [None, []]
