"""Text functions against literal values and plain Python."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import jsonx, scoring
from foliant.functions import text as X


def c(name="s"):
    return F.col(name)


def test_edit_distance_without_white_space(one):
    ref, hyp = X.normalise(c("a"), remove_whitespace=True), X.normalise(c("b"), remove_whitespace=True)
    assert one(F.struct(F.length(ref).alias("n"), F.levenshtein(ref, hyp).alias("d")), a="甲 乙丙", b="甲乙丁") == (3, 1)


def test_first_difference(one):
    norm = lambda x: X.normalise(x, remove_whitespace=True)
    d = one(X.first_difference(norm(c("a")), norm(c("b"))), a="Action Item：完成\n", b="Action Item: 完成")
    assert (d["reference_code_point"], d["hypothesis_code_point"], d["position"]) == ("U+FF1A", "U+003A", 11)
    assert one(X.first_difference(norm(c("a")), norm(c("b"))), a="甲 乙", b="甲乙") is None
    d = one(X.first_difference(c("a"), c("b")), a="ab", b="ab c")
    assert d["reference_character"] == "<文本结束>" and d["hypothesis_character"] == "␠" and d["reference_code_point"] == ""
    d = one(X.first_difference(c("a"), c("b")), a="x" * 30 + "𝔘" + "y" * 30, b="x" * 30)
    assert d["reference_code_point"] == "U+1D518" and d["reference_context"] == "x" * 8 + "𝔘" + "y" * 8


def test_normalise(one):
    assert one(X.normalise(c()), s="　e\u0301\r\nb\rc \t") == "é\nb\nc"
    assert one(X.normalise(c(), case_sensitive=False), s="STRASSE ß") == "strasse ss"
    assert one(X.normalise(c(), True, True), s="a, b! 「c」 d+e") == "abcde"


@pytest.mark.parametrize(
    ("text", "want"),
    [("好。。。", "好。"), ("3.14", "3。14"), ("<asr_text>a\r\nb", "a b"), ("x<asr_text> y ", "y"), ("language zh\n你 好", "你好"), ("language zh", "language zh"), ("a  b", "a b"), ("中  文", "中 文"), ("a,,b", "a，b"), ("。！。", "。！。"), ("", "")],
)
def test_transcript_text(one, text, want):
    assert one(X.transcript_text(c()), s=text) == want


def test_overlap_merge(one):
    run = lambda *p: one(X.overlap_merge(F.array(*map(F.lit, p))))
    assert run("今天天气", "天气很好", "很好啊") == "今天天气很好啊"
    assert run("ab", "", "bc") == "abc" and run("", "x") == "x" and run("好", "好") == "好"
    # more than 48 bytes are not looked for
    assert run("x" + "汉" * 20, "汉" * 20 + "y") == "x" + "汉" * 24 + "y"


def test_formulas(one):
    assert one(X.formula_tag(c()), s="（1）") == "1" and one(X.formula_tag(c()), s=" (2.a ) ") == "2.a"
    assert one(X.isolated_formula(c()), s="\\[ x \\]") == "x" and one(X.isolated_formula(c()), s="  \\[x\\]  ") == "\\[x\\]"
    assert one(X.formula_delimiters(c()), s="a \\( x\\) <eq>\\(k\\)</eq> \\[y\n z\\]") == "a <eq>x</eq> <eq>\\(k\\)</eq> <eq>y\n z</eq>"
    assert one(X.embedded_table(c()), s="q <eq>&amp;lt;&quot;</eq> &amp;") == 'q  $<"$  &amp;'
    assert one(X.html_escape(c()), s="<a b='\"&'>") == "&lt;a b=&#x27;&quot;&amp;&#x27;&gt;"


def test_markup(one):
    assert one(X.html_to_text(c()), s="<table><tr><td>表格值</td></tr></table>") == "表格值"
    assert one(X.html_to_text(c()), s="<p>a&amp;lt;</p><p> b<br>c</p>") == "a&lt;\nb\nc"
    assert one(X.markdown_html(c()), s="# T *i*\n- a\n- b `x<`\n\n```\n<p>\n```\nend **b**") == (
        "<h1>T <i>i</i></h1><ul><li>a</li><li>b <code>x&lt;</code></li></ul><br/><pre>&lt;p&gt;\n</pre><p>end <b>b</b></p>"
    )
    assert one(X.escape_latex(c()), s="$$a<b$$ <i> $c&d$") == "$$a&lt;b$$ <i> $c&amp;d$"
    assert one(X.local_images(c(), "/base/"), s="![x](i.png) ![y](http://h/z.png)") == "![x](file:///base/i.png) ![y](http://h/z.png)"
    assert one(X.image_targets(c()), s="![x](i.png) ![y](http://h/z.png)") == ["i.png", "http://h/z.png"]


def test_file_names(one):
    assert one(X.safe_filename(c()), s=" ..a/b:c._") == "a_b_c" and one(X.safe_filename(c()), s=" ._") == "doc"
    assert len(one(X.safe_filename(c()), s="x" * 300)) == 120


@pytest.mark.parametrize(("text", "want"), [("```python\n  a\n b\n```", "a\n b"), ("``` \n```", ""), ("a\r\nb\x0bc", "a\nb\nc"), ("```\nx", "x"), ("x\n ``` ", "x"), ("", ""), (" x ", "x")])
def test_code_content(one, text, want):
    assert one(X.code_content(c()), s=text) == want


def test_language_rules(one):
    rule = lambda **k: one(X.language_rules(c("s"), c("l"), c("p")), **k)
    assert rule(s="漢字", l="JA", p=1.2) == ("zh", 1.0) and rule(s="かな", l="JA", p=0.5) == ("ja", 0.5) and rule(s="", l="EN", p=0.9) == ("", 0.0)
    code = lambda **k: one(X.code_language_rules(c("l"), c("p"), F.lit(0.5)), **k)
    assert [code(l="randombytes", p=0.9), code(l="randomtxt", p=0.9), code(l="python", p=0.4), code(l="python", p=0.5)] == ["txt", "txt", "txt", "python"]


def ignored(ch):
    return ord(ch) <= 0x20 or ch in X.BOUNDARY + X.IGNORED


def brute_removed(previous, current):
    a, b = [x for x in previous if not ignored(x)], [(i, x) for i, x in enumerate(current) if not ignored(x)]
    for n in range(min(32, len(a), len(b)), 1, -1):
        if a[-n:] == [x for _, x in b[:n]]:
            i = b[n - 1][0] + 1
            while i < len(current) and ignored(current[i]):
                i += 1
            return current[i:]
    return current


def brute_stable(text):
    own = [i for i, x in enumerate(text) if not ignored(x)]
    if len(own) <= 6:
        return ""
    for i in range(len(text) - 1, -1, -1):
        if text[i] in X.BOUNDARY and 3 <= sum(k > i for k in own) <= 10:
            return text[: i + 1]
    return text[: own[-6]]


def test_rolled_texts(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        s = "".join(rng.choice("ab,。 「甲") for _ in range(rng.randint(0, 30)))
        t = s[-rng.randint(1, 12) :] if s and rng.random() < 0.6 else ""
        rows.append((s, t + "".join(rng.choice("ab,。 甲x") for _ in range(rng.randint(0, 20)))))
    df = spark.createDataFrame(rows, "p string, q string")
    for r in df.select("p", "q", X.rolled_overlap_removed(F.col("p"), F.col("q")).alias("x"), X.stable_prefix(F.col("q")).alias("y")).collect():
        assert r["x"] == brute_removed(r["p"], r["q"]), r
        assert r["y"] == brute_stable(r["q"]), r


STRICT = [
    ('{"a":1}', True), ('{"a":1,"a":2}', False), ('{"a":1,"\\u0061":2}', False), ('{"x":{"a":1,"a":2}}', False), ("[1,]", False), ("{} x", False), ("01", False), ("NaN", False), ("'a'", False), ("", False),
    ("[1, 2]", True), ('"\\ud83d\\ude00"', True), ("[1] 2", False), ("1, 2", False), ("null", True), (" {} ", True), ('"a\tb"', False),
]


@pytest.mark.parametrize(("text", "ok"), STRICT)
def test_strict_json(one, text, ok):
    assert (jsonx.check(text) is None) == ok
    assert one(jsonx.is_json(c()), s=text) == ok


def test_json_depth_and_errors():
    assert jsonx.check("[" * 1024 + "]" * 1024) is None and jsonx.check("[" * 1025 + "]" * 1025) == "nested too deeply"
    assert "byte" in jsonx.check('{"é": x}') and jsonx.check(None) == "null"


def test_collect_scores(one):
    assert one(jsonx.collect_scores(c()), s='{"score": 0.8, "x": [{"confidence": 1.0}, {"score": 7}, {"score": true}]}') == [0.8, 1.0]
    assert one(jsonx.collect_scores(c()), s="{") == []


def test_scores(spark):
    df = spark.createDataFrame([(0.8,), (1.0,)], "s double")
    assert df.agg(*scoring.summary(F.col("s"))).first() == (2, pytest.approx(0.9), 0.8, 1.0)
    assert df.where("false").agg(*scoring.summary(F.col("s"))).first() == (0, 0.0, 0.0, 0.0)
    assert df.where("false").agg(scoring.micro_accuracy(F.lit(1), F.lit(2)).alias("a")).first()["a"] == 0.0


def test_arrays(one):
    nan = float("nan")
    assert one(scoring.upper_median(F.array(*map(F.lit, [3, 1, 2, 4])))) == 3
    assert one(scoring.argmax_first(F.array(*map(F.lit, [1.0, nan, 5.0, 5.0])))) == 2
    assert one(scoring.softmax_at(F.array(*map(F.lit, [1000.0, 1000.0])), F.lit(1))) == 0.5


def test_unicode_helpers(one):
    assert one(X.full_to_half(c()), s="ＡＢ１（") == "AB1(" and one(X.without_controls(c()), s="a\u200bb\x07") == "ab"
    assert unicodedata.normalize("NFC", "e\u0301") == one(X.nfc(c()), s="e\u0301")
    assert one(X.json_string(c()), s='a"\n') == '"a\\"\\n"' and one(X.has_kana(c()), s="ア") and not one(X.has_kana(c()), s="漢")
