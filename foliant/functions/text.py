"""Text functions, Column to Column. All but the Unicode forms (NFC, case folding) stay in the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The full-width forms of ASCII punctuation in transcripts.
PUNCTUATION = {",": "，", ".": "。", "!": "！", "?": "？", ";": "；", ":": "：", "．": "。"}
# The marks of which a run collapses to one.
COLLAPSED = "。，！？；：…"
# CJK ideographs whose separating spaces are dropped.
CJK = "\\u4E00-\\u9FFF\\u3400-\\u4DBF"
# Marks at which a clause ends, and what an overlap ignores besides them.
BOUNDARY = ",.!?;:、。！，：；？"
IGNORED = "\"'()[]{}-_‘’“”（）【】　"
# Lengths that an overlap of rolled texts may have, and how a stable prefix holds back.
OVERLAP_BYTES, ROLLED_MAX, HOLD_BACK, CLAUSE_MIN, CLAUSE_MAX = 48, 32, 6, 3, 10
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def _unicode(f):
    @F.arrow_udf(T.StringType())
    def mapped(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else f(t) for t in texts.to_pylist()], pa.string())

    return mapped


nfc = _unicode(lambda t: unicodedata.normalize("NFC", t))
nfc_fold = _unicode(lambda t: unicodedata.normalize("NFC", t).casefold())
casefold = _unicode(str.casefold)


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise(c: Column, remove_whitespace: bool = False, ignore_punctuation: bool = False, case_sensitive: bool = True) -> Column:
    """NFC, line ends to LF, trim, then case folding, white space and punctuation as asked for."""
    out = trim_all(F.regexp_replace(nfc(c), "\r\n?", "\n"))
    if not case_sensitive:
        out = casefold(out)
    if remove_whitespace:
        out = F.regexp_replace(out, r"(?U)\s+", "")
    if ignore_punctuation:
        out = F.regexp_replace(out, r"[\p{P}\p{S}]+", "")
    return out


def common_prefix(a: Column, b: Column) -> Column:
    """Length in code points of the longest common prefix of two strings."""
    x, y = F.split(a, ""), F.split(b, "")
    equal = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    at = F.array_position(F.concat(equal, F.array(F.lit(False))), F.lit(False))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(at - 1).cast("int")


def first_difference(ref: Column, hyp: Column) -> Column:
    """Struct: 1-based position, characters, code points and contexts; null if both are equal."""
    n = common_prefix(ref, hyp)

    def char(c: Column) -> Column:
        x = F.substring(c, n + 1, F.lit(1))
        return F.when(n >= F.length(c), "<文本结束>").when(x == " ", "␠").when(x == "\n", "↵").when(x == "\t", "⇥").otherwise(x)

    def point(c: Column) -> Column:
        x = F.substring(c, n + 1, F.lit(1))
        # UTF-32 has one number for each code point
        return F.when(n < F.length(c), F.concat(F.lit("U+"), F.regexp_replace(F.hex(F.encode(x, "UTF-32")), "^0{0,4}", ""))).otherwise("")

    def around(c: Column) -> Column:
        begin = F.greatest(F.lit(0), n - 8)
        return F.substring(c, begin + 1, F.lit(17))

    found = F.struct(
        (n + 1).alias("position"), char(ref).alias("reference_character"), point(ref).alias("reference_code_point"), char(hyp).alias("hypothesis_character"),
        point(hyp).alias("hypothesis_code_point"), around(ref).alias("reference_context"), around(hyp).alias("hypothesis_context"),
    )
    return F.when((n == F.length(ref)) & (n == F.length(hyp)), F.lit(None)).otherwise(found)


def transcript_text(c: Column) -> Column:
    """A transcript's text: tag or language line cut off, punctuation full-width and single, spaces between ideographs dropped."""
    tagged = F.instr(c, "<asr_text>")
    # without a line end after "language " nothing is cut off
    cut = F.when(tagged > 0, F.substring(c, tagged + 10, F.length(c))).when(c.startswith("language ") & (F.instr(c, "\n") > 0), F.substring(c, F.instr(c, "\n") + 1, F.length(c))).otherwise(c)
    out = F.translate(F.regexp_replace(cut, "\r", ""), "\n\t", "  ")
    out = F.translate(out, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    out = F.regexp_replace(out, rf"([{COLLAPSED}])\1+", "$1")
    out = F.regexp_replace(out, rf"(?<=[{CJK}]) (?=[{CJK}])", "")
    return F.regexp_replace(F.regexp_replace(out, " +", " "), "^ +| +$", "")


#: Texts that are joined before they meet the rest: what a step copies is bounded by it.
JOINED_AT_ONCE = 64


def overlap_merge(parts: Column) -> Column:
    """Joins texts in order, each without the longest prefix that ends the text so far (48 bytes at most).

    Of the text so far a step sees its last characters only, and what parts leave is gathered in two levels of arrays, so
    the work grows with the text."""

    def added(tail: Column, part: Column) -> Column:
        fits = F.filter(
            F.sequence(F.least(F.length(tail), F.length(part)), F.lit(0), F.lit(-1)),
            lambda k: (k == 0) | ((F.right(tail, k) == F.left(part, k)) & (F.octet_length(F.left(part, k)) <= OVERLAP_BYTES)),
        )
        # one search from the left finds the longest; what it cannot tell is tried length by length
        plain = (F.octet_length(tail) == F.length(tail)) & (F.instr(tail, "\0") == 0) & (F.instr(part, "\0") == 0)
        found = F.length(F.regexp_extract(F.concat(tail, F.lit("\0"), part), r"([^\x00]*+)\x00\1", 1))
        return F.substring(part, F.when(plain, found).otherwise(F.element_at(fits, 1)) + 1, F.length(part))

    state = lambda tail, out: F.struct(tail.alias("tail"), out.alias("out"))
    empty = F.array().cast("array<string>")

    def joined(s: Column, part: Column) -> Column:
        new = lambda n: state(F.right(F.concat(s["tail"], n), F.lit(OVERLAP_BYTES)), F.concat(s["out"], F.array(n)))
        return F.when(part == "", s).otherwise(_let(F.when(s["tail"] == "", part).otherwise(added(s["tail"], part)), new))

    def group(s: Column, texts: Column) -> Column:
        own = F.aggregate(texts, state(s["tail"], empty), joined, lambda g: state(g["tail"], F.array_join(g["out"], "")))
        return _let(own, lambda g: state(g["tail"], F.concat(s["out"], F.array(g["out"]))))

    def merged(texts: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(texts), F.lit(1)), F.lit(JOINED_AT_ONCE))
        groups = F.transform(starts, lambda k: F.slice(texts, k, F.lit(JOINED_AT_ONCE)))
        return F.aggregate(groups, state(F.lit(""), empty), group, lambda s: F.array_join(s["out"], ""))

    return transcript_text(_let(F.transform(parts, transcript_text), merged))


def full_to_half(c: Column) -> Column:
    return F.translate(c, FULL, HALF)


def formula_tag(c: Column) -> Column:
    """The text of a formula's number: half-width, without one pair of outer brackets."""
    out = trim_all(full_to_half(trim_all(c)))
    out = F.when(out.startswith("("), trim_all(F.substring(out, 2, 1 << 30))).otherwise(out)
    return F.when(out.endswith(")"), trim_all(F.left(out, F.length(out) - 1))).otherwise(out)


def isolated_formula(c: Column) -> Column:
    r"""Without \[ and \], looked for before white space is trimmed."""
    return trim_all(F.regexp_replace(F.regexp_replace(c, r"^\\\[", ""), r"\\\]$(?!\n)", ""))


def html_escape(c: Column, quotes: bool = True) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


# References decoded inside equations, in this order.
EQ_REFERENCES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#x27;", "'"), ("&nbsp;", " ")]
_EQ = r"(?s)<eq>.*?</eq>"


def _pieces(c: Column, pattern: str, inside, outside) -> Column:
    """Rewrites the matches of a pattern and the texts between them."""
    found, between = F.regexp_extract_all(c, F.lit(f"({pattern})"), 1), F.split(c, pattern, -1)
    pairs = F.zip_with(between, found, lambda text, match: F.concat(outside(text), F.when(match.isNull(), "").otherwise(inside(match))))
    return F.array_join(pairs, "")


def embedded_table(c: Column) -> Column:
    """Equations of a table as $...$, their character references decoded."""

    def inside(m: Column) -> Column:
        body = F.substring(m, F.lit(5), F.length(m) - 9)
        return F.concat(F.lit(" $"), reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), EQ_REFERENCES, body), F.lit("$ "))

    return _pieces(c, _EQ, inside, lambda t: t)


def formula_delimiters(c: Column) -> Column:
    r"""\( \) and \[ \] to <eq> </eq>, outside of equations that are marked already."""

    def wrapped(text: Column, pattern: str) -> Column:
        return _pieces(text, pattern, lambda m: F.concat(F.lit("<eq>"), trim_all(F.substring(m, F.lit(3), F.length(m) - 4)), F.lit("</eq>")), lambda t: t)

    return _pieces(c, _EQ, lambda m: m, lambda t: wrapped(wrapped(t, r"(?s)\\\(.+?\\\)"), r"(?s)\\\[.+?\\\]"))


def html_to_text(c: Column) -> Column:
    """Plain text of simple markup: block ends and breaks are line ends, references decoded, blanks single."""
    out = F.regexp_replace(c, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", "")
    out = F.regexp_replace(out, r"[ \t\r\n]+", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|tr|li|ul|ol|table|h[1-6]|blockquote|pre|section|article)\s*>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)</t[dh]\s*>", " "), "<[^>]*>", "")
    references = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]
    out = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), references, out)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " *\n *", "\n"), "\n{2,}", "\n"), r"^[ \n]+|[ \n]+$", "")


def markdown_inline(c: Column) -> Column:
    """Images, code, bold and italic of an escaped line, in that order."""
    out = F.regexp_replace(c, r"!\[([^\]]*)\]\(([^)]+)\)", '<img alt="$1" src="$2">')
    out = F.regexp_replace(out, "`([^`]+)`", "<code>$1</code>")
    return F.regexp_replace(F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<b>$1</b>"), r"\*([^*]+)\*", "<i>$1</i>")


def markdown_html(c: Column) -> Column:
    """Blocks of Markdown: fences, lists, headings to level 3, blank lines. A fold over the lines
    whose state is the markup so far, and whether a fence or a list is open."""
    lines = F.split(F.regexp_replace(c, "\r\n?", "\n"), "\n", -1)
    state = F.struct(F.lit("").alias("out"), F.lit(False).alias("fence"), F.lit(False).alias("list"))

    def step(s: Column, line: Column) -> Column:
        text = html_escape(line, False)
        bare = F.trim(line)
        ends = F.when(s["list"], "</ul>").otherwise("")
        fence = bare.startswith("```")
        item = F.regexp_extract(text, r"^\s*[-*]\s+(.*)$", 1)
        is_item = line.rlike(r"^\s*[-*]\s+")
        level = F.length(F.regexp_extract(line, r"^(#{1,3})\s", 1))
        title = F.regexp_replace(text, r"^#{1,3}\s+", "")
        heading = F.concat(F.lit("<h"), level.cast("string"), F.lit(">"), markdown_inline(title), F.lit("</h"), level.cast("string"), F.lit(">"))
        out = (
            F.when(fence & s["fence"], "</pre>")
            .when(fence, F.concat(ends, F.lit("<pre>")))
            .when(s["fence"], F.concat(text, F.lit("\n")))
            .when(is_item, F.concat(F.when(s["list"], "").otherwise("<ul>"), F.lit("<li>"), markdown_inline(item), F.lit("</li>")))
            .when(level > 0, F.concat(ends, heading))
            .when(bare == "", F.concat(ends, F.lit("<br/>")))
            .otherwise(F.concat(ends, F.lit("<p>"), markdown_inline(text), F.lit("</p>")))
        )
        opened = F.when(fence, ~s["fence"]).otherwise(s["fence"])
        listed = F.when(s["fence"] & ~fence, s["list"]).otherwise(is_item & ~fence)
        return F.struct(F.concat(s["out"], out).alias("out"), opened.alias("fence"), listed.alias("list"))

    return F.aggregate(lines, state, step, lambda s: F.concat(s["out"], F.when(s["fence"], "</pre>").otherwise(""), F.when(s["list"], "</ul>").otherwise("")))


_LATEX = r"(?s)\$\$.+?\$\$|\$[^$\n]+?\$"


def escape_latex(c: Column) -> Column:
    """HTML escapes inside $$...$$ and $...$ only; the double sign is tried first."""
    return _pieces(c, _LATEX, lambda m: html_escape(m, False), lambda t: t)


def image_targets(c: Column) -> Column:
    """Targets of Markdown images."""
    return F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), 1)


def is_local_target(c: Column) -> Column:
    return ~F.lower(c).rlike("^(https?:|data:|file:)")


def local_images(c: Column, base: str) -> Column:
    """Relative image targets under `base`, others untouched."""
    folder = base.rstrip("/") + "/"
    return F.regexp_replace(c, r"(?i)(!\[[^\]]*\]\()(?!https?:|data:|file:|/)([^)\s]+)", f"$1file://{folder}$2")


def safe_filename(c: Column) -> Column:
    """Illegal characters to _, blanks, dots and _ cut off at both ends, 'doc' if nothing is left, 120 characters at most."""
    out = F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]', "_")
    out = F.regexp_replace(F.regexp_replace(out, "^[ ._]+", ""), "[ ._]+$", "")
    return F.left(F.when(out == "", "doc").otherwise(out), F.lit(120))


# What separates lines, and what white space is, in Python's str.
_BREAKS = "\r\n|[\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"  # besides LF
_SPACES = "\t\n\u000b\u000c\r \u001c\u001d\u001e\u001f\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def python_strip(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


def code_content(c: Column) -> Column:
    """Code without its fence; lines and blanks as Python sees them. Only the first and the last line are looked at, so
    the text is never cut into lines."""
    left = lambda t, n: F.substring(t, F.lit(1), n)

    def unfenced(t: Column) -> Column:
        opened, first = t.startswith("```"), F.instr(t, "\n")
        # null: the opening fence is all there is
        return F.when(~opened, t).when(first > 0, F.substring(t, first + 1, F.length(t)))

    def unclosed(t: Column) -> Column:
        last = F.substring_index(t, "\n", -1)
        return F.when(python_strip(last) == "```", left(t, F.length(t) - F.length(last) - 1)).otherwise(t)

    lines = F.regexp_replace(c, _BREAKS, "\n")
    # a final break ends a line, it does not begin one
    lines = _let(lines, lambda t: F.when(t.endswith("\n"), left(t, F.length(t) - 1)).otherwise(t))
    return F.coalesce(python_strip(_let(_let(lines, unfenced), unclosed)), F.lit(""))


def without_surrogates(c: Column) -> Column:
    """Valid UTF-8 without line feeds: what stands for a lone surrogate or a bad byte goes."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(c), F.lit("�"), F.lit("")), "\n", "")


def without_controls(c: Column) -> Column:
    """Without characters of Unicode category C."""
    return F.regexp_replace(c, r"\p{C}", "")


def has_kana(c: Column) -> Column:
    return c.rlike("[\\u3041-\\u30FE]")


def language_rules(text: Column, label: Column, score: Column) -> Column:
    """Struct of language and score after the rules: empty text has none, JA without kana is zh, lower case, score 1 at most."""
    label = F.when((F.upper(label) == "JA") & ~has_kana(text), "ZH").otherwise(label)
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return F.struct(F.when(empty, "").otherwise(F.lower(label)).alias("language"), F.when(empty, 0.0).otherwise(F.least(score, F.lit(1.0))).alias("score"))


def code_language_rules(label: Column, score: Column, threshold: Column) -> Column:
    """The final label of a code-language prediction."""
    out = F.when(label == "randombytes", "unknown").when(label == "randomtxt", "txt").otherwise(label)
    out = F.when(F.coalesce(score >= threshold, F.lit(False)), out).otherwise("txt")
    return F.when(out == "unknown", "txt").otherwise(out)


def _significant(c: Column) -> Column:
    """Characters that count in an overlap."""
    return F.regexp_replace(c, f"[\\x00-\\x20{re.escape(BOUNDARY + IGNORED)}]", "")


def _let(value: Column, body) -> Column:
    """`body(value)` with the value computed once, however often a lambda uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


def rolled_overlap_removed(previous: Column, current: Column) -> Column:
    """`current` without what repeats the end of `previous`: 2 to 32 significant characters, and what is ignored after them."""
    skip = f"[\\x00-\\x20{re.escape(BOUNDARY + IGNORED)}]"

    def common(s: Column) -> Column:
        limit = F.least(F.length(s["a"]), F.length(s["b"]), F.lit(ROLLED_MAX))
        fits = F.filter(F.sequence(F.greatest(limit, F.lit(1)), F.lit(1), F.lit(-1)), lambda k: (k >= 2) & (k <= limit) & (F.right(s["a"], k) == F.left(s["b"], k)))
        return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(0))

    def rest(n: Column) -> Column:
        # where the next significant character stands
        places = F.filter(F.transform(F.split(current, ""), lambda ch, i: F.when(~ch.rlike(skip), i)), lambda i: i.isNotNull())
        after = F.coalesce(F.substring(current, F.get(places, n) + 1, F.length(current)), F.lit(""))
        return F.when((n == 0) | (F.length(previous) == 0), current).otherwise(after)

    return _let(_let(F.struct(_significant(previous).alias("a"), _significant(current).alias("b")), common), rest)


def stable_prefix(c: Column) -> Column:
    """What of a growing text is unlikely to change: up to the last clause end with 3 to 10 significant characters after it, else all but the last 6."""
    skip = f"[\\x00-\\x20{re.escape(BOUNDARY + IGNORED)}]"
    boundary = f"[{re.escape(BOUNDARY)}]"

    def cut(s: Column) -> Column:
        total = F.element_at(s["upto"], -1)
        # clause ends, and the character that is held back first: places from 1
        ends = F.transform(s["chars"], lambda ch, i: F.when(ch.rlike(boundary) & (total - F.get(s["upto"], i + 1)).between(CLAUSE_MIN, CLAUSE_MAX), i + 1))
        held = F.array_position(s["upto"], total - HOLD_BACK + 1)
        at = F.array_max(ends)
        return F.when(total <= HOLD_BACK, "").when(at.isNotNull(), F.left(c, at)).otherwise(F.left(c, held.cast("int") - 2))

    # significant characters before each place, and all of them
    weight = lambda chars: F.transform(chars, lambda x: F.when((x == "") | x.rlike(skip), 0).otherwise(1))
    upto = lambda chars: F.aggregate(weight(chars), F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    return _let(_let(F.split(c, ""), lambda chars: F.struct(chars.alias("chars"), upto(chars).alias("upto"))), cut)


def json_string(c: Column) -> Column:
    """A JSON string literal of a text."""
    return F.regexp_replace(F.to_json(F.struct(c.alias("v"))), r'^\{"v":|\}$', "")
