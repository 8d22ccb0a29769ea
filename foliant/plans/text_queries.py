"""Queries over text: normalising, scoring, markup, JSON, confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import jsonx, scoring
from ..functions import text as X
from ..operators import blocks as B
from ..sources import writers as W
from .base import query, table

PAIRS = """pairs AS (SELECT conv_id, turn, role, lower(regexp_replace(text, '[^A-Za-z0-9]+', '', 'g')) AS ref,
  lower(regexp_replace(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '[^A-Za-z0-9]+', '', 'g')) AS hyp FROM conversations)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", own(F.col("text")).alias("ref"), own(F.lead("text").over(w)).alias("hyp")).where("hyp IS NOT NULL")


@query(f"WITH {PAIRS} SELECT role, count(*) AS pairs, sum(length(ref))::BIGINT AS ref_chars, sum(levenshtein(ref, hyp))::BIGINT AS edits, round(1 - sum(levenshtein(ref, hyp)) / sum(length(ref)), 9) AS accuracy FROM pairs WHERE hyp IS NOT NULL GROUP BY role")
def micro_accuracy_by_role(spark, sf_dir):
    """Micro-averaged character accuracy of each turn against the next of its conversation."""
    own = _pairs(spark, sf_dir).withColumn("edits", F.levenshtein("ref", "hyp"))
    return own.groupBy("role").agg(F.count("*").alias("pairs"), F.sum(F.length("ref")).alias("ref_chars"), F.sum("edits").alias("edits"), F.round(scoring.micro_accuracy(F.col("edits"), F.length("ref")), 9).alias("accuracy"))


@query(f"WITH {PAIRS} SELECT conv_id, round(CASE WHEN sum(length(ref)) > 0 THEN sum(levenshtein(ref, hyp)) / sum(length(ref)) ELSE 0 END, 9) AS error_rate FROM pairs WHERE hyp IS NOT NULL GROUP BY conv_id")
def error_rate_by_conversation(spark, sf_dir):
    own = _pairs(spark, sf_dir)
    return own.groupBy("conv_id").agg(F.round(scoring.error_rate(F.levenshtein("ref", "hyp"), F.length("ref")), 9).alias("error_rate"))


@query(
    """SELECT doc_id, md5(regexp_replace(regexp_replace(lower(trim(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), ' ' || chr(10) || chr(9))), '\\s+', '', 'g'), '[\\p{P}\\p{S}]+', '', 'g')) AS digest,
  length(regexp_replace(regexp_replace(lower(trim(nfc_normalize(text))), '\\s+', '', 'g'), '[\\p{P}\\p{S}]+', '', 'g')) AS chars FROM documents"""
)
def acceptance_normalise(spark, sf_dir):
    """Normalised form of whole documents (here with lower case instead of folding, as SQL has no folding)."""
    out = X.normalise(F.col("text"))
    out = F.regexp_replace(F.regexp_replace(F.lower(out), r"(?U)\s+", ""), r"[\p{P}\p{S}]+", "")
    return table(spark, sf_dir, "documents").select("doc_id", out.alias("n")).select("doc_id", F.md5(F.col("n").cast("binary")).alias("digest"), F.length("n").alias("chars"))


@query(
    """WITH p AS (SELECT conv_id, turn, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
q AS (SELECT *, CASE WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE coalesce(list_position([substr(a, i, 1) = substr(b, i, 1) FOR i IN range(1, CAST(greatest(length(a), length(b)) AS BIGINT) + 1)], false) - 1, greatest(length(a), length(b))) END AS n FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CAST(n + 1 AS BIGINT) AS position, CASE WHEN n >= length(a) THEN '<文本结束>' WHEN substr(a, n + 1, 1) = ' ' THEN '␠' WHEN substr(a, n + 1, 1) = chr(10) THEN '↵' ELSE substr(a, n + 1, 1) END AS reference_character,
  substr(b, greatest(0, n - 8) + 1, 17) AS hypothesis_context FROM q WHERE a <> b"""
)
def first_differences(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b IS NOT NULL")
    own = own.withColumn("d", X.first_difference(F.col("a"), F.col("b"))).where("d IS NOT NULL")
    return own.select("conv_id", "turn", F.col("d.position").cast("long").alias("position"), "d.reference_character", "d.hypothesis_context")


_ZH = r"""trim(regexp_replace(regexp_replace(regexp_replace(translate(regexp_replace(text, '[\n\t]', ' ', 'g'), ',.!?;:．', '，。！？；：。'), '，+', '，', 'g'), '。+', '。', 'g'), ' +', ' ', 'g'), ' ')"""


@query(f"SELECT conv_id, turn, md5({_ZH}) AS digest FROM conversations")
def transcript_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.transcript_text(F.col("text")).cast("binary")).alias("digest"))


@query(
    """WITH parts AS (SELECT doc_id, regexp_replace(text, '[^A-Za-z]+', '', 'g') AS t FROM documents),
cut AS (SELECT doc_id, CASE WHEN t = '' THEN [] ELSE [substr(t, i * 50 + 1, 62) FOR i IN range(0, CAST(ceil(length(t) / 50.0) AS BIGINT))] END AS p FROM parts)
SELECT doc_id, CASE WHEN len(p) = 0 THEN md5('') ELSE md5(list_reduce(p, lambda acc, x: acc || substr(x, list_max(list_filter(range(0, least(length(acc), length(x), 48) + 1), lambda k: k = 0 OR right(acc, k) = substr(x, 1, k))) + 1))) END AS digest FROM cut"""
)
def overlap_merged(spark, sf_dir):
    """Texts cut in overlapping parts and merged again."""
    t = F.regexp_replace("text", "[^A-Za-z]+", "")
    # 50 characters and the 12 behind them; substrings of the whole text would each count from its beginning
    own = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(t, F.lit(".{1,50}"), 0).alias("p"))
    parts = F.coalesce(F.transform("p", lambda x, i: F.concat(x, F.coalesce(F.left(F.get("p", i + 1), F.lit(12)), F.lit("")))), F.array().cast("array<string>"))
    return own.select("doc_id", F.md5(X.overlap_merge(parts).cast("binary")).alias("digest"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM documents""")
def html_escaped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.html_escape(F.col("text")).cast("binary")).alias("digest"))


@query("""SELECT page_id, CASE WHEN s = '' THEN 'doc' ELSE left(s, 120) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\\\\/:*?"<>|\\x00-\\x1F]', '_', 'g'), '^[ ._]+', ''), '[ ._]+$', '') AS s FROM pages)""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_filename(F.col("url")).alias("name"))


@query("SELECT doc_id, sha256(text) AS sha256, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS chars, length(trim(text, ' ' || chr(10) || chr(9) || chr(13))) < 80 AS short FROM documents")
def text_digests(spark, sf_dir):
    from ..operators.blocks import markdown_length

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), markdown_length(F.col("text")).alias("m")).select("doc_id", "sha256", F.col("m.chars").alias("chars"), F.col("m.short").alias("short"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\p{C}', '', 'g')) AS digest FROM documents")
def controls_removed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.without_controls(F.col("text")).cast("binary")).alias("digest"))


@query(
    """SELECT doc_id, CASE WHEN length(text) = 0 THEN '' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'ja' ELSE 'zh' END ELSE lower(lang) END AS language,
  CASE WHEN length(text) = 0 THEN 0.0 ELSE least(1.0, doc_id % 5 / 2.0) END AS score FROM documents"""
)
def language_post_rules(spark, sf_dir):
    """Every third document is given as Japanese, half of these with kana at the end of the text."""
    doc = F.col("doc_id")
    text = F.when(doc % 6 == 0, F.concat("text", F.lit(" かな"))).otherwise(F.col("text"))
    rules = X.language_rules(text, F.when(doc % 3 == 0, "ja").otherwise(F.upper("lang")), doc % 5 / 2.0)
    return table(spark, sf_dir, "documents").select("doc_id", rules.alias("r")).select("doc_id", "r.language", "r.score")


@query("""SELECT event_id, CASE WHEN value < 0.5 AND event_type = 'x' THEN 'txt' WHEN value >= 50 THEN CASE WHEN event_type = 'randombytes' THEN 'txt' ELSE event_type END ELSE 'txt' END AS label FROM events""")
def code_label_rules(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.code_language_rules(F.col("event_type"), F.col("value"), F.lit(50.0)).alias("label"))


@query("SELECT event_id, json_valid(props) AS strict, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def strict_json(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    return own.select("event_id", jsonx.is_json(F.col("props")).alias("strict"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("SELECT event_id, json_valid(CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props || ']' WHEN 2 THEN left(props, length(props) - 1) ELSE '[' || props || ', 1e5]' END) AS valid FROM events")
def strict_json_errors(spark, sf_dir):
    """Properties as they are, with a bracket too many, cut short, and within a list."""
    n, props = F.col("event_id") % 4, F.col("props")
    own = F.when(n == 0, props).when(n == 1, F.concat(props, F.lit("]"))).when(n == 2, F.left(props, F.length(props) - 1)).otherwise(F.concat(F.lit("["), props, F.lit(", 1e5]")))
    return table(spark, sf_dir, "events").select("event_id", jsonx.json_error(own).isNull().alias("valid"))


_NESTED = """'{"a": [{"score": ' || (l_discount * 10) || '}, {"confidence": ' || l_tax || ', "b": {"score": 2}}]}'"""


@query(
    """SELECT l_orderkey, round(sum(CASE WHEN l_discount * 10 BETWEEN 0 AND 1 THEN l_discount * 10 ELSE 0 END + l_tax), 6) AS total,
  sum(CASE WHEN l_discount * 10 BETWEEN 0 AND 1 THEN 2 ELSE 1 END)::BIGINT AS n FROM lineitem GROUP BY l_orderkey"""
)
def scores_at_any_depth(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_json(F.struct(F.array(F.struct((F.col("l_discount") * 10).alias("score"), F.lit(None).cast("double").alias("confidence")), F.struct(F.lit(None).cast("double").alias("score"), F.col("l_tax").alias("confidence"))).alias("a"), F.struct(F.lit(2).alias("score")).alias("b"))).alias("j"))
    s = own.select("l_orderkey", jsonx.collect_scores(F.col("j")).alias("s"))
    return s.groupBy("l_orderkey").agg(F.round(F.sum(F.aggregate("s", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"), F.sum(F.size("s")).alias("n"))


@query("SELECT source, count(quality) AS count, coalesce(avg(quality), 0) AS mean, coalesce(min(quality), 0)::DOUBLE AS minimum, coalesce(max(quality), 0)::DOUBLE AS maximum FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def confidence_summary(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return own.groupBy("source").agg(*scoring.summary(F.col("quality").cast("double")))


@query("SELECT l_suppkey, round(exp(avg(ln(CASE WHEN l_discount > 0 THEN l_discount END))), 9) AS confidence FROM lineitem GROUP BY l_suppkey")
def geometric_confidence(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.round(scoring.geometric_mean(F.col("l_discount")), 9).alias("confidence"))


@query(
    """WITH d AS (SELECT doc_id, text, split(text, chr(10)) AS lines FROM documents)
SELECT doc_id, md5(array_to_string(list_transform(list_filter([text, lang, source], lambda x: trim(x, ' ' || chr(10)) <> ''), lambda x: trim(x, ' ' || chr(10))), chr(10))) AS digest FROM documents"""
)
def content_item_text(spark, sf_dir):
    from ..operators.blocks import item_text

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("content"), F.array("source").alias("list_items"))
    return docs.select("doc_id", F.md5(item_text(docs).cast("binary")).alias("digest"))


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    """regexp_replace after regexp_replace, in DuckDB's SQL."""
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return text


def _decoded(text: str) -> str:
    for reference, c in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#x27;", "chr(39)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        text = f"replace({text}, '{reference}', {c})"
    return text


_HIDDEN = [(rf"(?is)<{tag}\b.*?</{tag}\s*>", "''") for tag in ("script", "style", "head")] + [("(?s)<!--.*?-->", "''")]
_BROKEN = [(r"[ \t\r\n]+", "' '"), (r"(?i)<br\s*/?>|</(p|div|tr|li|ul|ol|table|h[1-6]|blockquote|pre|section|article)\s*>", "chr(10)"), (r"(?i)</t[dh]\s*>", "' '"), ("<[^>]*>", "''")]
_TRIMMED = [(r" *\n *", "chr(10)"), (r"\n{2,}", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")]


@query(f"SELECT page_id, md5({_replaced(_decoded(_replaced('html', *_HIDDEN, *_BROKEN)), *_TRIMMED)}) AS digest FROM pages")
def html_plain_text(spark, sf_dir):
    """Plain text of whole pages; the rules for line ends are this library's own."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.html_to_text(F.col("html")).cast("binary")).alias("digest"))


_BARE = "'x' || translate(text, chr(10) || '*`!', '    ')"


@query(
    f"""SELECT conv_id, turn, md5('<h1>' || e || '</h1><ul><li><b>' || e || '</b></li><li><code>' || e || '</code></li></ul><br/><pre>' || e || chr(10) || '</pre><p>see <i>' || e || '</i> <img alt="a" src="b"></p><pre>' || e || chr(10) || '</pre>') AS digest
FROM (SELECT conv_id, turn, replace(replace(replace({_BARE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS e FROM conversations)"""
)
def markdown_preview(spark, sf_dir):
    """Whole texts as heading, items, fences (the last one open) and a paragraph."""
    t = F.concat(F.lit("x"), F.translate("text", "\n*`!", "    "))
    parts = ["# ", t, "\n- **", t, "**\r\n- `", t, "`\n\n```\n", t, "\n```\nsee *", t, "* ![a](b)\n```\n", t]
    own = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(X.markdown_html(own).cast("binary")).alias("digest"))


@query("SELECT benchmark.item_id, md5(regexp_replace(translate(text, 'ＡＢＣ', 'ABC'), '^\\(', '')) AS digest FROM benchmark")
def half_width(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(F.regexp_replace(X.full_to_half(F.col("text")), r"^\(", "").cast("binary")).alias("digest"))


@query("SELECT conv_id, turn, to_json(text)::VARCHAR AS literal FROM conversations")
def json_literals(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.json_string(F.col("text")).alias("literal"))


@query("SELECT item_id, md5('<!doctype html><html><head><meta charset=''utf-8''><title>' || 'a &lt;' || item_id || '&gt;' || '</title></head><body><p>' || replace(replace(replace(translate(text, '*`!#_[]()-+.' || chr(10), '             '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p></body></html>') AS page FROM benchmark")
def preview_pages(spark, sf_dir):
    """A whole preview page for each text of one paragraph."""
    bare = F.translate("text", "*`!#_[]()-+.\n", " " * 13)
    own = table(spark, sf_dir, "benchmark").select("item_id", W.preview_html(bare, F.concat(F.lit("a <"), F.col("item_id").cast("string"), F.lit(">"))).alias("page"))
    return own.select("item_id", F.md5(F.col("page").cast("binary")).alias("page"))


@query("SELECT doc_id AS id, text, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL, quality FROM labels")
def merged_sidecars(spark, sf_dir):
    """Items of a sidecar behind a page's own, with the fields of either."""
    page = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return B.merge_sidecar(page, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality"))
