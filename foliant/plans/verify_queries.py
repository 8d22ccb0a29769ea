"""Queries that check sets of files: expected against actual, keys, manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import verify as C
from ..sources import readers as R
from ..sources import writers as W
from .base import query, table

_FILES = """e AS (SELECT 'f' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT 'f' || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'x' ELSE text END) AS sha256 FROM documents WHERE doc_id % 11 <> 0)"""


@query(f"WITH {_FILES} SELECT path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unexpected' WHEN a.sha256 = e.sha256 THEN 'ok' ELSE 'mismatched' END AS state FROM e FULL JOIN a USING (path)")
def reconciled_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    expected = docs.where("doc_id % 7 <> 0").select("path", sha(F.col("text")).alias("sha256"))
    actual = docs.where("doc_id % 11 <> 0").select("path", sha(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("sha256"))
    return C.reconcile(expected, actual)


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def repeated_texts(spark, sf_dir):
    return C.duplicate_keys(table(spark, sf_dir, "documents"), "text")


@query("SELECT url_host AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM (SELECT *, regexp_extract(url, '^https?://([^/]+)', 1) AS url_host FROM pages) GROUP BY 1")
def first_page_of_host(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id", "url")
    return C.first_by(own, "host", "page_id")


@query("SELECT count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents")
def checked_totals(spark, sf_dir):
    return C.totals(table(spark, sf_dir, "documents").select(F.octet_length("text").alias("bytes")))


@query(
    """SELECT page_id, length(p) > 0 AND p <> '.' AND NOT regexp_matches(p, '^([A-Za-z]:|[/\\\\])') AND NOT list_contains(string_split(replace(p, '\\', '/'), '/'), '..') AS safe,
  regexp_matches(sha256(html), '^[0-9a-f]{64}$') AS shaped FROM (SELECT *, CASE page_id % 5 WHEN 0 THEN '../' || page_id WHEN 1 THEN '/abs' WHEN 2 THEN 'C:\\x' WHEN 3 THEN 'a/b..c' ELSE url END AS p FROM pages)"""
)
def safe_paths(spark, sf_dir):
    k = F.col("page_id") % 5
    p = F.when(k == 0, F.concat(F.lit("../"), F.col("page_id").cast("string"))).when(k == 1, "/abs").when(k == 2, "C:\\x").when(k == 3, "a/b..c").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", C.is_safe_path(p).alias("safe"), C.is_sha256(F.sha2(F.col("html").cast("binary"), 256)).alias("shaped"))


@query("SELECT 'f' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def checksum_lines(spark, sf_dir):
    """Checksum lines written and parsed again."""
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.sha2(F.col("text").cast("binary"), 256), F.lit("  f"), F.col("doc_id").cast("string"), F.lit(".txt\r"))
    return R.checksum_rows(docs.select(line.alias("value")))


@query("SELECT conv_id, text AS reference FROM conversations WHERE turn = 0")
def audio_with_reference(spark, sf_dir):
    own = table(spark, sf_dir, "conversations")
    audio = own.select("conv_id", F.concat(F.lit("in/"), F.col("conv_id").cast("string"), F.lit(".wav")).alias("path")).distinct()
    refs = own.where("turn = 0").select(F.concat(F.lit("ref/"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("path"), "text")
    return C.stem_join(audio, refs).select("conv_id", "reference")


@query("SELECT page_id, regexp_matches(lower(url), '\\.(png|jpg|jpeg|bmp|tif|tiff|webp)$') AS image, regexp_matches(lower(url || '.WAV'), '\\.(wav|mp3|m4a|flac|aac|opus)$') AS audio FROM pages")
def path_kinds(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", R.is_image_path(F.col("url")).alias("image"), R.is_audio_path(F.concat("url", F.lit(".WAV"))).alias("audio"))


@query("SELECT text FROM documents EXCEPT SELECT text FROM benchmark")
def texts_not_in_benchmark(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("text").subtract(table(spark, sf_dir, "benchmark").select("text"))


@query("SELECT source AS name, list_sort(list_distinct(list(lang))) AS kinds FROM documents GROUP BY source")
def union_of_sets(spark, sf_dir):
    own = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.collect_set("lang").alias("a"))
    return own.select("name", F.array_sort(F.array_union("a", F.array().cast("array<string>"))).alias("kinds"))


@query("SELECT l_orderkey AS page, 800 AS width, CAST(count(*) AS BIGINT) AS dets, 'w' AS weight FROM lineitem GROUP BY 1")
def layout_documents(spark, sf_dir):
    """Layout documents written as JSON and read again."""
    from ..operators.layout import pages_of
    from .layout_queries import boxes

    pages = pages_of(boxes(spark, sf_dir)).withColumns({"width": F.lit(800), "height": F.lit(1000)})
    made = W.layout_json(pages, "e", "w", "cpu").select("page", F.from_json("json", R.LAYOUT).alias("j"))
    return made.select("page", F.element_at("j.page_size", 1).alias("width"), F.size("j.dets").cast("long").alias("dets"), "j.weight")


@query("SELECT conv_id AS clip, CAST(2 AS INTEGER) AS version, string_agg(text, '' ORDER BY turn) AS text, CAST(count(*) AS INTEGER) AS segments FROM conversations GROUP BY 1")
def transcripts(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip"), F.col("turn").alias("idx"), F.col("turn").cast("double").alias("start"), (F.col("turn") + 1).cast("double").alias("end"), "text",
        F.when(F.col("role") == "assistant", 0.9).alias("confidence"), F.lit(10.0).alias("duration"),
    )
    made = W.transcript_json(own, "m", "cpu")
    parsed = F.from_json("json", "schema_version int, text string, segments array<struct<start:double>>")
    return made.select("clip", parsed.alias("j")).select("clip", F.col("j.schema_version").alias("version"), "j.text", F.size("j.segments").alias("segments"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%d-%H%M%S') || '_scan' || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '_' || row_number() OVER w END AS folder FROM orders WINDOW w AS (PARTITION BY o_orderdate ORDER BY o_orderkey)")
def job_folders(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("in/scan.png").alias("source"), F.col("o_orderdate").alias("ts"))
    return W.job_names(jobs).select("id", "folder")


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS slices, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def slices_as_json(spark, sf_dir):
    item = F.struct(F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"), F.col("l_partkey").alias("offset"), F.lit(1).cast("long").alias("n_samples"))
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(item).alias("s"))
    back = own.select("l_orderkey", W.slices_from_json(W.slices_to_json(F.col("s"))).alias("s"))
    return back.select("l_orderkey", F.size("s").alias("slices"), F.aggregate("s", F.lit(0.0), lambda a, x: a + x["start"]).alias("total"))
