"""Queries over tokens and ids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bytepair as B
from ..operators import tokens as K
from ..operators import vectors as V
from .base import query, table


@query("SELECT vec_id, label, embedding[1] AS head FROM embeddings WHERE vec_id >= 100 AND vec_id < 300")
def embedding_rows(spark, sf_dir):
    return V.rows_between(table(spark, sf_dir, "embeddings"), 100, 200).select("vec_id", "label", F.element_at("embedding", 1).alias("head"))


@query("SELECT conv_id, turn, e.label FROM conversations c JOIN embeddings e ON e.vec_id = c.conv_id % 100")
def embedding_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") % 100).alias("id"))
    vectors = table(spark, sf_dir, "embeddings")
    found = V.lookup(ids, vectors.select("vec_id", "embedding"))
    return found.join(vectors.select(F.col("vec_id").alias("id"), "label"), "id").where(F.size("embedding") > 0).select("conv_id", "turn", "label")


@query("WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM documents), v AS (SELECT t, dense_rank() OVER (ORDER BY t) AS id FROM w WHERE t IN (SELECT DISTINCT t FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS t FROM benchmark)) GROUP BY t) SELECT doc_id, count(*) AS known FROM w JOIN v USING (t) WHERE t <> '' GROUP BY doc_id")
def vocabulary_ids(spark, sf_dir):
    """Words of documents that a vocabulary (the benchmark's words) knows; others go, as it has no unknown token."""
    words = lambda df, k: df.select(k, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''")
    vocabulary = words(table(spark, sf_dir, "benchmark"), "item_id").select("token").distinct().withColumn("id", F.xxhash64("token"))
    found = K.ids_of(words(table(spark, sf_dir, "documents"), "doc_id"), vocabulary)
    return found.groupBy("doc_id").agg(F.count("*").alias("known"))


@query(
    """WITH h AS (SELECT l_orderkey, list(CAST(l_partkey % 3 AS INTEGER) ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS h FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN len(h) < 2 THEN [] ELSE [h[CAST(i + 1 AS BIGINT)] FOR i IN range(1, len(h)) IF h[CAST(i AS BIGINT)] = h[len(h)]] END AS banned FROM h"""
)
def banned_tokens(spark, sf_dir):
    order = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
    return own.select("l_orderkey", K.banned_tokens(F.transform("s", lambda x: (x["l_partkey"] % 3).cast("int")), 2).alias("banned"))


@query(
    """WITH d AS (SELECT o_orderkey, [CAST(x AS INTEGER) FOR x IN string_split(CAST(o_orderkey * 9 + o_custkey AS VARCHAR), '')] AS d FROM orders), p AS (SELECT *, coalesce(list_position(d, 9), 0) AS p FROM d)
SELECT o_orderkey, CASE WHEN p = 0 THEN d ELSE list_concat(list_concat(d[:p - 1], [9, 9, 9]), d[p + 1:]) END AS ids FROM p"""
)
def placeholder_expansion(spark, sf_dir):
    """Digits of a number as tokens; the first nine among them is the placeholder."""
    digits = F.transform(F.split((F.col("o_orderkey") * 9 + F.col("o_custkey")).cast("string"), ""), lambda x: x.cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", K.expand_pads(digits, 9, 3).alias("ids"))


@query("SELECT item_id, '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || '<|vision_start|><|image_pad|><|vision_end|>' || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt FROM benchmark")
def chat_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", K.chat_prompt(F.col("text")).alias("prompt"))


@query(
    """WITH n AS (SELECT o_orderkey, CAST(o_custkey % 5 AS INTEGER) + 1 AS a, CAST(o_orderkey % 4 AS INTEGER) AS b FROM orders)
SELECT o_orderkey, list_concat(list_concat(range(0, a), [a, a, a, a, a, a]), [a + 3 + j FOR j IN range(0, b)]) AS t, list_concat(list_concat(range(0, a), [a, a, a, a + 1, a + 1, a + 1]), [a + 3 + j FOR j IN range(0, b)]) AS h,
  list_concat(list_concat(range(0, a), [a, a + 1, a + 2, a, a + 1, a + 2]), [a + 3 + j FOR j IN range(0, b)]) AS w FROM n"""
)
def position_ids(spark, sf_dir):
    """Texts of one to five tokens before an image of two by three cells, and of none to three behind it."""
    text = lambda n: F.array_repeat(F.lit(5), n.cast("int"))
    ids = F.concat(text(F.col("o_custkey") % 5), F.array(F.lit(7)), F.array_repeat(F.lit(9), 6), text(F.col("o_orderkey") % 4))
    own = table(spark, sf_dir, "orders").select("o_orderkey", ids.alias("ids"))
    p = K.rope_index(F.col("ids"), 1, 4, 6, 2, 9, 7)
    return own.select("o_orderkey", *[p[k].cast("array<long>").alias(k) for k in ("t", "h", "w")])


# the pattern without its look ahead: the texts have no runs of blanks before figures, where alone that changes the number
@query(
    """SELECT doc_id, len(regexp_extract_all(nfc_normalize(text), '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\\r\\n\\p{L}\\p{N}]?\\p{L}+|\\p{N}| ?[^\\s\\p{L}\\p{N}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+'))::INTEGER AS pieces FROM documents"""
)
def token_pieces(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(K.pieces(F.col("text"))).alias("pieces"))


# only pairs of letters have a rank, so merging by rank is one replacement for each rank in turn
@query(
    """WITH RECURSIVE l AS (SELECT regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS t FROM benchmark), p AS (SELECT unnest([t[i:i + 1] FOR i IN range(1, length(t))]) AS p FROM l),
k AS (SELECT p, row_number() OVER (ORDER BY count(*) DESC, p) AS r FROM p WHERE p NOT LIKE '% %' AND length(p) = 2 GROUP BY p),
w AS (SELECT conv_id, turn, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM conversations),
s AS (SELECT DISTINCT w, CAST(0 AS BIGINT) AS r, '|' || array_to_string(string_split(w, ''), '||') || '|' AS s FROM w WHERE w <> ''
  UNION ALL SELECT w, k.r, replace(s, '|' || p[1] || '||' || p[2] || '|', '|' || p || '|') FROM s JOIN k ON k.r = s.r + 1),
n AS (SELECT w, max_by((length(s) - length(replace(s, '|', ''))) // 2, r) AS n FROM s GROUP BY w)
SELECT conv_id, turn, sum(n)::BIGINT AS symbols FROM w JOIN n USING (w) GROUP BY conv_id, turn"""
)
def merged_symbols(spark, sf_dir):
    """Byte-pair merges with the rank of a pair given by its frequency among neighbouring letters of the benchmark."""
    letters = table(spark, sf_dir, "benchmark").select(F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("t"))
    pairs = letters.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("t") - 1), lambda i: F.substring("t", i, F.lit(2)))).alias("p")).where("p NOT LIKE '% %' AND length(p) = 2")
    # 26 * 26 pairs at most
    ranked = pairs.groupBy("p").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "p"))).collect()
    ranks = {(r["p"][0], r["p"][1]): r["r"] for r in ranked}
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("w <> ''")
    return words.select("conv_id", "turn", F.size(K.bpe(F.col("w"), ranks)).alias("n")).groupBy("conv_id", "turn").agg(F.sum("n").alias("symbols"))


@query("SELECT doc_id, CASE WHEN octet_length(encode(trim(text, ' ' || chr(10)))) < 8 THEN NULL ELSE 2048 END AS size FROM documents")
def byte_feature_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", K.byte_features(F.col("text").cast("binary")).alias("f")).select("doc_id", F.when(F.col("f").isNotNull(), F.size("f")).alias("size"))


@query("SELECT p_partkey AS id, p_name AS token, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS rank FROM part")
def special_token_order(spark, sf_dir):
    own = K.specials_first(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("token")))
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length("token")), "id")))


#: A small vocabulary whose merges build on merges: the 256 bytes, then these (by the letters that stand for bytes), then specials.
MERGES = [("t", "h"), ("th", "e"), ("e", "r"), ("i", "n"), ("in", "g"), ("a", "n"), ("an", "d"), ("Ġ", "the"), ("o", "n"), ("i", "on"), ("t", "ion"), ("Ã", "©"), ("th", "er"), ("e", "e"), ("ing", "ing"), ("Ġ", "and")]
SPECIALS = {"<|im_start|>": 300, "<|im_start|>user": 301, "<|im_end|>": 302}


def small_codec() -> B.Codec:
    vocab = {c: b for b, c in enumerate(B.byte_letters())} | {a + b: 256 + k for k, (a, b) in enumerate(MERGES)}
    return B.Codec(vocab, MERGES, SPECIALS)


def merging_sql(hexes: str) -> str:
    """Merges in their order over text of hexadecimal bytes, each symbol between bars: a merge's symbols are never made by a later one."""
    of = {c: f"{b:02X}" for b, c in enumerate(B.byte_letters())}
    spelled = lambda s: "".join(of[c] for c in s)
    for a, b in MERGES:
        hexes = f"replace({hexes}, '|{spelled(a)}||{spelled(b)}|', '|{spelled(a + b)}|')"
    return hexes


def ids_sql() -> str:
    of = {c: f"{b:02X}" for b, c in enumerate(B.byte_letters())}
    merged = ", ".join(f"'{''.join(of[c] for c in a + b)}': '{256 + k}'" for k, (a, b) in enumerate(MERGES))
    return "CASE WHEN length(x) = 2 THEN CAST(CAST('0x' || x AS INTEGER) AS VARCHAR) ELSE MAP {" + merged + "}[x] END"


# white space is split in DuckDB by a pattern without look ahead, as above: runs of blanks before letters do not occur
@query(
    f"""WITH p AS (SELECT doc_id, nfc_normalize(chr(10) || text) AS t, regexp_extract_all(nfc_normalize(chr(10) || text), '(?i:''s|''t|''re|''ve|''m|''ll|''d)|[^\\r\\n\\p{{L}}\\p{{N}}]?\\p{{L}}+|\\p{{N}}| ?[^\\s\\p{{L}}\\p{{N}}]+[\\r\\n]*|\\s*[\\r\\n]+|\\s+') AS p FROM documents),
h AS (SELECT doc_id, t, array_to_string([{merging_sql("regexp_replace(hex(encode(x)), '(..)', '|\\1|', 'g')")} FOR x IN p], '') AS h FROM p),
i AS (SELECT doc_id, t, array_to_string([{ids_sql()} FOR x IN string_split(trim(h, '|'), '||')], ',') AS ids FROM h)
SELECT doc_id, md5('301,' || ids || ',302') AS ids, len(string_split(ids, ',')) + 2 AS n, md5('<|im_start|>user' || t || '<|im_end|>') AS back, md5(t) AS plain FROM i"""
)
def codec_round_trip(spark, sf_dir):
    """Whole texts between special tokens, of which the longer one must be found: ids, and both ways of decoding."""
    codec = small_codec()
    text = F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|>"))
    # dealt out first: a file is read by as many tasks as it has row groups, which may be one
    own = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text").repartition("doc_id").select("doc_id", B.encoded(text, codec).alias("k"))
    md5 = lambda c: F.md5(c.cast("binary"))
    return own.select("doc_id", md5(F.array_join("k", ",")).alias("ids"), F.size("k").cast("long").alias("n"), md5(B.decoded(F.col("k"), codec)).alias("back"), md5(B.decoded(F.col("k"), codec, True)).alias("plain"))
