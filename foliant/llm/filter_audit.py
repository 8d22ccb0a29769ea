"""Audit of how filters overlap: what each removes, in every order of applying them.

Five filters fail a text: A few words, B repeated words, C many capitals, D symbols, E a copy of a text
with a smaller doc_id. All orders follow from one count: how many documents of a part fail exactly
which filters (32 masks at most). Documents are read once for the masks and only numbers move.

Copies are told by refinement of a partition. Texts fall into classes by their number of code
points, then by the hash of their first block, of the next, and so on, each block four times as long
as the one before; after each step a class of one row is dropped, so that few rows are left after the
first block. All hashes are taken while the text is read, and a step moves a row's numbers only. The
full texts of the classes left are then compared: a class whose smallest and largest text are the
same holds copies, and rows beyond its smallest id are marked. Should a class hold several texts (a
collision), its rows are grouped by their texts instead.

Scale: class sizes, smallest ids and smallest texts are aggregates, combined in each task, so a class
of a third of all rows is one row for each task. Rows meet their classes by joins whose other side
has one row for each key. Classes are broadcast only up to BROADCAST_KEYS, which is counted; beyond
it the texts to compare are dealt by class and salt.

Cases: a null text is the empty one, so null and empty texts are copies of each other; a null lang is
the part ''; a null doc_id neither makes a copy nor is one; rows that share the smallest id are all
first; a document counts as good or toxic if any of its label rows says so; labels without a document
count nowhere; an empty table has no parts. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, Scratch

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Block k begins at FIRST_BLOCK * (4^k - 1) / 3 and ends where the next begins; they reach 2^31 code points.
FIRST_BLOCK = 256
BLOCKS = [(FIRST_BLOCK * (4**k - 1) // 3, FIRST_BLOCK * 4**k) for k in range(12)]
BROADCAST_KEYS, SALTS = 1 << 20, 64


def failing(text: Column, words: Column) -> Column:
    """Letters of the filters A to D that a text fails."""
    n, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = chars - F.length(F.translate(text, UPPER, ""))
    tests = {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * capitals > 3 * chars, "D": text.rlike(r"[#$%&*|]")}
    return F.concat(*[F.when(test, letter).otherwise("") for letter, test in tests.items()])


def class_key(steps: int, bits: int = 64) -> Column:
    """Class after so many block hashes; a text that ended before keeps the one that it has."""
    key = F.xxhash64("length", *[F.col("blocks")[k] for k in range(steps)])
    return key if bits == 64 else F.shiftrightunsigned(key, 64 - bits)


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, text, fails (letters of A to D), length and the hashes of the text's blocks."""
    text = F.col("text")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "), ""))
    return rows.select(
        "doc_id", "part", "text", failing(text, F.col("words")).alias("fails"), F.length("text").alias("length"),
        F.array(*[F.when(F.length("text") > at, F.xxhash64(text.substr(at + 1, size))) for at, size in BLOCKS]).alias("blocks"),
    )


def refined(rows: DataFrame, keep: Scratch, bits: int = 64) -> DataFrame:
    """Keys of the classes that have several rows after all blocks, one row each."""
    alive, steps = rows.select("length", "blocks"), 0
    while True:
        own = alive.withColumn("key", class_key(steps, bits))
        several = own.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        alive = keep(own.join(several, "key", "left_semi").drop("key"), f"step{steps}")
        longest = alive.agg(F.max("length")).first()[0] or 0
        if steps == len(BLOCKS) or longest <= BLOCKS[steps][0]:  # no block is left to tell them apart
            return keep(alive.select(class_key(len(BLOCKS), bits).alias("key")).distinct(), "keys")
        steps += 1


def among(texts: DataFrame, keys: DataFrame, n_keys: int) -> DataFrame:
    """Rows of these classes, whole texts included."""
    if n_keys <= BROADCAST_KEYS:
        return texts.join(F.broadcast(keys), "key", "left_semi")
    salted = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return texts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"], "left_semi").drop("salt")


def with_copies(docs: DataFrame, keep: Scratch, bits: int = 64) -> DataFrame:
    """doc_id, part, fails: the letters of all filters that a document fails, E for copies.

    `bits` shortens the classes' keys: fewer make more texts meet in a class, the marks stay as they are."""
    whole = masked(docs)
    key = class_key(len(BLOCKS), bits)
    rows = keep(whole.select("doc_id", "part", "fails", "length", "blocks"), "masks")
    keys = refined(rows, keep, bits)
    texts = among(whole.withColumn("key", key), keys, keys.count())
    same = F.min("text") == F.max("text")
    classes = keep(texts.groupBy("key").agg(F.min("doc_id").alias("first"), same.alias("same")), "classes")
    rows = rows.select("doc_id", "part", "fails", key.alias("key"))
    several = classes.where(~F.col("same")).select("key")
    parts = [rows.join(classes, "key", "left").where(F.coalesce("same", F.lit(True)))]
    if n := several.count():
        apart = among(whole.withColumn("key", key), several, n).select("doc_id", "part", "fails", "key", "text")
        first = apart.groupBy("key", "text").agg(F.min("doc_id").alias("first"))
        parts.append(apart.join(first, ["key", "text"]))
    copy = F.when(F.col("doc_id") > F.col("first"), "E").otherwise("")
    return reduce(DataFrame.unionByName, [p.select("doc_id", "part", F.concat("fails", copy).alias("fails")) for p in parts])


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, fails, n, good, toxic: documents of a part that fail exactly these filters."""
    said = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    total = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c)
    return rows.join(known, "doc_id", "left").groupBy("part", "fails").agg(F.count("*").alias("n"), total("good"), total("toxic"))


def in_every_order(counts: DataFrame) -> DataFrame:
    """The report: one row for each part, order of the filters and step."""
    masks = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = masks.withColumn("filter_order", F.explode(F.split(F.lit(",".join(ORDERS)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    own, before = F.col("filter_order").substr(F.col("step"), F.lit(1)), F.col("filter_order").substr(F.lit(1), F.col("step") - 1)
    rows = rows.withColumns({"own": own, "before": before})
    fails = lambda m: F.contains(m["fails"], F.col("own"))
    passed = lambda m: F.call_function("translate", m["fails"], F.col("before"), F.lit("")) == m["fails"]

    def total(where, value=lambda m: m["n"]):
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda s, m: s + value(m))

    removed = lambda m: fails(m) & passed(m)
    return rows.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & passed(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & ~passed(m)).alias("redundant"),
        total(lambda m: m["fails"] == F.col("own")).alias("unique_fails"), total(removed, lambda m: m["good"]).alias("good_lost"), total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # the first of the failing filters removes a document, and each of them is first in the same number of orders
        total(fails, lambda m: m["n"] * F.floor(F.lit(len(ORDERS)) / F.length(m["fails"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64) -> DataFrame:
    """Counts of the five filters over `docs` (doc_id, text, lang), in all 120 orders."""
    keep = Scratch(docs.sparkSession, "filter-audit")
    return keep.done(in_every_order(mask_counts(with_copies(docs, keep, bits), labels)), "filter-report")


def oracle() -> str:
    orders = ", ".join(f"'{o}'" for o in ORDERS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT doc_id, part, concat(
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, fails),
o AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM (SELECT unnest([{orders}]) AS filter_order)),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o),
x AS (SELECT c.*, s.*, contains(fails, own) AS hit, length(translate(fails, before, '')) = length(fails) AS open FROM c CROSS JOIN s),
r AS (SELECT part, filter_order, step, own, sum(CASE WHEN NOT hit AND open THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit AND open THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit AND NOT open THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit AND open THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit AND open THEN toxic ELSE 0 END) AS toxic_lost
    FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
