"""Audit of how far sources diverge: by their shares of terms, source against source of a language,
and which terms a source holds above its language's share.

The terms of a language are those in at least MIN_DOCS of its documents. A group (lang, source) and
the language itself give a term p = 1 + floor(10^9 (count + 1) / (N + V)); two shares differ by
f = floor((p - q)^2 / q). All arithmetic is exact: 10^9 is multiplied in steps of a thousand, so that
counts up to 9 * 10^15 stay within 64 bits, and a sum of f over terms stays below 2^63 for V < 10^9.

Terms are counted in tasks, in a table of at most FLUSH entries, and added up by (lang, source, term). A
language's terms are dealt by hash to blocks and its sources to blocks of about SOURCES; a tile is a
term block with two source blocks. Its counts form a dense int64 matrix, group by term; the pairs of
its groups come from broadcasting the rows of one block against those of the other, over slices of terms
of at most CELLS numbers. Tiles give partial sums for pairs, which are added up, and a heap of the top
terms for each group; heaps are merged, FAN_IN at a time. A tile knows only terms that one of its
groups has; each of the other V - covered terms adds the same f, so it is added by number.

Scale: a tile holds about TILE numbers whatever the number of documents, terms and sources. Pairs grow with
the square of a language's sources because the report names them all. Partial sums, counts and heaps are
combined in tasks before they are shuffled; the driver holds nothing.

Cases: null text, lang and source are ''; a group without terms has count 0 everywhere and takes part in
pairs; V = 0 makes every pair 0; a language of one source has no pairs; equal values rank by the
item's bytes; repeated rows count as documents of their own; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches

MIN_DOCS, TOP = 3, 200
FLUSH = 200_000
SOURCES, TILE, CELLS, FAN_IN = 128, 1 << 17, 1 << 18, 64
UNIT_STEPS = 3  # 10^9 in steps of 1000

#: Letters of ASCII in lower case and all bytes of other characters stand; the rest parts terms.
TERM_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

COUNTED = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, source string, part string, item string, value long, covered long, other long, terms long"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TERM_BYTES).split()


def counted(batches):
    """Terms and documents by group for each stretch of a task's rows; the term '' keeps a group without terms."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0

    def flushed():
        for (lang, source), (counts, docs) in seen.items():
            words = [b"", *counts]
            columns = [pa.repeat(lang, len(words)), pa.repeat(source, len(words)), pa.array(words, pa.binary()).cast(pa.string())]
            numbers = [np.fromiter(x, np.int64, len(words)) for x in ([0, *counts.values()], [0, *map(docs.__getitem__, counts)])]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers)], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text"))):
            counts, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            words, before = terms(text), len(counts)
            counts.update(words)
            docs.update(set(words))
            entries += len(counts) - before
            if entries >= FLUSH:
                yield from flushed()
                seen, entries = {}, 0
    yield from flushed()


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), exactly; total holds a number for each row."""
    rest, below, out = counts + 1, (total + kept)[:, None], np.zeros_like(counts)
    for _ in range(UNIT_STEPS):
        rest *= 1000
        out *= 1000
        out += rest // below
        rest %= below
    return out + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def pair_sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of gap over terms for every row of p against every row of q, in slices of CELLS numbers."""
    out = np.zeros((len(p), len(q)), dtype=np.int64)
    step = max(1, CELLS // max(1, len(p) * len(q)))
    for k in range(0, p.shape[1], step):
        out += gap(p[:, None, k : k + step], q[None, :, k : k + step]).sum(axis=2)
    return out


def top_terms(names, words, counts, p, q) -> list[tuple]:
    """(source, term, value) of the TOP terms above the language's share, for each row."""
    out = []
    values = gap(p, q[None, :])
    for g in range(len(p)):
        at = np.flatnonzero((counts[g] > 0) & (p[g] > q))
        if len(at) > TOP:  # ties with the last one stay for the heap, which knows the terms
            at = at[values[g, at] >= np.partition(values[g, at], len(at) - TOP)[len(at) - TOP]]
        best = heapq.nsmallest(TOP, zip((-values[g, at]).tolist(), [words[t] for t in at]))
        out += [(names[g], word.decode(), -value) for value, word in best]
    return out


def tile(table: pa.Table, low: int, high: int) -> pa.Table:
    """Partial pair sums and heaps of one tile. Rows with the term '' name the tile's groups."""
    lang, kept, lang_n = (table.column(c)[0].as_py() for c in ("lang", "kept", "lang_n"))
    named = pc.equal(table.column("term"), "")
    anchors = table.filter(named).select(["sb", "source", "group_n"]).to_pylist()
    cells = table.filter(pc.invert(named))
    blocks = [low] if low == high else [low, high]
    groups = [sorted((r["source"], r["group_n"]) for r in anchors if r["sb"] == b) for b in blocks]
    names = [[s for s, _ in g] for g in groups]
    coded = {c: pc.dictionary_encode(cells.column(c).combine_chunks()) for c in ("term", "source")}
    known = [t.encode() for t in coded["term"].dictionary.to_pylist()]
    order = sorted(range(len(known)), key=known.__getitem__)
    words = [known[k] for k in order]
    place = np.empty(len(known), np.int64)
    place[order] = np.arange(len(known))
    term = place[coded["term"].indices.to_numpy()] if known else np.zeros(0, np.int64)
    source, n = coded["source"].indices.to_numpy(), cells.column("n").to_numpy()
    counts = []
    for own in names:
        row_of = {s: k for k, s in enumerate(own)}
        row = np.array([row_of.get(s, -1) for s in coded["source"].dictionary.to_pylist()], np.int64)[source] if len(source) else np.zeros(0, np.int64)
        counts.append(np.zeros((len(own), len(words)), np.int64))
        counts[-1][row[row >= 0], term[row >= 0]] = n[row >= 0]
    totals = [np.array([n for _, n in g], dtype=np.int64) for g in groups]
    p = [shares(c, n, kept) if kept else c for c, n in zip(counts, totals)]
    none = [shares(np.zeros((len(n), 1), dtype=np.int64), n, kept)[:, 0] if kept else n for n in totals]  # share of a term that a group lacks
    rows = []
    for a, b in [(0, 0)] if len(blocks) == 1 else [(0, 1), (1, 0)]:
        sums = pair_sums(p[a], p[b])
        other = gap(none[a][:, None], none[b][None, :]) if kept else sums
        rows += [(lang, s, "pair", o, int(sums[i, j]), len(words), int(other[i, j]), kept) for i, s in enumerate(names[a]) for j, o in enumerate(names[b]) if s != o]
    if len(blocks) == 1 and words:
        total = np.zeros((1, len(words)), np.int64)
        total[0, term] = cells.column("total").to_numpy()
        q = shares(total, np.array([lang_n], dtype=np.int64), kept)[0]
        rows += [(lang, s, "term", word, value, 0, 0, 0) for s, word, value in top_terms(names[0], words, counts[0], p[0], q)]
    columns = list(zip(*rows)) or [()] * 8
    kinds = [pa.string()] * 4 + [pa.int64()] * 4
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip([x.split()[0] for x in PARTIAL.split(", ")], columns, kinds)})


def merged(table: pa.Table) -> pa.Table:
    """The TOP entries of a group's heaps."""
    best = heapq.nsmallest(TOP, ((-v, t.encode(), k) for k, (v, t) in enumerate(zip(table.column("value").to_pylist(), table.column("item").to_pylist()))))
    return table.take(pa.array([k for _, _, k in best], pa.int64()))


def merge_heaps(heaps: DataFrame, tiles: int) -> DataFrame:
    """One heap for each group: FAN_IN tiles' heaps meet in a task, as often as the number of tiles needs."""
    while True:
        tiles = -(-tiles // FAN_IN)
        heaps = heaps.withColumn("tb", F.floor(F.col("tb") / FAN_IN).cast("int")).groupBy("lang", "source", "tb").applyInArrow(merged, heaps.schema)
        if tiles <= 1:
            return heaps


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, sources: int = SOURCES, tile_size: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank over `docs` (text, lang, source)."""
    small_batches(docs)
    keep = Scratch(docs.sparkSession, "divergence")
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = texts.mapInArrow(counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    cells = keep(cells, "counts")
    vocabulary = cells.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    vocabulary = keep(vocabulary, "vocabulary")
    kept = keep(cells.where("term <> ''").join(vocabulary, ["lang", "term"]).select("lang", "source", "term", "n", "total"), "kept")

    # numbers of each group and language, and how many blocks their terms and sources need
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = cells.where("term = ''").select("lang", "source").join(own, ["lang", "source"], "left").fillna(0, ["group_n"])
    terms_of = vocabulary.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_n"))
    by_lang = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(terms_of, "lang", "left").fillna(0, ["kept", "lang_n"])
    sbs = F.ceil(F.col("groups") / sources).cast("int")
    wide = F.least(F.col("groups"), F.lit(2 * sources))
    tbs = F.greatest(F.lit(1), F.ceil(F.col("kept") * wide / tile_size)).cast("int")
    by_lang = keep(by_lang.select("lang", "kept", "lang_n", sbs.alias("sbs"), tbs.alias("tbs")), "languages")
    most = by_lang.agg(F.max("tbs")).first()[0] or 1

    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    sized = keep(groups.join(by_lang, "lang").withColumn("sb", block("source", "sbs")), "groups")
    anchors = sized.select("*", F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("total"), F.explode(F.sequence(F.lit(0), F.col("tbs") - 1)).alias("tb"))
    counts = kept.join(sized, ["lang", "source"]).withColumn("tb", block("term", "tbs"))
    dealt = anchors.unionByName(counts).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("sbs") - 1)))
    dealt = dealt.withColumns({"low": F.least("sb", "with"), "high": F.greatest("sb", "with")})
    partial = keep(dealt.groupBy("lang", "tb", "low", "high").applyInArrow(_tile_of, f"tb int, {PARTIAL}"), "tiles")

    pairs = partial.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        (F.sum("value") + (F.max("terms") - F.sum("covered")) * F.max("other")).alias("value")
    )
    heaps = merge_heaps(partial.where("part = 'term'").select("lang", "source", "tb", "part", "item", "value"), most).drop("tb")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.unionByName(heaps).withColumn("rank", F.row_number().over(order))
    return keep.done(ranked.select("lang", "source", "part", "item", "value", "rank"), "divergence-report")


def _tile_of(key: tuple, table: pa.Table) -> pa.Table:
    out = tile(table, key[2].as_py(), key[3].as_py())
    return out.add_column(0, "tb", pa.array([key[1].as_py()] * len(out), pa.int32()))


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share = "CAST(1 + CAST(1000000000 AS HUGEINT) * ({n} + 1) // ({total} + v) AS BIGINT)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
l AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.total), 0) AS lang_n FROM (SELECT DISTINCT lang FROM d) g LEFT JOIN k USING (lang) GROUP BY g.lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce(sum(c.n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) a LEFT JOIN c ON a.lang = c.lang AND a.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, l.v, l.lang_n, {share.format(n="coalesce(c.n, 0)", total="g.group_n")} AS p
    FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
t AS (SELECT lang, source, 'term' AS part, term AS item, p, n, {share.format(n="total", total="lang_n")} AS q FROM p),
u AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value FROM pair UNION ALL SELECT lang, source, part, item, (p - q) * (p - q) // q FROM t WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= {TOP}
"""
