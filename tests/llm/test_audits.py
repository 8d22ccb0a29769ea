"""Filter audit, source divergence and licence scans against plain computations, and their edge cases."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import divergence, filter_audit, licenses

DOCS = "doc_id long, text string, lang string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    texts = [(d, t or "", lang or "") for d, t, lang in docs]
    first = {}
    for d, t, _ in texts:
        if d is not None:
            first[t] = min(first.get(t, d), d)
    counts = defaultdict(Counter)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    rows = []
    for d, t, part in texts:
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t],
        }
        rows.append((part, {k for k, v in fails.items() if v}, d in good, d in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                hit = [r for r in left if f in r[1]]
                again = [r for r in gone if f in r[1]]
                left = [r for r in left if f not in r[1]]
                gone += hit
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, step] = [len(left), len(hit), len(again), alone, sum(r[2] for r in hit), sum(r[3] for r in hit)]
                counts[part][f] += len(hit)
    return sorted((p, o, s, *v, counts[p][o[s - 1]]) for (p, o, s), v in out.items())


def audit_rows(seed):
    rng = random.Random(seed)
    base = [" ".join(rng.choice(["alpha", "Beta", "#x", "gamma", "ÉTÉ", "𝄞", "z%"]) + str(rng.randrange(k)) for _ in range(n)) for n, k in ((3, 2), (250, 400), (260, 3), (400, 900), (199, 500), (200, 500))]
    base += [b[:-1] + "!" for b in base]  # same length, other end
    base += [None, "", " \n\t", "x" * 5000, "x" * 4999 + "y", "x" * 255 + "y" * 10, "x" * 255 + "z" * 10]
    rows = [(rng.choice([None, *range(60)]), rng.choice(base), rng.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(rng.randrange(70), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("seed,bits", [(1, 64), (2, 64), (3, 3)])
def test_audit_against_brute_force(spark, seed, bits):
    """Nulls, repeated and tied ids, clashing columns; with three bits for a class most classes hold several texts."""
    rows, labels = audit_rows(seed)
    docs = spark.createDataFrame([(d, t, lang, "s") for d, t, lang in rows], DOCS).withColumns({"key": F.lit("k"), "fails": F.lit(1), "part": F.lit("p"), "good": F.lit(3)})
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("q"))
    got = filter_audit.audit(docs, known, bits)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7


def test_audit_salted_classes(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_KEYS", 0)
    rows, labels = audit_rows(5)
    docs = spark.createDataFrame([(d, t, lang, "s") for d, t, lang in rows], DOCS)
    assert sorted(map(tuple, filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())) == plain_audit(rows, labels)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], DOCS)
    assert filter_audit.audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_refinement_drops_singletons_block_by_block(spark):
    """Two texts that differ beyond the first blocks part late; a long text alone in its length goes at once."""
    same, long = "w " * 3000, "q" * 40_000
    docs = spark.createDataFrame([(1, same, "en", "s"), (2, same, "en", "s"), (3, same[:-2] + "v ", "en", "s"), (4, long, "en", "s")], DOCS)
    keep = filter_audit.Scratch(spark, "refine")
    whole = filter_audit.masked(docs)
    assert filter_audit.refined(whole.select("length", "blocks"), keep).count() == 1


def plain_divergence(rows, min_docs=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        w = words(text)
        docs[lang or ""].update(set(w))
        counts[lang or "", source or ""].update(w)
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        groups = {s: c for (a, s), c in counts.items() if a == lang}

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in groups.items()}, share(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            over = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k) for k, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def divergence_rows(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("é", "ß", "𝄞", "a", "b", "Zz") for b in ("x", "é", "ü", "q", "w", "ab", "日本")]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", ",", "1", "\n", "_"]) for _ in range(rng.randrange(30))), rng.choice(["en", "de", "de", None]), rng.choice([None, "", "a", "b", "é", "c1", "c2"])) for _ in range(n)]
    return rows + [(None, "en", "empty"), ("", "fr", "one"), ("rare words only", "it", "x"), ("other rare", "it", "y"), rows[0], rows[0]]


@pytest.mark.parametrize("seed,size", [(1, {}), (2, {"sources": 2, "tile_size": 40}), (3, {"sources": 1, "tile_size": 1})])
def test_divergence_against_brute_force(spark, seed, size, monkeypatch):
    """One tile; several term and source blocks; a tile for each term and pair of sources, whose heaps merge in three rounds."""
    if size:
        monkeypatch.setattr(divergence, "FAN_IN", 4)
    rows = divergence_rows(seed)
    docs = spark.createDataFrame([(t, lang, s) for t, lang, s in rows], "text string, lang string, source string").withColumns({"n": F.lit(1), "term": F.lit("t"), "total": F.lit(9), "tb": F.lit(0)})
    assert sorted(map(tuple, divergence.divergences(docs.repartition(3), **size).collect())) == plain_divergence(rows)


def test_divergence_flushes_and_nothing(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "FLUSH", 5)
    rows = divergence_rows(4)
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] or "" for r in rows], "source": [r[2] or "" for r in rows], "text": [r[0] or "" for r in rows]})
    out = list(divergence.counted([batch]))
    assert len(out) > 20 and sum(b.num_rows for b in out) > 0
    assert divergence.divergences(spark.createDataFrame([], DOCS)).count() == 0


def test_top_terms_are_cut_with_ties(spark):
    """A group with 700 terms above the language's share, most of them tied, in many tiles."""
    name = lambda k: "".join(chr(97 + int(c)) for c in f"{k:03d}")
    rows = [(" ".join(name(k) for k in range(700)), "en", "a")] * 3 + [(" ".join(name(k) * 2 for k in range(400)) + " aaa", "en", s) for s in "bbbc"]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = sorted(map(tuple, divergence.divergences(docs, tile_size=150).collect()))
    assert got == plain_divergence(rows) and max(r[5] for r in got) == 200


def test_shares_are_exact_for_huge_counts():
    rng = random.Random(3)
    for _ in range(200):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(total)
        assert int(divergence.shares(np.array([[count]]), np.array([total]), 7)[0, 0]) == 1 + 10**9 * (count + 1) // (total + 7)


TEMPLATES = [
    ("opt", "alpha <<beginOptional>>beta <<beginOptional>>gamma <<endOptional>><<endOptional>>delta"),
    ("var", 'one <<var;name="v";original="x";match=".{1,3}">> two'),
    ("none", 'one <<var;name="v";original="x";match=".{0,2}">> three'),
    ("alt", '<<var;name="v";original="x";match="alpha|alpha beta|two">> one one'),
    ("self", "one one one two"),
]


def plain_scan(text, base, templates):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for label, p in base.items()}
    places = {k: v for k, v in places.items() if v}
    joined = " " + "".join(w + " " for w in words)
    hit = [(label, m) for label, m in templates if re.search(" " + licenses.as_regex(licenses.parse(m)), joined)]
    every = [i for v in places.values() for i in v]
    weight = [n / (n + licenses.EVIDENCE) for n in [len(base[x].split()) for x in places] + [licenses.mandatory(licenses.parse(m)) for _, m in hit]]
    return (len(words), len(every), min(every, default=None), max(every, default=None), ",".join(sorted(places)), ",".join(sorted({*places, *(x for x, _ in hit)})), max(weight, default=0.0))


@pytest.mark.parametrize("stretch", [1, 17, 1 << 20])
def test_automaton_against_regular_expressions(stretch):
    rng = random.Random(11)
    base = {"b-one": "one two", "a-two": "two one two"}
    scanner = licenses.compiled(base, TEMPLATES).scanner()
    for _ in range(1500):
        text = "".join(rng.choice(["one", "ONE", "two", "three", "alpha", "beta", "gamma", "delta", "x", "é", "1"]) + rng.choice([" ", "\n", ", ", "-", "--", "."]) for _ in range(rng.randrange(40)))
        assert scanner.document(text, stretch) == plain_scan(text, base, TEMPLATES), text


def test_known_wording():
    mit = licenses.TEXTS["mit"]
    text = "Copyright (c) 2020 Someone\n" + licenses.MARK.sub(lambda m: "these things" if m[2] else "", mit)
    scanner = licenses.compiled().scanner()
    assert scanner.document(text)[5] == "mit"
    assert scanner.document(text.replace("substantial", "important"))[5] == ""  # mandatory wording must match
    assert scanner.document("Licensed under the Apache License, Version 2.0.")[1:] == (1, 3, 3, "apache-2", "apache-2", 6 / 10)
    assert scanner.document("Licensed under CC BY-NC 4.0.")[4:6] == ("cc-by-nc", "cc-by-nc")
    assert scanner.document("This work is licensed under the GNU General Public License, version 3.")[4:6] == ("", "gpl-3")
    assert scanner.document("This tool of ours is under the terms of the GNU General Public License, version 2.")[5] == ""
    assert scanner.document("released under a Creative Commons Attribution-NonCommercial licence")[4:6] == ("", "cc-by-nc")


@pytest.mark.parametrize("markup", ["a <<beginOptional>>b", "a<<endOptional>>", 'a <<var;name="x";original="y";match=".+">>', "<<beginOptional>>a<<endOptional>>", "a <<other>>", 'a <<var;name="x";original="y";match="b|">>'])
def test_markup_that_is_refused(markup):
    with pytest.raises(ValueError):
        licenses.compiled({}, [("x", markup)])


def test_first_words_of_any_kind_are_refused():
    with pytest.raises(ValueError):
        licenses.compiled({}, [("x", '<<var;name="x";original="y";match=".{0,2}">> b')]).scanner()


def test_scan_of_a_table(spark):
    long = "word " * 50_000 + "under the MIT\n\nLicense" + " tail" * 300_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "cc by-nc"), (4, long), (4, long), (5, "é日本 under the mit license,under THE mit license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("mine"))
    out = licenses.scanned(docs, stretch=1000)
    assert out.columns == ["doc_id", "text", "license", "license_"]
    got = sorted((tuple(r["license_"]) for r in out.collect()), key=repr)
    none = (0, 0, None, None, "", "", 0.0)
    mit = (350_004, 1, 50_000, 50_000, "mit", "mit", 0.5)
    assert got == sorted([none, none, none, (3, 1, 0, 0, "cc-by-nc", "cc-by-nc", 3 / 7), mit, mit, (9, 2, 1, 5, "mit", "mit", 0.5)], key=repr)
    assert licenses.scanned(docs.limit(0)).count() == 0
