"""Language ID, quality rules, BPE: edge cases, brute force, accuracy."""

import hashlib
import random
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import bpe, langid, quality, queries

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", None) for i, t in enumerate(texts)], DOCS)


def sequences(text):
    """Symbols of a text by the rule: lower case, each run of non-letters one blank, one at either end."""
    out = [" "]
    for c in text.lower():
        if c.isalpha():
            out.append(c)
        elif out[-1] != " ":
            out.append(" ")
    return out if out[-1] == " " else [*out, " "]


def plain_kneser_ney(texts):
    """Interpolated Kneser-Ney with dictionaries: the cost of a text."""
    top = Counter()
    for t in texts:
        s = [" "] * 3 + sequences(t)[0:]
        top.update(tuple(s[i - 3 : i + 1]) for i in range(4, len(s)))
    counts = {4: top}
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    d, total, kinds = {}, {}, {}
    for order, own in counts.items():
        n1, n2 = sum(v == 1 for v in own.values()), sum(v == 2 for v in own.values())
        d[order] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[order], kinds[order] = Counter(), Counter()
        for g, v in own.items():
            total[order][g[:-1]] += v
            kinds[order][g[:-1]] += 1
    vocabulary = len(counts[1]) + 1

    @cache
    def p(g):
        order = len(g)
        if order == 0:
            return 1 / vocabulary
        if not total[order][g[:-1]]:
            return p(g[1:])
        t = total[order][g[:-1]]
        return max(counts[order][g] - d[order], 0) / t + d[order] * kinds[order][g[:-1]] / t * p(g[1:])

    def cost(text):
        s = [" "] * 3 + sequences(text)
        return -sum(np.log(p(tuple(s[i - 3 : i + 1]))) for i in range(4, len(s)))

    return cost


def scorers(spark, model):
    return [langid.Scorer(model, langid.shard(spark, model, k), k) for k in range(model.shards)]


@pytest.mark.parametrize("cells", [langid.SHARD_CELLS, 300])
def test_costs_against_plain_kneser_ney(spark, cells):
    """One shard or many: every text's cost in every language equals that of a plain model."""
    rng = random.Random(4)
    words = {"en": "the cat and dog are here with all others of them now", "de": "der hund und die katze sind nicht hier mit ändern", "fr": "le chat été ça où est-il", "xx": chr(0x30000) + "ab " + chr(0x31350) + " q"}
    texts = {lang: [" ".join(rng.choices(w.split(), k=rng.randrange(1, 12))) for _ in range(25)] for lang, w in words.items()}
    rows = [(i, t, lang, "s", None) for i, (lang, t) in enumerate((lang, t) for lang, own in texts.items() for t in own)]
    model = langid.fit(spark.createDataFrame(rows, DOCS), F.lit(True), shard_cells=cells)
    assert model.langs == sorted(words) and (model.shards > 5 if cells == 300 else model.shards == 1)
    asked = ["the dog, the CAT!", "hund katze", "zzz öö", "", "12", "a" * 50, chr(0x30000), *texts["fr"][:5]]
    got = sum((s.sums(asked)[:, : len(words)] for s in scorers(spark, model)), np.zeros((len(asked), len(words))))
    for k, lang in enumerate(model.langs):
        cost = plain_kneser_ney(texts[lang])
        assert np.allclose(got[:, k], [cost(t) if any(c.isalpha() for c in t) else got[i, k] for i, t in enumerate(asked)], rtol=1e-4, atol=1e-4)
    out = [r["language"] for r in langid.identify(docs(spark, asked), model).orderBy("doc_id").collect()]
    assert [x["lang"] for x in out[:2]] == ["en", "de"] and out[3]["lang"] == out[4]["lang"] == "und" and out[6]["lang"] == "xx"


def test_shards_agree_with_one(spark):
    """Many shards give the answers of one, whatever other columns there are; ties go to the first language."""
    rows = [(i, t, lang, "s", None) for i, (t, lang) in enumerate([("one text here", "b"), ("one text here", "a"), ("ganz anders", "c")])]
    train = spark.createDataFrame(rows, DOCS)
    one, many = langid.fit(train, F.lit(True)), langid.fit(train, F.lit(True), shard_cells=20)
    asked = docs(spark, ["one text", "anders", None, "text " * 200_000]).withColumnsRenamed({"source": "sums", "lang": "language"})
    a, b = ({r["doc_id"]: r["language"] for r in langid.identify(asked, m).collect()} for m in (one, many))
    assert many.shards > 3 and a[0]["lang"] == "a" and a[1]["lang"] == "c"
    assert all(a[k]["lang"] == b[k]["lang"] and a[k]["rejected"] == b[k]["rejected"] and abs(a[k]["score"] - b[k]["score"]) < 1e-4 for k in a)


def test_held_out_is_crc32(spark):
    import zlib

    got = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("held", langid.held_out()).collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_cases(spark):
    train = docs(spark, ["the cat and the dog are here with the others"] * 30).unionByName(docs(spark, ["der hund und die katze sind nicht hier mit den anderen"] * 30, "de"))
    model = langid.fit(train, F.lit(True))
    assert model.langs == ["de", "en"]
    rows = docs(spark, [None, "", "123 !?", "the dog and the cat", "die katze und der hund", "x" * 300_000, "the dog and the cat"]).withColumn("language_score", F.lit(1))
    out = {r["doc_id"]: r["language"] for r in langid.identify(rows, model).collect()}
    assert [out[i]["lang"] for i in (0, 1, 2)] == ["und"] * 3 and all(out[i]["score"] == 0 and out[i]["rejected"] for i in (0, 1, 2))
    assert out[3]["lang"] == "en" and out[4]["lang"] == "de" and out[3] == out[6]
    assert all(0 <= x["score"] <= 1 for x in out.values())
    assert not out[3]["rejected"] and out[5]["rejected"]


def test_small_language_beside_very_many_grams(spark):
    """A language of a single text stays in the model beside one with more than 1.5 million n-grams."""
    rng = np.random.default_rng(5)
    letters = np.array([chr(c) for c in range(0x250, 0x3400) if chr(c).isalpha() and chr(c).lower() == chr(c)])
    long = ["".join(rng.choice(letters, 40_000)) for _ in range(42)]
    train = docs(spark, long, "zz").unionByName(docs(spark, ["fox jumps quickly"], "qq"))
    model = langid.fit(train, F.lit(True))
    assert model.langs == ["qq", "zz"] and model.shards == 1 and len(langid.shard(spark, model, 0).grams[1][0]) > 1_500_000
    asked = docs(spark, ["fox jumps quickly", long[0][:400]])
    assert [r["language"]["lang"] for r in langid.identify(asked, model).orderBy("doc_id").collect()] == ["qq", "zz"]


def test_language_without_training(spark):
    empty = docs(spark, ["a"]).where("false")
    model = langid.fit(empty, F.lit(True))
    assert langid.identify(empty, model).count() == 0
    assert langid.identify(docs(spark, ["the"]), model).first()["language"]["lang"] == "und"


def test_language_held_out_accuracy(spark):
    out = queries.op10_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out").toPandas()
    assert len(out) > 150
    assert (out["lang"] == out["lang_pred"])[out["n_chars"] > 60].mean() > 0.98


def brute_statistics(text):
    text = text or ""
    ws = " \t\n\v\f\r"
    words, now = [], ""
    for c in text:
        if c in ws:
            words += [now] if now else []
            now = ""
        else:
            now += c
    words += [now] if now else []
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if any(c not in ws for c in line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= {i, i + 1, i + 2}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def test_statistics_against_brute_force():
    rng = random.Random(1)
    for k in range(300):
        text = "".join(rng.choice(["a", "b ", "é", "\n", " ", "\t", "#", "漢", " ", "the ", "a b a ", "\x1c"]) for _ in range(rng.randint(0, 60)))
        assert quality.statistics(text)[0] == brute_statistics(text), repr(text)
    assert quality.statistics(None)[0] == [0, 0, 0, 0, 0]


def test_statistics_of_a_very_long_text():
    rng = random.Random(9)
    words = [f"w{rng.randrange(300)}" for _ in range(300_000)]
    text = "\n".join(" ".join(words[i : i + 30]) for i in range(0, len(words), 30)) + " #$" * 20_000
    n, chars, symbols, dup, repeat = quality.statistics(text)[0]
    own = text.split()
    seen = Counter(zip(own, own[1:], own[2:]))
    covered = np.zeros(len(own), bool)
    for i, w in enumerate(zip(own, own[1:], own[2:])):
        if seen[w] > 1:
            covered[i : i + 3] = True
    lines = text.split("\n")
    assert (n, chars, symbols, dup, repeat) == (len(own), sum(map(len, own)), 40_000, len(lines) - len(set(lines)), covered.sum())


def test_quality_query_against_brute_force(spark):
    """The query's base columns of all documents; what fails the base rule is not kept."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = {r["doc_id"]: r for r in queries.op2_quality_rules(spark, d).collect()}
    assert set(out) == set(texts)
    short = {k: t for k, t in texts.items() if len(t or "") < 6000}
    assert len(short) > 100
    for k, t in short.items():
        n, chars, symbols, dup, repeat = brute_statistics(t)
        r = out[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
    assert not any(r["kept"] for r in out.values() if r["base_failed"]) and any(r["kept"] for r in out.values())


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * rng.standard_normal(3000) > 0.5) ^ (rng.random(3000) < 0.05)).astype(float)
    forest = quality.fit(x, y, [1, -1, 0])
    base = rng.random((200, 3))
    for j, sign in ((0, 1), (1, -1)):
        last = None
        for v in np.linspace(0, 1, 21):
            own = base.copy()
            own[:, j] = v
            m = forest.margin(own)
            assert last is None or np.all(sign * (m - last) >= -1e-9)
            last = m
    assert ((forest.probability(x) > 0.5) == (x[:, 0] > 0.5)).mean() > 0.9


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    good = " ".join(f"word{i}" for i in range(80))
    rows = docs(spark, [None, good, "spam " * 100, "", good]).withColumn("label_id", F.lit(5))
    forest = quality.train(rows, labels)
    out = {r["doc_id"]: r["quality"] for r in quality.judge(rows, forest).collect()}
    assert out[0]["base_failed"] and out[3]["base_failed"] and out[2]["base_failed"]
    assert not out[1]["base_failed"] and out[1]["kept"] and out[1] == out[4]
    assert quality.judge(rows.where("false"), quality.train(rows.where("false"), labels)).count() == 0


def test_quality_keeps_good_and_drops_bad(spark):
    out = queries.op2_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert out["kept"][out["quality"] == 1].mean() > 0.99
    assert out["kept"][out["quality"] == 0].mean() < 0.1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe_equals_library(library):
    small, plain = bpe.Codec(queries.tokenizer_path(), leaf=16, long_piece=16, window=1, reach=4), bpe.codec(queries.tokenizer_path())
    rng = random.Random(2)
    letters = ["a", "é", "th", "ing", "漢字", " ", "  ", "\n", "'s", "'re", "1", "!!", "#", " \n\t", "<|endoftext|>", "𝔘", "　", "\x00", "the"]
    for _ in range(600):
        some = rng.sample(letters, rng.randint(1, 6))
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 300)))
        want = library.encode(text, add_special_tokens=False).ids
        assert small.encode(text).tolist() == want and plain.encode(text).tolist() == want, repr(text)
        assert plain.decode(want) == library.decode(want, skip_special_tokens=False)


def test_bpe_long_unsplit(library):
    rng = random.Random(4)
    runs = ["".join(rng.choice("abcdethn") for _ in range(60_000)), " ", "a" * 30_000, " " * 25_000, "漢字" * 8000, "don't" * 4000, "?!" * 9000, "7" * 20_000, "é " * 9000, "x,y" * 5000]
    with ThreadPoolExecutor(2) as pool:
        for text in ("".join(runs), *runs):
            assert bpe.codec(queries.tokenizer_path()).encode(text, pool).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_tree_is_taken(spark, library, monkeypatch):
    """Texts of the tables longer than a leaf go through joins, with the library's ids."""
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where(f"length(text) > {bpe.LEAF}").collect()]
    own, joins = bpe.codec(queries.tokenizer_path()), []
    join = bpe.Codec.join
    monkeypatch.setattr(bpe.Codec, "join", lambda *a: joins.append(1) or join(*a))
    assert len(texts) > 10 and all(own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
    assert len(joins) >= len(texts)


def test_bpe_invalid_ids_decode_like_library(library):
    rng = random.Random(5)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert bpe.codec(queries.tokenizer_path()).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query(spark, library):
    rows = docs(spark, [None, "", "Hello  world<|endoftext|>x", "é" * 10, "Hello  world<|endoftext|>x"]).withColumn("ids", F.lit(3))
    out = {r["doc_id"]: r for r in queries.bpe_digests(rows).collect()}
    for i, t in enumerate(["", "", "Hello  world<|endoftext|>x", "é" * 10, "Hello  world<|endoftext|>x"]):
        ids = library.encode(t, add_special_tokens=False).ids
        assert out[i]["n_tokens"] == len(ids)
        assert out[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert queries.bpe_digests(rows.where("false")).count() == 0
