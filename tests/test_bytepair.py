"""The byte-pair codec against plain loops."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.operators import bytepair as B
from foliant.plans.token_queries import MERGES, small_codec


def plain_merge(word, ranks):
    """Pass by pass over the whole word."""
    word = list(word)
    while True:
        known = [(ranks[p], k) for k, p in enumerate(zip(word, word[1:])) if p in ranks]
        if not known:
            return word
        k = min(known)[1]
        word[k : k + 2] = [word[k] + word[k + 1]]


def plain_cut(text, specials):
    out, at, plain = [], 0, 0
    order = sorted(filter(None, specials), key=len, reverse=True)
    while at < len(text):
        hit = next((s for s in order if text.startswith(s, at)), None)
        if hit:
            out += [(text[plain:at], False)] * (at > plain) + [(hit, True)]
            at += len(hit)
            plain = at
        else:
            at += 1
    return out + [(text[plain:], False)] * (plain < len(text))


@pytest.mark.parametrize("seed", range(4))
def test_merges(seed):
    rng = random.Random(seed)
    symbols, pairs = ["a", "b", "c"], []
    for _ in range(30):  # later merges build on earlier ones
        p = rng.choice(symbols), rng.choice(symbols)
        if p not in pairs and len(p[0] + p[1]) < 9:
            pairs.append(p)
            symbols.append(p[0] + p[1])
    ranks = {p: k for k, p in enumerate(pairs)}
    for _ in range(400):
        word = [rng.choice("abc") for _ in range(rng.randrange(40))]
        assert B.merge(word, ranks) == plain_merge(word, ranks)


def test_long_pieces_take_few_steps():
    word = ["a"] * 300_000
    assert B.merge(word, {("a", "a"): 0, ("aa", "aa"): 1, ("aaaa", "aaaa"): 2}) == ["a" * 8] * 37_500


def test_specials_the_longest_from_the_left():
    rng = random.Random(2)
    for _ in range(500):
        specials = {"".join(rng.choice("ab<") for _ in range(rng.randrange(0, 5))): 1000 + k for k in range(5)}
        codec = B.Codec({}, [], specials)
        text = "".join(rng.choice("ab<c") for _ in range(rng.randrange(30)))
        assert list(codec.cut(text)) == plain_cut(text, specials), (text, specials)


def test_round_trip_and_cases(spark):
    codec = small_codec()
    rng = random.Random(3)
    texts = ["".join(rng.choice(["the ", "thing", "and", "é", "é", "日本", "😀", "<|im_end|>", "<|im_start|>", "user", " \n", "1", "'ll"]) for _ in range(rng.randrange(30))) for _ in range(300)]
    texts += ["", None, "  ", "the" * 30_000]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", "t", B.encoded(F.col("t"), codec).alias("ids"))
    rows = rows.select("*", B.decoded(F.col("ids"), codec).alias("back"), B.decoded(F.col("ids"), codec, True).alias("plain")).collect()
    for r in rows:
        t = r["t"]
        if t is None:
            assert r["ids"] is None and r["back"] is None
            continue
        cut = plain_cut(t, codec.specials)
        assert r["back"] == "".join(p if s else unicodedata.normalize("NFC", p) for p, s in cut)
        assert r["plain"] == "".join(unicodedata.normalize("NFC", p) for p, s in cut if not s)
        assert sum(k >= 300 for k in r["ids"]) == sum(s for _, s in cut)
    assert codec.encode("the thing") == [codec.vocab["the"], codec.vocab["Ġ"], codec.vocab["th"], codec.vocab["ing"]]
    assert codec.decode([0xC3 + 0, 10**6, 300], False)[-12:] == "<|im_start|>"
    assert B.Codec({"a": 1}, [("x", "y")]).encode("aba") == [1, 1] and B.Codec({"a": 1}, [("x", "y")], {}, 0).encode("aba") == [1, 0, 1]


def test_files(spark, tmp_path):
    vocab = {c: b for b, c in enumerate(B.byte_letters())} | {"th": 256, "the": 257, "<unk>": 258}
    head = {"model": {"type": "BPE", "vocab": vocab, "merges": ["t h", ["th", "e"]], "unk_token": "<unk>"}, "added_tokens": [{"content": "<s>", "id": 300, "special": True}, {"content": "zz", "id": 301, "special": False}]}
    (tmp_path / "t.json").write_text(json.dumps(head))
    codec = B.load(spark, str(tmp_path / "t.json"))
    assert codec.encode("the<s>") == [257, 300] and codec.unknown == 258 and codec.vocab["zz"] == 301
    assert codec.ranks == {("t", "h"): 0, ("th", "e"): 1} and MERGES
    for bad in ({"model": {"type": "X", "vocab": vocab, "merges": ["a b"]}}, {"model": {"type": "BPE", "vocab": {}, "merges": []}}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            B.load(spark, str(tmp_path / "bad.json"))
