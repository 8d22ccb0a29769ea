"""Cases of the fourth review, each of which failed before."""

import random

import duckdb
import pandas as pd
import pytest

from foliant.functions import edit
from foliant.operators import bytepair as B
from foliant.plans.catalogue import QUERIES, SQL
from foliant.plans.token_queries import MERGES, small_codec
from tests.test_findings_r03 import by_spark, by_sql


def test_f2_the_last_rank_merges(spark, tmp_path):
    benchmark = pd.DataFrame({"item_id": [1, 2], "text": ["the then", "the az"]})
    conversations = pd.DataFrame({"conv_id": [1, 1, 2, 3], "turn": [0, 1, 0, 0], "text": ["az azaz", "The hen then", "thaz nothing else", None]})
    tables = {"benchmark": benchmark, "conversations": conversations}
    rows = by_spark(spark, "merged_symbols", tmp_path, **tables)
    assert rows == by_sql("merged_symbols", **tables)
    for last in ("az", "zz"):
        tables["benchmark"] = pd.DataFrame({"item_id": [1], "text": [f"the the {last}"]})
        tables["conversations"] = pd.DataFrame({"conv_id": [1], "turn": [0], "text": [f"{last}{last} the"]})
        assert by_spark(spark, "merged_symbols", tmp_path, **tables) == by_sql("merged_symbols", **tables)


def test_f2_any_number_is_a_rank():
    for size in (4, 4 * B.SHORT):
        assert B.merge(["a", "b"] * (size // 2), {("a", "b"): 7, ("ab", "ab"): 9}) == ["abab"] * (size // 4)
    # a pair that is named twice leaves a gap in the ranks
    codec = B.Codec({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, [("a", "b"), ("a", "b"), ("ab", "c")])
    assert codec.encode("abc") == [4]


@pytest.mark.parametrize(("lanes", "held", "places"), [(4096, 1 << 28, 1 << 22), (8, 1 << 28, 1 << 22), (16, 1 << 14, 1 << 22), (64, 1 << 28, 100)])
def test_f1_pairs_of_a_batch_are_swept_together(monkeypatch, lanes, held, places):
    for k, v in {"LANES": lanes, "HELD": held, "PLACES": places}.items():
        monkeypatch.setattr(edit, k, v)
    rng = random.Random(lanes + held)
    text = lambda: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 63, 64, 65, 128, 200, 300])))
    pairs = []
    for letters in ("ab", "abcd\u00e9\u4f60\U0001f600", "abcdefgh ") * 30:
        a = text()
        pairs += [(a, text()), (a, a[: len(a) // 2] + "x" + a[len(a) // 3 :])]
    far, found = edit.measured(pairs)
    assert far == edit.distances(pairs) == [edit.distance(a, b) for a, b in pairs]
    assert found == [edit.edits(a, b) for a, b in pairs]


def test_f1_few_sweeps_for_many_texts(monkeypatch):
    passes, sweep = [], edit._sweep
    monkeypatch.setattr(edit, "_sweep", lambda pairs, hold: passes.append(len(pairs)) or sweep(pairs, hold))
    monkeypatch.setattr(edit, "_column", lambda a, b: pytest.fail("a pair on its own"))
    rng = random.Random(1)
    pairs = [tuple("".join(rng.choice("abcde ") for _ in range(rng.randrange(300, 400))) for _ in range(2)) for _ in range(200)]
    far, found = edit.measured(pairs)
    assert far == [sum(e) for e in found] and sum(passes) == 200 and len(passes) <= 2


def test_f4_texts_are_encoded_once(spark, tmp_path):
    pd.DataFrame({"doc_id": [1], "text": ["the thing"]}).to_parquet(tmp_path / "documents.parquet")
    plan = QUERIES["codec_round_trip"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "decode(encode(" not in plan and plan.count("encode(concat") == 1


@pytest.mark.parametrize("unknown", [None, 999])
@pytest.mark.parametrize(("dense", "together", "numbered"), [(1 << 22, 256, 1 << 18), (0, 256, 1 << 18), (1 << 22, 4, 10)])
def test_f4_texts_of_a_batch_are_encoded_together(monkeypatch, unknown, dense, together, numbered):
    for k, v in {"DENSE": dense, "TOGETHER": together, "NUMBERED": numbered}.items():
        monkeypatch.setattr(B, k, v)
    rng, full = random.Random(4), small_codec()
    vocab = {k: n for k, n in full.vocab.items() if n % 7 != 3}
    # merges that meet in many ways, one of them named twice
    codec = B.Codec(vocab, [*MERGES, MERGES[0], ("a", "b"), ("a", "a"), ("aa", "a"), ("b", "aa"), ("ab", "ab")], full.specials, unknown)
    parts = ["the", "ing", "ion", "a", "b", "aab", " ", "\u00e9", "e\u0301", "\u4f60", "\n", "<|im_end|>", "<|im_start|>user", "er", "andandand", "x1", "!!"]
    for _ in range(3):
        texts = [None, "", "<|im_start|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(40))]
        ids, ends = codec.encode_all(texts)
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [codec.encode(t) if t else [] for t in texts]
    bare = B.Codec({"a": 1}, [])
    assert bare.encode_all(["aab", None])[0].tolist() == [1, 1] and not len(bare.encode_all([])[0])


def test_f3_boxes_without_votes_are_last(spark, tmp_path):
    lines = [(1, k, k, k, 1.0, price, 0.0, 0.0, "N", "O", pd.Timestamp("2024-01-01")) for k, price in enumerate([None, 700.0, 300.0, 900.0], 1)]
    names = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    lineitem = pd.DataFrame(lines, columns=names)
    key = lambda r: (r[0], r[1])
    ask = lambda ran: sorted((tuple(r) for r in ran), key=key)
    lineitem.to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    rows = ask(QUERIES["reading_order_votes"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.register("lineitem", lineitem)
        assert rows == ask(c.execute(SQL["reading_order_votes"]).fetchall())
    assert rows[0] == (1, 1, None, 4)
