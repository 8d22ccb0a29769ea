"""Cases of the third review, each of which failed before."""

import datetime as dt
import hashlib
import json
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import layout as L
from foliant.plans.catalogue import QUERIES, SQL
from foliant.sources import writers as W


def by_sql(name: str, **tables: pd.DataFrame) -> list[tuple]:
    with duckdb.connect() as c:
        for k, t in tables.items():
            c.register(k, t)
        return sorted(c.execute(SQL[name]).fetchall())


def by_spark(spark, name: str, folder, **tables: pd.DataFrame) -> list[tuple]:
    for k, t in tables.items():
        t.to_parquet(os.path.join(folder, f"{k}.parquet"), coerce_timestamps="us")
    return sorted(tuple(r) for r in QUERIES[name](spark, str(folder)).collect())


def test_f4_levels_of_the_digest(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "LEAF", 1)  # 5,000 lines would have four levels
    orders = pd.DataFrame({"o_orderkey": range(5000), "o_custkey": range(5000), "o_orderstatus": ["F"] * 5000})
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    level: dict[str, str] = {}
    lines = sorted(sha(json.dumps({k: r[k] for k in orders.columns}, separators=(",", ":"))) for r in orders.to_dict("records"))
    for h in lines:
        level[h[:3]] = level.get(h[:3], "") + h
    level = {k: sha(v) for k, v in level.items()}
    for depth in (2, 1, 0):
        above: dict[str, str] = {}
        for k in sorted(level):
            above[k[:depth]] = above.get(k[:depth], "") + k[-1] + level[k]
        level = {k: sha(v) for k, v in above.items()}
    rows = by_spark(spark, "checksummed_orders", tmp_path, orders=orders)
    assert len(rows) == 5000 and {r[-1] for r in rows} == {level[""]}


def test_f5_milliseconds_are_rounded(spark, tmp_path):
    at = lambda us: dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=us)
    events = pd.DataFrame(
        [(1, at(0), "purchase", 0.01), (2, at(60_499), "error", 0.0), (3, at(60_500), "error", 0.0), (4, at(-501), "error", 0.0)],
        columns=["event_id", "ts", "event_type", "value"],
    )
    rows = by_spark(spark, "intervals_of_one_key", tmp_path, events=events)
    assert rows == by_sql("intervals_of_one_key", events=events) == [(1, 1, 2)]


def test_f6_votes_in_one_order(spark):
    scores = [0.1 * (k * 7 % 10) + 0.013 * (k % 3) for k in range(40)]
    pairs = [(1, i, j, scores[i] - scores[j]) for i in range(40) for j in range(40) if i != j]
    ask = lambda rows: {r["box"]: (r["votes"], r["rank"]) for r in L.vote_rank(spark.createDataFrame(rows, "page int, i int, j int, logit double").coalesce(1)).collect()}
    assert ask(pairs) == ask(pairs[::-1]) == ask(sorted(pairs, key=lambda p: p[3]))


def test_f1_long_texts_are_merged_in_linear_time(spark):
    import time

    from foliant.functions import text as X

    letters = lambda n: "".join(chr(97 + (k * k * 7 + k // 5) % 26) for k in range(n))
    cut = lambda t, size, more: [t[k : k + size + more] for k in range(0, len(t), size)]

    def plain(parts: list[str]) -> str:
        out = parts[0]
        for p in parts[1:]:
            k = next(k for k in range(min(len(out), len(p)), -1, -1) if not k or (out.endswith(p[:k]) and len(p[:k].encode()) <= 48))
            out += p[k:]
        return out

    # pieces shorter than what they share; signs of several bytes; a NUL
    for parts in (cut(letters(3000), 3, 30), cut("名前と氏名" * 90, 7, 20), ["ab\0cd", "b\0cdef", "ef", "f", "fg"], ["x" * 60, "x" * 50 + "y"]):
        got = spark.createDataFrame([(parts,)], "p array<string>").select(X.overlap_merge(F.col("p"))).first()[0]
        assert got == plain(parts)
    long = cut(letters(400_000), 50, 12)
    began = time.perf_counter()
    got = spark.createDataFrame([(long,)], "p array<string>").select(X.overlap_merge(F.col("p"))).first()[0]
    assert got == plain(long) and time.perf_counter() - began < 30


def test_f3_a_producer_waits_for_its_consumer(monkeypatch):
    from foliant.plans import stream_queries as Q

    tries = []

    def push(chunk, spool):
        tries.append(chunk)
        if len(tries) < 3:  # the consumer has not noted what it took
            raise Q.pushed.Backpressure("wait")

    monkeypatch.setattr(Q.pushed, "push", push)
    Q.pushed_when_taken(type("Running", (), {"processAllAvailable": lambda self: None})(), "rows", "spool")
    assert tries == ["rows"] * 3


def test_f2_edits_take_one_pass(monkeypatch):
    from foliant.functions import edit

    passes = []
    column = edit._column
    monkeypatch.setattr(edit, "_column", lambda a, b: passes.append(len(a)) or column(a, b))
    a, b = "kitten sitting on a mat" * 20, "sitten kitting in a hat" * 21
    assert sum(edit.edits(a, b)) == edit.distance(a, b) and len(passes) == 1
    monkeypatch.setattr(edit, "HELD", 1000)  # cut as before
    assert sum(edit.edits(a, b)) == edit.distance(a, b)


def test_f7_ascii_is_cut_as_all_text():
    import random

    from foliant.plans.token_queries import small_codec

    codec, rng = small_codec(), random.Random(3)
    signs = [*"aZ09 \t\n\r\x0b\x0c\x1c\x1f\x7f'_-!.,", "'s", "'LL", "  ", "\r\n", "the", "ing"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(4000)]
    for t in texts:
        assert codec.pieces(t) == codec.pattern.findall(t)
        ids = codec.encode(t)
        assert codec.decode([*ids, 9999, 302]) == t + "<|im_end|>" and codec.decode([*ids, 9999, 302], True) == t
    from foliant.operators import bytepair as B

    for t in texts:
        symbols = [codec.letters[b] for b in t.encode()]
        short = B.merge_short(symbols, codec.ranks)
        held, B.SHORT = B.SHORT, 0
        try:
            assert B.merge(symbols, codec.ranks) == short
        finally:
            B.SHORT = held
    # neither the matcher of all text nor an id's letters are asked
    codec.__dict__["pattern"] = None
    codec.texts.clear()
    assert codec.decode(codec.encode("the king")) == "the king"


def test_f10_code_of_any_lines(spark):
    import random

    from foliant.functions import text as X

    def plain(t: str) -> str:
        lines = t.splitlines()
        if lines and lines[0].startswith("```"):
            lines = lines[1:]
        if lines and lines[-1].strip() == "```":
            lines = lines[:-1]
        return "\n".join(lines).strip()

    rng = random.Random(5)
    signs = ["```", "``", "a", "b c", " ", "\t", "\n", "\r\n", "\r", "\x0b", "\x1c", "\x1f", "\x85", " ", " ", "　", "​", "é"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(9))) for _ in range(3000)] + ["```", "```\n```", "```\n", "\n", "\n\n", "a\n```", "```\n\n```\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.code_content(F.col("t")).alias("c"))
    assert [r["c"] for r in sorted(rows.collect())] == [plain(t) for t in texts]
    # lines are not taken apart
    assert "split(" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_f8_plain_markup_needs_no_parser(monkeypatch):
    import random

    from foliant.operators import tables as T

    rng = random.Random(8)
    token = lambda: rng.choice(["<fcel>", "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"]) + rng.choice(["", "a", " b ", "1 "])
    texts = ["".join(token() for _ in range(rng.randrange(14))) for _ in range(2000)]
    plain = [T.markup_of(t) for t in texts]

    def parsed(markup: str) -> list:
        parser = T._Grid()
        parser.feed(markup)
        return [[[tuple(c) for c in r] for r in t] for t in parser.tables]

    assert all(T.cells_of(m) == parsed(m) for m in plain if m)
    assert all(T.cells_of(m) == parsed(m) for m in ["<p>", "<table><tr><td>a</td></tr></table>"])
    monkeypatch.setattr(T, "_Grid", None)
    assert [T.grid_of(m) is not None for m in plain if m]


def test_f21_markup_is_that_of_the_cells(spark):
    import random

    from foliant.operators import tables as T

    rng = random.Random(9)
    token = lambda: rng.choice(["<fcel>", "<fcel>", "<ecel>", "<lcel>", "<ucel>", "<xcel>", "<nl>"]) + rng.choice(["", "a", " b　", "\x1c", "<&'\""])
    texts = ["".join(token() for _ in range(rng.randrange(14))) for _ in range(600)] + ["", "x", "<nl>", "<nl><nl><lcel><nl>"]
    rows = spark.createDataFrame(list(enumerate(texts)), "table_id int, otsl string")
    escaped = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;").replace("'", "&#x27;")
    lines: dict[int, dict[int, str]] = {}
    for c in T.otsl_cells(rows).orderBy("table_id", "start_row", "start_col").collect():
        span = (f' rowspan="{c["row_span"]}"' if c["row_span"] > 1 else "") + (f' colspan="{c["col_span"]}"' if c["col_span"] > 1 else "")
        own = lines.setdefault(c["table_id"], {})
        own[c["start_row"]] = own.get(c["start_row"], "") + f"<td{span}>{escaped(c['text'])}</td>"
    want = ["<table>" + "".join(f"<tr>{own.get(r, '')}</tr>" for r in range(max(own) + 1)) + "</table>" if (own := lines.get(k)) else "" for k in range(len(texts))]
    out = T.otsl_html(rows)
    assert [r["html"] for r in out.orderBy("table_id").collect()] == want
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_f22_blocks_are_changed_in_their_row(spark):
    from foliant.operators import tables as T

    rows = [(1, "table", r"<fcel>\(x\)<fcel>b"), (1, "table", "<fcel>c"), (2, "text", "<fcel>a"), (3, "table", ""), (4, "table", None), (5, None, "<fcel>a")]
    out = T.table_blocks(spark.createDataFrame(rows, "id int, type string, content string"))
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r["content"] for r in out.collect()] == ["<table><tr><td><eq>x</eq></td><td>b</td></tr></table>", "<table><tr><td>c</td></tr></table>", "<fcel>a", "", None, "<fcel>a"]


def test_f11_scores_in_one_pass_at_any_depth(spark, tmp_path, monkeypatch):
    from foliant.functions import jsonx

    deep = '{"a": [' * 200 + '{"score": 0.5}' + "]}" * 200
    texts = [
        deep, r'{"score": 0.25, "x": "\"score\": 0.75", "score\\": 1}', '{"score" :\n\t1e-1, "confidence":-0, "scores": 0.5, "a": ["score", 0.5]}', '{"score": "0.5", "b": {"confidence": 1.0000001}}',
        '{"score": 0.5, "score": 0.5}', '{"score": 0.5} {', '{"x": "' + "\\\\" * 50_000 + '", "score": 0.125}', '[{"score": 0.0}, 0.3]', None,
    ]
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir")))
    out = jsonx.walked_scores(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t")
    assert sorted(map(tuple, out.collect())) == [(0, 0.5), (1, 0.25), (2, 0.0), (2, 0.1), (6, 0.125), (7, 0.0)]
    assert set(os.listdir(spark.conf.get("spark.checkpoint.dir"))) == before  # a level is not written


def test_f9_a_table_meets_itself_once(spark):
    import random

    from foliant.operators import spatial as G

    rng = random.Random(4)
    rows = [(k, k % 3, float(x := rng.randrange(60)), float(y := rng.randrange(60)), float(x + rng.choice([0, 1, 4, 5, 30, 70])), float(y + rng.choice([1, 2, 9, 40]))) for k in range(150)] + [(7, 1, 0.0, 0.0, 9.0, 9.0)]
    boxes = spark.createDataFrame(rows, "id long, page int, xmin double, ymin double, xmax double, ymax double")
    for page in ("page", None):
        out = G.boxes_meeting_each_other(boxes, "id", page)
        meet = lambda a, b: (page is None or a[1] == b[1]) and max(a[2], b[2]) < min(a[4], b[4]) and max(a[3], b[3]) < min(a[5], b[5])
        assert sorted((r["l"]["id"], r["r"]["id"]) for r in out.collect()) == sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and meet(a, b))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "Union" not in plan


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_f12_documents_meet_once(spark):
    from foliant.operators import sidecars as D

    rows = [("a", p, i, "text", [0, 0, i, 1], 0, "x", s) for p, i, s in [(2, 1, 0.5), (None, 3, 0.25), (1, 9, 0.1), (2, 0, 1.0), (1, 2, 2.0)]] + [("b", 7, 1, "text", None, 0, None, None)]
    items = spark.createDataFrame(rows, "stem string, page int, idx int, type string, bbox array<int>, angle int, content string, score double")
    model = D.model_documents(items)
    assert exchanges(model) == 1  # before: one for pages, one for documents
    docs = {r["path"]: json.loads(r["json"]) for r in model.collect()}
    assert [[x.get("score") for x in page] for page in docs["a_model.json"]] == [[0.25], [2.0, 0.1], [1.0, 0.5]]
    assert docs["b_model.json"] == [[{"type": "text", "angle": 0}]]
    middle = D.middle_documents(items.select("stem", "page", "idx", "type", F.col("content").alias("text"), F.col("score").alias("confidence")))
    assert exchanges(middle) == 1
    told = {r["path"]: json.loads(r["json"])["pdf_info"] for r in middle.collect()}["a_middle.json"]
    assert [(p.get("page_idx"), [b["confidence"] for b in p["para_blocks"]]) for p in told] == [(None, [0.25]), (1, [2.0, 0.1]), (2, [1.0, 0.5])]
    lists = spark.createDataFrame([("a_content_list.json", "[]"), ("a_content_list.json", "[]"), ("c_content_list.json", "[]")], "path string, json string")
    out = D.confidence_by_stem(spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "path string, json string").unionByName(lists))
    assert exchanges(out) == 1  # before: one for lists, one for scores
    assert sorted((r["stem"], r["n"], r["mean"]) for r in out.collect()) == [("a", 4, pytest.approx(0.4625)), ("c", 0, None)]


def pages_of_boxes(n: int) -> list:
    import random

    r = random.Random(14)
    labels = ["text", "display_formula", "inline_formula", "table", "reference", "image", None]

    def box(k: int) -> dict:
        x, y = r.randrange(40) / 2, r.randrange(40) / 2
        return {"index": k, "label": r.choice(labels), "score": r.choice([None, r.random()]), "xmin": x, "ymin": y, "xmax": x + r.randrange(60), "ymax": r.choice([None, *[y + r.randrange(60)] * 30])}

    return [None if r.random() < 0.05 else [box(k + 1) for k in range(r.randrange(12))] for _ in range(n)]


def test_f14_pages_of_a_batch_are_filtered_at_once(monkeypatch):
    import pyarrow as pa

    pages = pages_of_boxes(600)
    want = [None if p is None else L.filter_page(p) for p in pages]
    monkeypatch.setattr(L, "filter_page", None)  # before: a page's matrices at a time
    own = pa.array(pages, L._ARROW_BOX)
    assert L.filter_pages(own).to_pylist() == want
    assert L.filter_pages(own.slice(7, 90)).to_pylist() == want[7:97]
    assert L.filter_pages(pa.array([None, []], L._ARROW_BOX)).to_pylist() == [None, []]


def test_f15_only_pages_with_formulas_that_meet_are_merged(monkeypatch):
    import pyarrow as pa

    pages = pages_of_boxes(600)
    merge, asked = L.merge_page, []
    want = [None if p is None else merge(p) for p in pages]
    monkeypatch.setattr(L, "merge_page", lambda p: asked.append(1) or merge(p))
    own = pa.array(pages, L._ARROW_BOX)
    assert repr(L.merge_pages(own).to_pylist()) == repr(want)  # some scores are no numbers
    assert len(asked) == sum(p is not None and len(w) < len(p) for p, w in zip(pages, want)) < 300
    assert repr(L.merge_pages(own.slice(7, 90)).to_pylist()) == repr(want[7:97])


class Store:
    """State of one key in memory: what it is asked is counted."""

    def __init__(self):
        self.value, self.rows, self.map, self.asked, self.timers = None, [], {}, 0, set()

    def getValueState(self, *a):
        return self

    getListState = getMapState = getValueState

    def count(self, out=None):
        self.asked += 1
        return out

    def exists(self):
        return self.count(self.value is not None)

    def get(self):
        return self.count(self.value)

    def update(self, value):
        self.value = self.count(value)

    def clear(self):
        self.value = self.count()

    def registerTimer(self, at):
        self.count(self.timers.add(at))


def test_f13_f16_a_clip_asks_its_state_twice_a_call(monkeypatch):
    import random
    from types import SimpleNamespace

    from foliant.streaming import ordered, speech

    p = speech.Params(endpoint=100)
    r = random.Random(13)
    windows = [(f * 10, r.choice([0.0, 0.0, 0.5])) for f in range(120) for _ in range(r.choice([1, 1, 2]))] + [(1200, speech.FINISH)]
    v, want = speech.Voice(), []
    for f in range(120):
        v, more = speech.step(p, v, max(x for at, x in windows if at == f * 10))
        want += more
    v, more = speech.flush(v)
    want += [*more, ("END", v.number, v.now, v.now, None, None)]
    arrive = sorted(windows, key=lambda w: w[0] + r.randrange(200))
    for waiting in (256, 2):  # in the clip's value, and in its list
        monkeypatch.setattr(ordered, "WAITING", waiting)
        store, lists, got, calls = Store(), Store(), [], 0
        lists.appendList = lambda rows: lists.rows.extend(rows)
        lists.put, lists.clear, lists.get = lists.appendList, lambda: lists.rows.clear(), lambda: list(lists.rows)
        lists.containsKey = lambda k: k in lists.map
        store.getListState = store.getMapState = lambda *a: lists
        own = ordered.Segmenter(p, None, None)
        own.init(store)
        mark = 0
        for k in range(0, len(arrive), 30):
            got += own.handleInputRows((1,), iter([dict(frame=f, rms=x) for f, x in arrive[k : k + 30]]), None)
            mark = max(mark, max(f for f, _ in arrive[k : k + 30]) - 200) if k + 30 < len(arrive) else 5000
            calls += 1
            now = SimpleNamespace(getCurrentWatermarkInMs=lambda: mark)
            while due := [t for t in store.timers if t <= mark]:
                store.timers.remove(min(due))
                got += own.handleExpiredTimer((1,), now, None)
                calls += 1
        assert [tuple(e)[1:7] for e in got] == [tuple(e) for e in want]
        if waiting == 256:
            assert store.asked <= 3 * calls  # its value read and written, a timer; before: some seven
            assert store.value is None and not lists.rows


def test_f17_a_queue_asks_its_state_twice_a_batch():
    from foliant.streaming import ordered

    store = Store()
    own = ordered.Queue(2, ["at", "seq"])
    own.init(store)
    rows = [(1, "PARTIAL", "a", 5), (2, "FINAL", None, 4), (3, "PARTIAL", "c", None), (4, "FINAL", "d", 6), (5, "POLL", "1", 7)]
    event = lambda seq, kind, payload, at: dict(seq=seq, kind=kind, payload=payload, at=at)
    assert [tuple(e) for e in own.handleInputRows((9,), iter([event(*x) for x in rows]), None)] == [(9, 5, 2, "FINAL", None, 1, 1)]
    assert store.asked == 2  # before: six
    # number 3, without a time, came last
    assert [tuple(e) for e in own.handleInputRows((9,), iter([event(6, "POLL", "3", 1)]), None)] == [(9, 6, 4, "FINAL", "d", 0, 1), (9, 6, 3, "PARTIAL", "c", 0, 1)]


def test_f19_windows_of_one_time_are_the_loudest(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    # two windows within one millisecond, the quiet one first; a run of speech that ends
    rows = [(k, at(k), 1, "view", v) for k, v in enumerate([10.0] * 4 + [90.0] * 3 + [10.0] * 60)] + [(100 + k, at(k) + dt.timedelta(microseconds=5), 1, "view", 95.0) for k in (9, 12, 30)]
    events = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value"])
    want = by_sql("stream_segments", events=events)
    assert want and by_spark(spark, "stream_segments", tmp_path, events=events) == want


def test_f20_a_table_is_dealt_once(spark, tmp_path):
    from foliant.plans import stream_queries as S

    events = pd.DataFrame({"event_id": range(50), "ts": [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k * k) for k in range(50)], "user_id": 1, "value": 0.5})
    events.to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    assert S.stream_of(spark, str(tmp_path), "events", columns=("event_id", "ts")).columns == ["event_id", "ts"]
    parts = S.dealt(spark.read.parquet(str(tmp_path / "events.parquet")), F.col("event_id") % 3, 4)
    assert [sorted(r["event_id"] for r in p.collect()) for p in parts] == [[*range(k, 50, 3)] for k in range(3)] + [[]]
    assert all("part_=" in f for p in parts for f in p.inputFiles())  # before: each part was picked from the whole table by one task
