"""WARC, main text, multi-index search, chat windows: edge cases, round trips and brute force."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann, chat, html_text, queries, warc


def test_chunked_framing():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 1000):
        body = bytes(rng.randrange(256) for _ in range(n))
        assert warc.dechunked(warc.chunked(body, 8)) == body
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcX\r\n0\r\n\r\n")


def test_warc_round_trip(spark):
    big = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 300 + "é漢"
    texts = [None, "", "a", "a", big, big, "\r\n\r\n", "0\r\n\r\n", "b"]
    rows = [(i + 5, f"http://h/{i}", t) for i, t in enumerate(texts)] + [(7, "http://h/2", "a"), (None, None, "only here")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit("x"))
    out = warc.resolved(warc.round_trip(pages, segment_bytes=500)).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r["page_id"], []).append(r)
    for page, _, t in rows:
        raw = (t or "").encode()
        for r in got[page]:
            assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert got[5][0]["record_type"] == "response" and got[6][0]["refers_to"] == 5
    assert [r["record_type"] for r in got[7]] == ["response"] * 2 and got[8][0]["refers_to"] == 7
    assert got[9][0]["record_type"] == "response" and got[10][0]["refers_to"] == 9
    assert got[None][0]["record_type"] == "response"
    payloads = {r["page_id"]: bytes(r["payload"]) for r in warc.round_trip(pages, segment_bytes=500).where("kind = 'response'").collect()}
    assert payloads["9"] == big.encode()


def test_archives_are_warc(spark, tmp_path):
    """Read by gzip and a plain reader of the format: a member for each record, the fields that the format asks for, and revisits whose
    WARC-Refers-To is a response in the archives."""
    import zlib

    rows = [(k, None if k == 3 else f"http://h/{k}?a b\n", t) for k, t in enumerate(["x" * 5000, "b", "b", "b", None])] + [(None, "http://n", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    pages.write.parquet(str(tmp_path / "pages"))
    warc.write_archives(spark.read.parquet(str(tmp_path / "pages")), str(tmp_path / "out"), segment_bytes=900, date="2024-02-03T04:05:06Z")
    found = []
    for f in (tmp_path / "out").glob("part-*"):
        rest = f.read_bytes()
        while rest:
            d = zlib.decompressobj(31)
            data = d.decompress(rest) + d.flush()
            rest = d.unused_data
            head, _, block = data.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            own = dict(x.split(": ", 1) for x in lines)
            assert first == "WARC/1.1" and block[int(own["Content-Length"]) :] == b"\r\n\r\n"
            assert own["WARC-Date"] == "2024-02-03T04:05:06Z" and own["WARC-Target-URI"] and re.fullmatch("<urn:uuid:[0-9a-f-]{36}>", own["WARC-Record-ID"])
            found.append((own, block[: int(own["Content-Length"])]))
    ids = {h["WARC-Record-ID"]: h for h, _ in found}
    assert len(ids) == len(found)
    revisits = [h for h, _ in found if h["WARC-Type"] == "revisit"]
    assert sorted(h.get("X-Page-ID", "") for h in revisits) == ["", "2", "3"]
    for h in revisits:
        to = ids[h["WARC-Refers-To"]]
        assert to["WARC-Type"] == "response" and to["X-Page-ID"] == "1" and to["WARC-Payload-Digest"] == h["WARC-Payload-Digest"] and to["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] == "http://h/1?a b"
    parts = sorted((int(h["WARC-Segment-Number"]), b) for h, b in found if "WARC-Segment-Number" in h)
    assert [k for k, _ in parts] == list(range(1, 7)) and warc.dechunked(b"".join(b for _, b in parts).partition(b"\r\n\r\n")[2]) == b"x" * 5000
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.resolved(warc.read_archives(spark, str(tmp_path / "out"))).collect()}
    assert got == {0: ("response", None), 1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), 4: ("response", None), None: ("revisit", 1)}


def test_warc_min_size_and_empty(spark):
    pages = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b" * 50), (4, "b" * 50)], "page_id long, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.resolved(warc.round_trip(pages, min_revisit=10)).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.resolved(warc.round_trip(pages.where("false"))).count() == 0


def test_warc_missing_segment():
    parts = list(warc.segments("id", b"y" * 3000, "1", warc.base32_sha1(b"y" * 3000), 500))
    assert len(parts) > 3
    data = b"".join(p + b"\r\n\r\n" for p in parts)
    heads = [h for h, _ in warc.parse(data)]
    assert [h.get("warc-segment-number") for h in heads] == [str(i + 1) for i in range(len(parts))]
    assert sum(len(b) for _, b in warc.parse(data)) == int(heads[-1]["warc-segment-total-length"])
    with pytest.raises(ValueError):
        list(warc.parse(data[:-3]))


PAGE = """<!DOCTYPE html><html><head><title>No</title></head><body class="has-sidebar"><header><p>Site name and its motto</p></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you.</div><main><article><header><h1>My title &amp; more</h1></header>
<p>First   paragraph <a href="a>b">with link</a>, <em>em</em>phasis&nbsp;here.<!-- <p>no</p> --><script>var a="<p>no</p>"</script><div class="share">Share this</div><p>Second<br>one.
<ul><li>item one<li>item two</ul><form><label>Mail</label><input></form><footer>by me</footer></article>
<section id="comments"><h3>Comments</h3><p>Great article, I agree with all of it and so on.</p></section></main><aside>Related things</aside><footer>&copy; x"""
FLAT = """<div id="menu"><a>Home</a> <a>About</a></div><div id="content"><h1>Heading</h1><p>This is the long text of the page that has many words in it and no links.</p><p>Short one.</p>
<p>Another long text of the page that has many words in it with <a>one link</a> inside the text.</p></div><div id="footer">Copyright 2020 all rights reserved</div>"""


def test_main_text():
    tree = html_text.train(np.vstack(html_text.labelled()))
    assert html_text.main_text(PAGE, tree) == "My title & more\n\nFirst paragraph with link, emphasis here.\n\nSecond one.\n\nitem one\n\nitem two"
    assert html_text.main_text(FLAT, tree) == (
        "Heading\n\nThis is the long text of the page that has many words in it and no links.\n\nShort one.\n\nAnother long text of the page that has many words in it with one link inside the text."
    )
    rows = np.vstack(html_text.labelled())
    assert (tree.predict(rows[:, :-1]) == rows[:, -1]).all()


def test_tree_uses_neighbours_and_generalises():
    """Left out page by page, most blocks are still told apart; both neighbours and the block's own counts are asked."""
    pages = html_text.labelled()
    tree = html_text.train(np.vstack(pages))
    asked = {html_text.FEATURES[f] for f in tree.feature if f >= 0}
    assert {"words", "links"} <= asked and asked & {"words_before", "links_before"} and asked & {"words_after", "links_after"}
    right = total = 0
    for i, page in enumerate(pages):
        own = html_text.train(np.vstack(pages[:i] + pages[i + 1 :])).predict(page[:, :-1]) == page[:, -1]
        right, total = right + own.sum(), total + len(own)
    assert right / total > 0.9
    # whatever else holds, an article's blocks stay, those of menus and of marked elements go
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.integers(1, 200, 3000), rng.integers(0, 101, 3000), *[rng.integers(-1, 200, 3000), rng.integers(-1, 101, 3000)] * 2, rng.integers(0, 3, 3000), rng.integers(0, 3, 3000), rng.integers(0, 3, 3000)]).astype(float)
    keep = tree.predict(x)
    assert keep[(x[:, 6] == 1) & (x[:, 7] < 2)].all() and not keep[(x[:, 6] == 2) | (x[:, 7] == 2)].any()


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout with-sidebar"><article><p>one two</p></article></div>', "one two"),
        ("<form><article>text here</article></form>", "text here"),
        ('<div class="has-header"><main>abc def</main></div>', "abc def"),
        ("<div><ul><li>one</li><li>two words</li><li>three</li></ul></div>", "one\n\ntwo words\n\nthree"),
        ("<div><p>a lone paragraph of nine words that stands alone</p></div>", "a lone paragraph of nine words that stands alone"),
        ('<article><p class="notice-period">kept</p><p>x <math><mi>a</mi></math> y</p></article>', "kept\n\nx a y"),
        ('<body class="search"><div class="site has-sidebar no-comments"><article>Z</article></div>', "Z"),
        ('<article>A<section class="comments"><article class="comment"><p>bad</p></article><div><article>bad two</article></div></section></article>', "A"),
        ('<svg viewBox="0"/><article>ok <svg><text>gone</text></svg>more</article>', "ok more"),
        ('<div data-role="footer" data-class="nav"><p>these words stand in an element that only says so in its own data</p></div>', "these words stand in an element that only says so in its own data"),
        ("<div title='class=\"menu\" id=nav'><p>these words stand in an element whose title quotes other markup of menus</p></div>", "these words stand in an element whose title quotes other markup of menus"),
        ("<h1>A title here</h1><p>Short.</p><p>See <a href=x>this whole linked paragraph of eight words</a></p>", "A title here\n\nShort.\n\nSee this whole linked paragraph of eight words"),
        ("<aside><article>no</article></aside><nav><a href=x>Home</a></nav><p>yes it is here today</p>", "yes it is here today"),
        ("<ul><li><a>Home</a></li><li><a>News</a></li></ul><h2>Title of it</h2><p>" + "word " * 40 + "</p><h3>Related</h3><p><a>one two three four</a></p><p><a>five six seven</a></p>", "Title of it\n\n" + ("word " * 40).strip()),
    ],
)
def test_main_text_of_layouts(page, text):
    assert html_text.main_text(page, html_text.train(np.vstack(html_text.labelled()))) == text


def test_main_text_cases(spark):
    rows = [(1, None), (2, ""), (3, "<nav>only menus</nav>"), (4, "<article><p>" + "word " * 50_000), (5, "<article><p>a &lt;b&gt; &amp;amp; c</p><p>a \"quote' > here</article"), (6, "<"), (6, "<article>x</article>"), (7, "<article>y<script>z")]
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string")).withColumn("text", F.lit("clash"))
    out = {}
    for r in html_text.extract(pages).collect():
        out.setdefault(r["page_id"], []).append(r["main_text"])
    assert out[1] == out[2] == out[3] == [""]
    assert out[4] == [" ".join(["word"] * 50_000)]
    assert out[5][0].startswith("a <b> &amp; c\n\na \"quote' > here")
    assert "x" in out[6] and out[7] == ["y"]
    assert html_text.extract(pages.where("false")).count() == 0


def test_main_text_on_pages(spark):
    """The pages' articles, taken by their markup, are the main text."""
    import html
    import re

    for r in queries.op9_main_text(spark, "/root/testdata/sf0.001").join(spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:h1|p)>", body)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_walk_is_best_first():
    rng = np.random.default_rng(2)
    index = ann.Index(rng.standard_normal((6, 4)), rng.standard_normal((5, 4)), 1.0, 8)
    q = rng.standard_normal(8)
    cells = ann.walk(q, index, [1] * 30, 30)
    score = [index.first[c // 5] @ q[:4] + index.second[c % 5] @ q[4:] for c in cells]
    assert sorted(cells) == list(range(30)) and all(a >= b - 1e-12 for a, b in zip(score, score[1:]))


def test_search_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # one very common vector
    rows += [(400, None), (420, [0.0] * 8), (440, [float("nan")] + [1.0] * 7), (460, [None] + [1.0] * 7), (480, [float("inf")] + [1.0] * 7), (500, [1.0, 2.0]), (None, [1.0] * 8), (20, rows[20][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cells", F.lit(1)).withColumn("block", F.lit("x"))
    out = ann.nearest(vectors, F.col("vec_id") % 20 == 0).toPandas()
    good = [(i, np.array(v)) for i, v in rows if i is not None and (i < 400)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hit = total = 0
    for q in sorted({i for i in ids.tolist() if i % 20 == 0}):
        v = x[ids == q][0]
        score = (x * v).sum(axis=1)
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        own = out[out["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, len(own) + 1)) and q not in own["vec_id"].tolist()
        for i, s in zip(own["vec_id"], own["score"]):
            assert abs(s - (x[ids == i][0] * v).sum()) < 1e-12
        hit += len(set(ids[order]) & set(own["vec_id"]))
        total += len(set(ids[order]))
    assert hit / total > 0.9 and set(out["query_id"]) == {i for i in ids.tolist() if i % 20 == 0}
    copies = out[out["query_id"] == 0].sort_values("rank")["vec_id"].tolist()
    assert copies[:20] == list(range(200, 220))
    few = ann.nearest(vectors.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2
    assert ann.nearest(vectors.where("false"), F.lit(True)).count() == 0


def test_several_vectors_of_an_id_and_huge_values(spark, monkeypatch):
    """An id asks with its smallest vector, in any order of rows; products beyond the doubles are infinite and count."""
    monkeypatch.setattr(ann, "TARGET", 1.0)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(60)] + [(k, ((abs(rng.normal(size=4)) if k < 63 else rng.normal(size=4)) * 1e200).tolist()) for k in range(60, 66)]
    rows += [(20, rng.normal(size=4).tolist()) for _ in range(3)]
    want = {}
    for q in (0, 20, 40, 60):
        vec = np.array(min(v for k, v in rows if k == q))
        with np.errstate(over="ignore", invalid="ignore"):
            found = [(float((np.array(v) * vec).sum()), k) for k, v in rows if k != q]
        want[q] = sorted(((-s if s == s else np.inf, k) for s, k in found))[:20]
    for order in (1, 2):
        rng.shuffle(rows)
        got = {}
        for r in ann.nearest(spark.createDataFrame([(int(k), list(map(float, v))) for k, v in rows], "vec_id long, embedding array<double>").repartition(order + 1), F.col("vec_id") % 20 == 0).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        assert {q: [(-s if s == s else np.inf, k) for _, k, s in sorted(own)] for q, own in got.items()} == want
    assert any(np.isinf(s) for s, _ in want[60])


def test_structured_vectors_are_pruned():
    """Where vectors have structure, a query walks a few hundredths of the entries and still finds its neighbours."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((150, 32))
    x = centres[rng.integers(0, 150, 12_000)] + 0.25 * rng.standard_normal((12_000, 32))
    index = ann.fit(x[: ann.SAMPLE].tolist(), len(x))
    cells = index.cells(x)
    held = np.bincount(cells, minlength=len(index.first) * len(index.second)).tolist()
    assert index.share < 0.05
    found = []
    for i in range(0, 12_000, 100):
        scores = x @ x[i]
        scores[i] = -np.inf
        found.append(np.isin(cells[np.argsort(-scores)[:20]], ann.walk(x[i], index, held, index.share * len(x))).mean())
    assert np.mean(found) >= 0.9


def test_search_recall(spark):
    d = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{d}/embeddings.parquet").toPandas()
    x, ids = np.array(t["embedding"].tolist(), dtype=float), t["vec_id"].to_numpy()
    out = queries.op7_multi_index(spark, d).toPandas()
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        hit += len(set(ids[np.argsort(-s)[:20]]) & set(out[out["query_id"] == q]["vec_id"]))
    assert hit / (20 * (ids % 20 == 0).sum()) >= 0.9


CONV = "conv_id long, turn long, role string, text string"


def expected(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda y: (y[0] is None, y[0] or 0, y[1] is not None, y[1] or 0, y[2] or "", y[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["word ", "[INST]", "[/INST]", "<s>", "</s>", "\\1", "\\0", "\\", "<<SYS>>", "\n", "é", "[TURN]", "[ROLE]", "漢字 ", "'", "$1"]
    rows = []
    for c in range(12):
        turns = rng.choice([1, 2, 5, 30])
        for t in range(turns):
            role = "system" if t == 0 and c % 3 == 0 else rng.choice(["user", "assistant", "system", "tool"]) if c % 4 == 1 else ("user", "assistant")[t % 2]
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))))
    rows += [(50, 0, "user", None), (50, 1, "assistant", None), (51, 0, "system", "alone"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (54, 0, "system", "long " * 90), (54, 1, "user", "q"), (54, 2, "assistant", "r"), (52, None, "user", "a"), (52, 0, None, "b"), (52, 0, None, "b"), (53, 0, "assistant", "w " * 3000), (53, 1, "assistant", "end")]
    turns = spark.createDataFrame(rows, CONV).withColumn("key", F.lit(1)).withColumn("w", F.lit("x"))
    made = chat.windows(turns, budget=120, history=20)
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    want = expected(rows)
    assert set(got) == set(want)
    for c, own in want.items():
        assert got[c]["turns"] == "".join(f"{r}\n{x}\n" for r, x in own), c
        assert got[c]["loss_text"] == "".join(x for r, x in own if r == "assistant")
        assert got[c]["n_turns"] == len(own)
    parts = made.collect()
    for p in parts:
        opening = want[p["conv_id"]][0]
        if opening[0] == "system":
            assert p["text"].startswith("<<SYS>>")
        for span in p["loss"]:
            assert p["text"][: span["start"]].endswith("<s>") and p["text"][span["end"] :].startswith("</s>")
    assert any(p["repeats"] for p in parts)
    # a window exceeds its budget only by a system turn or one turn that alone leaves no room
    sizes = {(c, i): len(re.findall(r"[^\W\d_]+|\d{1,3}|[^\s\w]+", x or "")) + 4 for c, own in want.items() for i, (_, x) in enumerate(own)}
    small = {c for c, own in want.items() if max(sizes[c, i] for i in range(len(own))) <= 25}
    assert len(small) > 3 and all(p["n_tokens"] <= 120 for p in parts if p["conv_id"] in small)
    assert chat.read_back(chat.windows(turns.where("false"))).count() == 0


def test_chat_budget(spark):
    """Windows fit the budget with system turn and history; history is the latest turns that fit; strings and nulls are apart."""
    rng = random.Random(8)
    rows = [(c, t, "system" if t == 0 and c else ("user", "assistant")[t % 2], "w " * (rng.randint(1, 80) if t else 30)) for c in range(4) for t in range(120)]
    rows += [(7, 0, "user", "w " * 500), (7, 1, "assistant", "w " * 10), (7, 2, "user", "w " * 300), (7, 3, "assistant", "w " * 5)]
    parts = chat.windows(spark.createDataFrame(rows, CONV), budget=400, history=60).collect()
    by = {}
    for p in parts:
        by.setdefault(p["conv_id"], []).append(p)
    for c, own in by.items():
        own.sort(key=lambda p: p["window"])
        if c != 7:
            assert max(p["n_tokens"] for p in own) <= 400 and sum(p["n_turns"] - p["repeats"] for p in own) == 120
        turns = [(r, x) for a, _, r, x in rows if a == c]
        done = 1 if c and c != 7 else 0
        for p in own:
            fresh = sum(not a for a in p["again"]) - (1 if p is own[0] and done else 0)
            past = p["repeats"] - (1 if done and p is not own[0] and c != 7 and c else 0)
            kept, at = 0, done - 1
            least = 1 if c and c != 7 else 0
            while at >= least and kept + len(turns[at][1].split()) + 4 <= min(60, (400 - 60 - (34 if least else 0)) // 4):
                kept, at = kept + len(turns[at][1].split()) + 4, at - 1
            assert past == (done - 1 - at if p is not own[0] else 0)
            done += fresh
    odd = spark.createDataFrame([("(null)", 0, "user", "a"), (None, 0, "user", "b")], CONV.replace("conv_id long", "conv_id string"))
    assert sorted((r["conv_id"] or "", r["turns"]) for r in chat.read_back(chat.windows(odd)).collect()) == [("", "user\nb\n"), ("(null)", "user\na\n")]


def test_chat_query_and_plan(spark):
    d = "/root/testdata/sf0.001"
    out = queries.op8_chat_windows(spark, d)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    want = expected([*rows, (-1, 0, "user", text), (-1, 1, "assistant", text)])
    got = {r["conv_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for c, own in want.items():
        loss = "".join(x for r, x in own if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[c]["loss_chars"] == len(loss)


def test_very_long_pages_and_turns(spark):
    """A page of megabytes comes back from its segments; a turn longer than any budget is one window, whole."""
    big = "<p>line of the page & more</p>\r\n" * 60_000
    pages = spark.createDataFrame([(1, "u", big), (2, "u", big), (3, "u", "x")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in warc.resolved(warc.round_trip(pages)).collect()}
    assert out[1]["payload_bytes"] == out[2]["payload_bytes"] == len(big) and out[2]["refers_to"] == 1 and out[1]["record_type"] == "response"
    text = "word [INST] " * 200_000
    made = chat.windows(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], CONV))
    back = chat.read_back(made).first()
    assert back["n_turns"] == 2 and back["loss_text"] == text
