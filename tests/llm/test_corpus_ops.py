"""Near-duplicates, mixing, sharding and the pipeline: edge cases and brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, neardup, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCS)


def brute_components(rows):
    def shingles(t):
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if same_id or (both and 100 * both >= 75 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def planted(seed, groups=12, size=8):
    """Groups of texts around the threshold: each a base with a few words changed."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    out += [None, "", "  \n ", "A b C", "a B c", "one", "ONE\n"]
    rng.shuffle(out)
    return [(k * 3 + 1, t) for k, t in enumerate(out)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, seed):
    rows = planted(seed)
    rows += [rows[0], rows[5], (None, rows[3][1]), (None, "alone here without an id at all"), (rows[2][0], "another text under the same id")]
    got = neardup.near_duplicates(frame(spark, [(d, t, "en", "s") for d, t in rows]).withColumnsRenamed({"n_chars": "cls"}).withColumns({"sig": F.lit(1), "node": F.lit("x")})).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2] is None, x[2] or 0)
    want = brute_components(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_of_near_copies(spark):
    """A dense group and a chain through it: everything is one component, found with few pairs."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(900)}" for _ in range(200)]
    rows = []
    for k in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"x{k}"
        rows.append((k + 10, " ".join(own), "en", "s"))
    rows.append((5, " ".join(base), "en", "s"))
    out = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {r["component_id"] for r in out} == {5} and sum(r["kept"] for r in out) == 1


def test_neardup_empty_and_filter(spark):
    empty = frame(spark, [(1, "x", "en", "s")]).where("false")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_first(empty).count() == 0
    text = "a b c d e f g h"
    rows = frame(spark, [(4, text, "en", "s"), (2, text, "de", "s"), (2, text, "de", "s"), (9, None, None, None), (None, text, "en", "s"), (7, "other words stand here alone", "en", "s")])
    kept = neardup.keep_first(rows).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 2), (False, 7), (False, 9)]
    # without any id one text of a component stays; rows without words all stay; of one id and equal words one stays
    more = neardup.keep_first(frame(spark, [(None, "A b c d e f g h", "en", "s"), (None, text, "en", "s"), (None, " ", "en", "s"), (None, None, "en", "s"), (3, "x Y", "en", "s"), (3, "x y", "en", "s")])).collect()
    assert sorted((r["doc_id"] or 0, len((r["text"] or "").split())) for r in more) == [(0, 0), (0, 0), (0, 8), (3, 2)]


def test_one_id_under_several_texts(spark):
    """An id links all its texts: 3-5 by one text, 5-9 by another, and its row without words."""
    one, two = "a b c d e f g h i", "other words that stand here by themselves alone"
    rows = frame(spark, [(3, one, "en", "s"), (5, one, "en", "s"), (5, two, "en", "s"), (9, two, "en", "s"), (9, None, "en", "s"), (4, None, "en", "s")])
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [(3, 3, True), (4, 4, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False)]


@pytest.mark.parametrize("seed", range(5))
def test_regions_do_not_depend_on_batches(seed):
    """Pairs and crowded rows of sorted rows, in one batch and in many."""
    rng = np.random.default_rng(seed)
    n = 400
    key = np.sort(rng.integers(0, 60, n)).astype(">u2")[:, None] * np.ones(neardup.MAX_DEPTH, ">u2")
    tree, node = np.zeros(n, np.int32), np.arange(n)
    wanted, crowd = set(), set()
    for v in np.unique(key[:, 0]):
        own = np.flatnonzero(key[:, 0] == v)
        wanted |= {(int(a), int(a) + 1) for a in own[:-1]} | ({(int(own[0]), int(own[2]))} if len(own) == 3 else set())
        if len(own) >= neardup.CROWDED or v in (key[0, 0], key[-1, 0]):
            crowd |= set(own.tolist())
    for step in (1, 3, 7, 400):
        found, pairs, rows = neardup.Regions(), [], []
        for at in range(0, n, step):
            a, b, r = found.add(tree[at : at + step], key[at : at + step].astype(">u2"), node[at : at + step])
            pairs += zip(a.tolist(), b.tolist())
            rows += found.node[r].tolist()
            found.cut()
        a, b, r = found.add(tree[:0], key[:0].astype(">u2"), node[:0], last=True)
        pairs += zip(a.tolist(), b.tolist())
        rows += found.node[r].tolist()
        first = set(np.flatnonzero(key[:, 0] == key[0, 0]).tolist())
        assert len(rows) == len(set(rows)) and set(rows) == crowd
        assert {p for p in pairs if not set(p) <= first} == {p for p in wanted if not set(p) <= first} and set(pairs) <= wanted and len(pairs) == len(set(pairs))


def test_components_by_labels(spark):
    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(40)]
    edges = [(min(a, b), max(a, b)) for a, b in edges if a != b]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["label"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent}


def test_raking_meets_margins(spark):
    rng = np.random.default_rng(1)
    cells = [(s, lang, t, float(rng.integers(1, 1000))) for s in "abcd" for lang in ("x", "y") for t in ("p", "q")]
    targets = {"source": {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.7, "q": 0.3}}
    out = mixing.rake(spark.createDataFrame(cells, "mix_source string, mix_lang string, mix_topic string, tokens double"), targets, fraction=0.1, iterations=40).toPandas()
    for m in mixing.MARGINS:
        for v, share in out.groupby(f"mix_{m}")["share"].sum().items():
            assert math.isclose(share, targets[m][v], rel_tol=1e-6)
    assert out["chance"].between(0, 1).all()
    assert math.isclose((out["chance"] * out["tokens"]).sum(), 0.1 * out["tokens"].sum(), rel_tol=0.02)


def test_mixing_cases(spark):
    rows = [(i, "some words here" if i % 3 else None, "en" if i % 2 else None, None if i % 5 == 0 else "s", ) for i in range(60)] + [(None, "a b", "en", "s"), (1, "some words here", "en", "s"), (2, "", "de", "s")]
    docs = frame(spark, rows).withColumn("tokens", F.lit(1)).withColumn("share", F.lit("x"))
    out = mixing.mixed(docs)
    assert out.count() == len(rows) and out.where("mix_chance is null or mix_kept is null").count() == 0
    twice = {r["mix_kept"] for r in out.where("doc_id = 1 and text = 'some words here' and source = 's'").collect()}
    assert len(twice) == 1
    assert mixing.sample(docs).columns == docs.columns
    assert mixing.mixed(docs.where("false")).count() == 0


def test_mixing_plan_is_native(spark):
    plan = mixing.mixed(frame(spark, [(1, "a", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def best_by_brute_force(sizes, shards):
    """Smallest largest shard, by dynamic programming."""
    n = len(sizes)
    pre = np.concatenate([[0], np.cumsum(sizes)])
    cost = [[math.inf] * (n + 1) for _ in range(shards + 1)]
    cost[0][0] = 0
    for k in range(1, shards + 1):
        for j in range(n + 1):
            cost[k][j] = min(max(cost[k - 1][i], pre[j] - pre[i]) for i in range(j + 1))
    return cost[shards][n]


@pytest.mark.parametrize("seed", range(4))
def test_minimax_is_optimal(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 3, 7, 20, 90]) for _ in range(60)] + ([500] if seed % 2 else [])
    rng.shuffle(sizes)
    shards = 5
    # groups spread over the hash's range, some close together, so that ranges must be split
    keys = sorted({rng.randrange(-(2**63), 2**63) for _ in range(40)}) + [2**40 + i for i in range(len(sizes) - 40)]
    keys = sorted(keys)
    groups = spark.createDataFrame(list(zip(keys, sizes)), "group long, size long")
    cuts = sharding.cut_points(groups, shards)
    shard = np.searchsorted(np.array(cuts), np.array(keys), side="right") if cuts else np.zeros(len(keys), int)
    assert shard.max() < shards
    assert max(np.bincount(shard, weights=sizes)) == best_by_brute_force(sizes, shards)


def test_sharding_cases(spark):
    texts = [None, "", "a", "a", "é" * 10, None, "long " * 1000] + [f"t{i}" for i in range(50)] + ["hot"] * 40
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, "a", "en", "s"), (None, "b", "en", "s")]
    out = sharding.assign(frame(spark, rows).withColumn("group", F.lit(1)).withColumn("shard", F.lit(9))).toPandas()
    assert len(out) == len(rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    by = {i: t for i, t, *_ in rows if i is not None}
    for d, size, crc in zip(out["doc_id"], out["size"], out["text_crc32"]):
        t = by[int(d)] if d == d else "b"
        assert size == len((t or "").encode()) + 8 and crc == (zlib.crc32(t.encode()) if t is not None else 0)
    named = out[out["doc_id"].notna()]
    assert named.assign(t=[str(by[int(d)]) for d in named["doc_id"]]).groupby("t")["shard"].nunique().max() == 1
    assert sharding.assign(frame(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("tile", [neardup.TILE, 8])
def test_dense_region_below_the_threshold(spark, monkeypatch, tile):
    """Many texts of one template just below the threshold to each other, and pairs above it among them; also
    with shingles split in dozens of blocks, and with every list too long to broadcast."""
    monkeypatch.setattr(neardup, "TILE", tile)
    if tile == 8:
        monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(300)]
    rows = []
    for k in range(300):
        own = list(base)
        for at in range(10, 300, 37):  # eight changes: about 0.77 of the shingles stay with the base, 0.65 between two texts
            own[(at + rng.randrange(30)) % 300] = f"x{k}_{at}"
        rows.append((2 * k + 10, " ".join(own)))
        if k % 10 == 0:
            near = list(own)
            for at in (40, 140, 240):
                near[at] = f"y{k}_{at}"
            rows.append((2 * k + 11, " ".join(near)))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, [(d, t, "en", "s") for d, t in rows])).collect())
    assert got == sorted(brute_components(rows))


def test_links_far_apart_in_a_crowded_region(spark, monkeypatch):
    """Texts of one template at 0.71 to each other, some with a partner at 0.76 that others stand before.

    With 12 orders instead of 32, a few hundred texts crowd their regions as very many do otherwise: neighbours
    alone miss two of the 38 links."""
    monkeypatch.setattr(neardup, "TREES", 12)
    rng = random.Random(19)
    rows = []
    for k in range(300):
        own = [f"w{i}" for i in range(250)] + [f"x{k}_{i}" for i in range(50)]
        rows.append((2 * k + 10, " ".join(own)))
        if k % 8 == 0:
            for part in range(8):
                own[part * 37 + 5 + rng.randrange(27)] = f"y{k}_{part}"
            rows.append((2 * k + 11, " ".join(own)))
    want = sorted(brute_components(rows))
    assert sum(d != c for d, _, c in want) >= 20
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(frame(spark, [(d, t, "en", "s") for d, t in rows])).collect())
    assert got == want


def test_very_long_texts(spark):
    """Texts of a million characters: near copies are found, sizes and digests are those of the whole."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    near = list(words)
    for at in range(0, len(near), 4000):
        near[at] = "other"
    half = words[:75_000] + [f"y{k}" for k in range(75_000)]
    texts = [" ".join(words), " ".join(near), " ".join(half), "short text of few words here"]
    docs = frame(spark, [(k + 1, t, "en", "s") for k, t in enumerate(texts)])
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    sized = {r["doc_id"]: (r["size"], r["text_crc32"]) for r in sharding.assign(docs, 3).collect()}
    assert sized == {k + 1: (len(t) + 8, zlib.crc32(t.encode())) for k, t in enumerate(texts)}
    assert mixing.mixed(docs).where("mix_chance is null").count() == 0
