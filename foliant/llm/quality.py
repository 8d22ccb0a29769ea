"""Quality rules: base statistics of a text and gradient-boosted trees over them.

The statistics come from one pass over each whole text, in a vectorised UDF: no shuffle. The
trees are fitted on the driver on a bounded sample of labelled documents (MAX_LABELLED, those
with the smallest hash of their id), with histograms and monotonic constraints on chosen
features, and are scored as flat numpy node arrays, all texts of a batch level by level.

Cases: a null or empty text has no words, fails the base rule and is not kept; documents with no
usable label (or labels of one class only) give a constant model that keeps what passes the base
rule; a doc_id labelled twice counts as good only if every label is; null labels or ids are left
out; a labelled id on several rows is learned from one of them; repeated rows get equal answers. Texts
are read whole. Extra columns are carried, never read; one named as `out` gives way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: So many labelled documents are used at most to fit the trees.
MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, LEAF, L2 = 60, 3, 32, 0.2, 20, 1.0
#: A document is kept unless the trees give it less than this chance of being good.
KEEP_FROM = 0.4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Features of the trees and the direction in which each may move the score: -1 never up, 1 never down.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1,
    "distinct_ratio": 0, "upper_ratio": -1, "digit_ratio": 0, "exclaim_ratio": -1, "pipe_ratio": 0,
    "other_punct_ratio": 0, "mean_line": 0, "wide_ratio": 0,
}
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SPACE = np.frombuffer(b" \t\n\v\f\r", np.uint8)
_PUNCT = np.frombuffer(b".,;:?\"'()[]{}-_/\\+=@^`~", np.uint8)


def repeat_words(words: list[bytes]) -> tuple[int, int]:
    """How many words lie in a 3-word window that the text has twice or more; distinct words."""
    n = len(words)
    ids: dict[bytes, int] = {}
    put = ids.setdefault
    own = np.fromiter((put(w, len(ids)) for w in words), dtype=np.int64, count=n)
    if n < 4:
        return 0, len(ids)
    v = len(ids)
    if v < 2_000_000:
        key = (own[:-2] * v + own[1:-1]) * v + own[2:]
    else:
        _, pair = np.unique(own[:-2] * v + own[1:-1], return_inverse=True)
        key = pair.astype(np.int64) * v + own[2:]
    order = np.argsort(key)
    ranked = key[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0, v
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : k + len(key)] |= twice
    return int(covered.sum()), v


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """BASE counts and FEATURES of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes.split: exactly the white space of the word rule
    n = len(words)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = int(len(raw) - hist[0x80:0xC0].sum())
    spaces = int(hist[_SPACE].sum())
    word_chars = points - spaces
    n_symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat, distinct = repeat_words(words)
    w, c = max(n, 1), max(word_chars, 1)
    lead = int(hist[0xC0:].sum())
    features = [
        float(np.log1p(n)), word_chars / w, n_symbols / c, n_dup / max(len(lines), 1), n_repeat / w, distinct / w, float(hist[65:91].sum()) / c, float(hist[48:58].sum()) / c,
        float(hist[33]) / c, float(hist[124]) / c, float(hist[_PUNCT].sum()) / c, n / max(len(lines), 1), lead / c,
    ]
    return [n, word_chars, n_symbols, n_dup, n_repeat], features


@dataclass
class Forest:
    """All trees in flat arrays: node i asks feature[i] <= threshold[i], then left[i] or right[i];
    a leaf points to itself and holds value[i]."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            go = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(go, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, signs: list[int] | None = None, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Logistic boosting on histograms. A split on a constrained feature is taken only if the two
    leaf values are in its order; its children are then bounded by their middle, so that the whole
    tree is monotonic."""
    signs = signs or [0] * x.shape[1]
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    good = float(np.mean(y)) if len(y) else 1.0
    base = float(np.log(max(good, 1e-3) / max(1 - good, 1e-3)))
    edges, codes = [], np.zeros(x.shape, dtype=np.int64)
    for j in range(x.shape[1]):
        cuts = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(cuts)
        codes[:, j] = np.searchsorted(cuts, x[:, j], side="left")
    margin = np.full(len(x), base)
    if not len(y) or good in (0.0, 1.0):
        trees = 0

    def leaf(v: float) -> int:
        nodes.append([0, np.inf, len(nodes), len(nodes), v])
        return len(nodes) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        value = float(np.clip(gs / (hs + L2), low, high))
        best = None
        if level < depth and len(rows) >= 2 * LEAF:
            for j, cuts in enumerate(edges):
                if not len(cuts):
                    continue
                c, k = codes[rows, j], len(cuts) + 1
                gl, hl, nl = (np.cumsum(np.bincount(c, weights=w, minlength=k))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(gl / (hl + L2), low, high), np.clip((gs - gl) / (hs - hl + L2), low, high)
                gain = (2 * gl * vl - (hl + L2) * vl**2) + (2 * (gs - gl) * vr - (hs - hl + L2) * vr**2)
                ok = (nl >= LEAF) & (len(rows) - nl >= LEAF)
                if signs[j]:
                    ok &= signs[j] * (vr - vl) >= 0
                gain = np.where(ok, gain, -np.inf)
                i = int(np.argmax(gain))
                if np.isfinite(gain[i]) and (best is None or gain[i] > best[0] + 1e-12):
                    best = (gain[i], j, i, float(vl[i]), float(vr[i]))
        if best is None or best[0] <= 2 * gs * value - (hs + L2) * value**2 + 1e-9:
            at = leaf(RATE * value)
            margin[rows] += RATE * value
            return at
        _, j, i, vl, vr = best
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
        side = codes[rows, j] <= i
        nodes.append([j, edges[j][i], 0, 0, 0.0])
        at = len(nodes) - 1
        nodes[at][2] = grow(rows[side], g, h, level + 1, *bounds[0])
        nodes[at][3] = grow(rows[~side], g, h, level + 1, *bounds[1])
        return at

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(x)), y - p, p * (1 - p), 0, -4.0, 4.0))
    if not nodes:
        roots.append(leaf(0.0))
    a = np.array(nodes)
    return Forest(a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4], np.array(roots), base, depth)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [statistics(t)[1] for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(2), pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["own", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, text: str = "text") -> Forest:
    """Fits the trees on the labelled documents whose ids have the smallest hashes."""
    small_batches(docs)
    label = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("label_y"))
    sample = label.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    # the sample has at most max_labelled rows of two numbers
    rows = docs.select(F.col(text).alias("t"), F.col("doc_id").alias("label_id")).join(F.broadcast(sample), "label_id").select("t", F.col("label_y").cast("double").alias("y"), F.col("label_id").cast("string").alias("own"))
    # an id may stand on any number of rows: one of them for each id, so that the bound holds on the driver
    got = rows.mapInArrow(_features, "own string, x array<double>, y double").groupBy("own").agg(F.min("x").alias("x"), F.min("y").alias("y")).toArrow()
    x = np.array(got["x"].to_pylist(), dtype=float).reshape(-1, len(FEATURES))
    y = (got["y"].to_numpy() > 0.5).astype(float)
    order = np.lexsort(np.vstack([x.T, y]))  # rows arrive in any order: the model must not depend on it
    return fit(x[order], y[order], list(FEATURES.values()))


STRUCT = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,p_good:double,kept:boolean>"


def judge(docs: DataFrame, forest: Forest, text: str = "text", out: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """`docs` with a struct column `out`: the base counts, base_failed, p_good and kept."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.arrow_udf(STRUCT)
    def rate(texts: pa.Array) -> pa.Array:
        pairs = [statistics(t) for t in texts.to_pylist()]
        counts = np.array([a for a, _ in pairs], dtype=np.int64).reshape(-1, len(BASE))
        x = np.array([b for _, b in pairs]).reshape(-1, len(FEATURES))
        p = shared.value.probability(x)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        cols = [*counts.T, failed, p, ~failed & (p >= keep_from)]
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=[*BASE, "base_failed", "p_good", "kept"])

    return docs.withColumn(out, rate(F.col(text)))
