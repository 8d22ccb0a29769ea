"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised on their own; a pair of centroids is a cell. A query walks
the cells by the sum of its halves' products with the centroids, best first, with a heap, until the
cells walked hold a share of all entries. That share is calibrated when the index is fitted: the
smallest that holds TARGET of the true neighbours in a bounded sample, so it adapts to the data. What
the cells hold is reranked exactly, in double precision on the original vectors.

The quantiser is fitted on a bounded sample (SAMPLE rows with the smallest hash of their id); every
row is indexed. Centroids are numbered along their main direction, and cells are packed in that order
into blocks of about BLOCK entries, so that cells near each other share a block; a larger cell is dealt
over several, so a third of all rows in one cell is many blocks. Entries and the queries that walk one
of a block's cells meet in one task, entries first, queries streaming past them in batches. Products
are taken with the entries of the cells that a query walks only; each block gives at most k rows for a
query, and a window takes the best k.

Cases: vectors that are null, zero, of another length than most of the sample, or hold null or
non-finite components take no part, nor do rows without id; repeated ids are one query each, with the
smallest of their vectors, and all stay candidates of others; products that overflow are infinite and
rank as such, one that is no number ranks last; ties go to the smaller id; fewer than k candidates
give fewer rows; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SAMPLE = 16_384
#: Queries of the sample used to calibrate the share, and the share of their neighbours to hold.
PROBES, TARGET = 256, 0.94
BLOCK = 4096
#: A walk takes milliseconds, so few queries make a task.
QUERIES_PER_TASK = 256
#: Centroids of a half: 2 to the power of a quarter of the binary digits of the number of rows, and four more.
LEAST_BITS, MOST_BITS = 2, 8
K = 20
ROUNDS = 12


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's centroids, the start drawn with a fixed seed; an empty one stays where it was."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = assign(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    # numbered along the direction in which they differ most
    _, _, axes = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)
    along = (c - c.mean(axis=0)) @ axes[0] if len(axes) else np.zeros(len(c))
    return c[np.argsort(along, kind="stable")]


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(axis=1) - 2 * x @ c.T, axis=1)


@dataclass
class Index:
    first: np.ndarray
    second: np.ndarray
    share: float
    dim: int

    @property
    def half(self) -> int:
        return self.dim // 2

    def cells(self, x: np.ndarray) -> np.ndarray:
        return assign(x[:, : self.half], self.first) * len(self.second) + assign(x[:, self.half :], self.second)


def walk(q: np.ndarray, index: Index, held: np.ndarray, wanted: float) -> list[int]:
    """Cells by falling sum of the halves' products, until they hold `wanted` entries. The heap has
    the frontier of a grid whose rows and columns are the centroids in the query's order."""
    a, b = index.first @ q[: index.half], index.second @ q[index.half :]
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, n = a[ia].tolist(), b[ib].tolist(), len(b)
    ia, ib, held = ia.tolist(), ib.tolist(), held
    heap, out, got = [(-(a[0] + b[0]), 0, 0)], [], 0
    while heap and got < wanted:
        _, i, j = heapq.heappop(heap)
        cell = ia[i] * n + ib[j]
        if held[cell]:
            out.append(cell)
            got += held[cell]
        if j + 1 < n:
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
    return out


def top(scores: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids and exact scores; `scores` of a matrix product only narrow the choice. A product beyond the doubles
    is infinite and ranks as such; one that is no number ranks behind all others."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= (edge - 1e-9 * (1 + abs(edge)) if np.isfinite(edge) else edge))
    else:
        near = np.arange(len(scores))
    with np.errstate(over="ignore", invalid="ignore"):
        exact = (v[near] * q).sum(axis=1)
    order = np.lexsort((ids[near], -np.where(np.isnan(exact), -np.inf, exact)))[:k]
    return ids[near][order], exact[order]


def fit(rows: list[list[float]], total: int) -> Index | None:
    """An index from a sample of the vectors of a table with `total` rows."""
    if not rows:
        return None
    dim = Counter(map(len, rows)).most_common(1)[0][0]
    x = np.array([r for r in rows if len(r) == dim], dtype=float)
    k = 2 ** int(np.clip(np.log2(max(total, 2)) // 4 + 4, LEAST_BITS, MOST_BITS))
    index = Index(kmeans(x[:, : dim // 2], k, 1), kmeans(x[:, dim // 2 :], k, 2), 1.0, dim)
    cells = index.cells(x)
    held = np.bincount(cells, minlength=len(index.first) * len(index.second)).tolist()
    reached = []
    for q in x[:: max(1, len(x) // PROBES)]:
        best = np.argsort(-(x @ q), kind="stable")[: K + 1]
        order = walk(q, index, held, len(x))
        upto = dict(zip(order, np.cumsum([held[c] for c in order]) / len(x)))
        reached += [upto[c] for c in cells[best]]
    index.share = float(np.quantile(reached, TARGET))
    return index


def valid(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _visits(shared, wanted: float):
    """(id, vec) -> for each block walked: the block, the id, the vector and its cells there."""

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, held, first, parts, salts = shared.value
        for b in batches:
            ids, x = b["id"].to_pylist(), _matrix(b["vec"], index.dim)
            out: list[tuple] = []
            for own, q in zip(ids, x):
                by: dict[int, list[int]] = {}
                for cell in walk(q, index, held, wanted):
                    for p in range(parts[cell]):
                        by.setdefault(int(first[cell]) + p, []).append(cell)
                out += [(block, 1, own, q.tolist(), cells) for block, cells in by.items()]
                if len(out) > 4096:
                    yield _rows(out)
                    out = []
            yield _rows(out)

    return visits


ROWS = "block int, kind int, id long, vec array<double>, cells array<int>"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "kind", "id", "vec", "cells"])


def _entries(shared):
    """(id, vec) -> the block that holds the entry, and its cell."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, first, parts, _ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            cells = index.cells(_matrix(b["vec"], index.dim))
            block = first[cells] + b["salt"].to_numpy() % parts[cells]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.astype(np.int32)), pa.array(np.zeros(len(block), np.int32)), b["id"], b["vec"], pa.array([[c] for c in cells.tolist()], pa.list_(pa.int32()))],
                names=["block", "kind", "id", "vec", "cells"],
            )

    return entries


def _search(dim: int, k: int):
    """Rows sorted by (block, kind): the entries of a block, then the queries that walk it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, ready = None, [], None
        for b in batches:
            blocks, kinds = b["block"].to_numpy(), b["kind"].to_numpy()
            edge = np.flatnonzero(np.diff(blocks) | np.diff(kinds)) + 1
            for a, z in zip([0, *edge], [*edge, len(blocks)]):
                if a == z:
                    continue
                run = b.slice(a, z - a)
                if blocks[a] != block:
                    block, parts, ready = blocks[a], [], None
                ids, x, cells = run["id"].to_numpy(), _matrix(run["vec"], dim), run["cells"]
                if kinds[a] == 0:
                    parts.append((ids, x, cells.flatten().to_numpy()))
                    continue
                if not parts:
                    continue
                if ready is None:
                    ready = tuple(np.concatenate(p) for p in zip(*parts))
                    own_cells, cell_of = np.unique(ready[2], return_inverse=True)
                vids, v, _ = ready
                found: list[tuple] = []
                for i in range(len(ids)):
                    seen = np.isin(own_cells, np.array(cells[i].as_py()))
                    near = np.flatnonzero(seen[cell_of] & (vids != ids[i]))
                    w = v[near]
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = w @ x[i]
                    got, exact = top(scores, vids[near], x[i], w, k)
                    found += [(int(ids[i]), int(g), float(e)) for g, e in zip(got, exact)]
                yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in found], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    return search


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(vectors: DataFrame, queries: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest other rows, by inner product, of each row for which `queries` holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec"), queries.alias("asked"))
    rows = stored(rows.where(F.col("id").isNotNull() & valid(F.col("vec"))), "vectors")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "vec").toArrow()
    total = rows.count()
    index = fit(sample["vec"].to_pylist(), total)
    if index is None:
        return spark.createDataFrame([], RESULT)
    rows = rows.where(F.size("vec") == index.dim).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("long"))

    n_cells = len(index.first) * len(index.second)
    model = spark.sparkContext.broadcast(index)

    def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_cells, np.int64)
        for b in batches:
            if b.num_rows:
                n += np.bincount(model.value.cells(_matrix(b["vec"], model.value.dim)), minlength=n_cells)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["cell", "n"])

    # at most 2^16 cells, however many rows
    held = np.zeros(n_cells, np.int64)
    for r in rows.select("vec").mapInArrow(cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        held[r["cell"]] = r["n"]
    parts = np.maximum(1, -(-held // BLOCK))
    first, now, room = np.zeros(n_cells, np.int64), -1, 0
    for cell in range(n_cells):
        if parts[cell] > 1:
            first[cell], now, room = now + 1, now + int(parts[cell]), 0
        else:
            if held[cell] > room:
                now, room = now + 1, BLOCK
            first[cell], room = max(now, 0), room - int(held[cell])
    shared = spark.sparkContext.broadcast((index, held.tolist(), first, parts, None))

    entries = rows.select("id", "vec", "salt").mapInArrow(_entries(shared), ROWS)
    asked = stored(rows.where("asked").groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    asked = asked.repartition(max(1, -(-asked.count() // QUERIES_PER_TASK)), "id")
    visits = asked.mapInArrow(_visits(shared, index.share * float(held.sum())), ROWS)
    met = entries.unionByName(visits).repartition("block").sortWithinPartitions("block", "kind")
    found = met.mapInArrow(_search(index.dim, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
