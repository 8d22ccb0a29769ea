"""Language identification with interpolated Kneser-Ney character models.

Training counts character n-grams of the highest order over *all* learnable documents, in
Spark: each task reduces its batches to distinct n-grams, so the shuffle carries distinct
n-grams only. Lower orders follow by continuation (Kneser-Ney) as aggregations of those counts.
No n-gram is left out of the model, so it grows with the distinct n-grams of the corpus; it is
cut into shards by the middle two symbols of the four, so that a shard holds all that a position
of a text needs of the two highest orders. A shard has at most about SHARD_CELLS numbers, is
built in one task, and is kept as sorted arrays of n-gram hashes, with one column of
log-probabilities per language, in the shared folder: one search prices an n-gram in every
language at once. Only the two lowest orders, bounded by pairs of letters, are gathered on the driver.

Texts are priced by one pass over them for each shard (one in all for some millions of n-grams),
with that shard alone in memory; a pass adds the costs of the positions that its shard covers.

Texts are lower-cased; each run of non-letters is one boundary symbol. A document goes to the
language with the lowest cross-entropy per symbol. Rejection is calibrated on the counts: mean
and spread of the training symbols' cost give, for each language, the cost that a text of a
given length may have. The score is the posterior at the evidence of at most EVIDENCE symbols.

Cases: a null text, or one without letters, is `und` with score 0 and is rejected; without any
learnable document every text is `und`; ties go to the language first in alphabetical order; a
repeated row counts again in training and gets the same answer; a null doc_id is never learned
from and is not held out. Extra columns are carried, never read; one named as `out` gives way.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, removed, shared_dir, small_batches, unused

#: Highest n-gram order.
ORDER = 4
#: A symbol takes so many bits: ORDER of them fit one integer.
SYMBOL_BITS = 14
#: Ideographs and Hangul syllables share a symbol by blocks of this many code points.
WIDE_FROM, WIDE_BLOCK = 0x3400, 128
#: From here on, planes with few letters, so many code points share one.
FAR_FROM, FAR_BLOCK = 0x30000, 4096
#: A shard of the model has about so many log-probabilities of the highest order at most.
SHARD_CELLS = 1 << 25
#: Symbols that count as independent evidence in the score.
EVIDENCE = 40
#: Rejection: cost per symbol over the language's mean by more than this many nats, and by more
#: than so many standard errors.
REJECT_NATS, REJECT_Z = 0.9, 6.0
#: Texts are worked on in pieces of about so many characters: some 40 bytes of arrays for each.
PIECE = 1 << 18


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    letters = np.fromiter((chr(c).isalpha() for c in range(len(table))), dtype=bool, count=len(table))
    points = np.flatnonzero(letters).astype(np.uint32)
    far = WIDE_FROM + (FAR_FROM - WIDE_FROM) // WIDE_BLOCK + 1
    folded = np.where(points >= FAR_FROM, far + (points - np.minimum(points, FAR_FROM)) // FAR_BLOCK, WIDE_FROM + (points - np.minimum(points, WIDE_FROM)) // WIDE_BLOCK)
    table[points] = np.where(points >= WIDE_FROM, folded, points)
    return table


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, one after the other, each as boundary, letters and single
    boundaries, boundary; and the text that each symbol belongs to."""
    raw = "\x00".join(t.replace("\x00", " ") for t in texts).lower() + "\x00"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = points == 0
    doc = np.zeros(len(points), dtype=np.int32)
    np.cumsum(ends[:-1], out=doc[1:])
    sym = symbols()[points]
    blank = sym == 0
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1]) | (ends[:-1])
    # the first symbol of each text is a boundary: its terminating mark is kept, and one is put before
    keep &= ~ends
    last = np.flatnonzero(ends)
    sym, doc = sym[keep], doc[keep]
    lengths = np.bincount(doc, minlength=len(last))
    out = np.zeros(len(sym) + 2 * len(last), dtype=np.uint32)
    which = np.zeros(len(out), dtype=np.int32)
    at = np.arange(len(sym)) + 2 * doc + 1
    out[at] = sym
    which[at] = doc
    offs = np.concatenate([[0], np.cumsum(lengths + 2)])
    which[offs[:-1]] = np.arange(len(last))
    which[offs[1:] - 1] = np.arange(len(last))
    # text that begins or ends with a boundary now has it twice
    twice = np.zeros(len(out), dtype=bool)
    twice[1:] = (out[1:] == 0) & (out[:-1] == 0) & (which[1:] == which[:-1])
    return out[~twice], which[~twice]


def _pack(cols: list[np.ndarray]) -> np.ndarray:
    """Up to four symbols of 14 bits in one integer."""
    key = cols[0].astype(np.uint64)
    for c in cols[1:]:
        key = (key << np.uint64(SYMBOL_BITS)) | c
    return key


def _hash(cols: list[np.ndarray]) -> np.ndarray:
    """A hash that spreads packed symbols evenly, so that its leading bits serve as a directory."""
    return mix64(_pack(cols)) if cols else np.zeros(0, np.uint64)


def _pieces(texts: list[str]) -> Iterator[list[int]]:
    """Indices of texts by about PIECE characters, so that arrays stay small."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if now and size + len(t) > PIECE:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, gram, n): distinct n-grams of runs of batches, packed in a long."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, inv = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(inv, weights=np.concatenate([c for _, c in parts])).astype(np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, count = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            for piece in _pieces(own):
                held.setdefault(lang, []).append(_windows(*_codes([own[i] for i in piece])))
                size += len(held[lang][-1][0])
        if size > 800_000:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(parts[0][0]) for parts in held.values())
            if size > 400_000:
                yield from out()
                held, size = {}, 0
    yield from out()


def _columns(sym: np.ndarray, doc: np.ndarray, order: int) -> list[np.ndarray]:
    """The `order` symbols that end at each position but the first of a text; before a text: boundaries."""
    cols = [sym]
    for k in range(1, order):
        prev = np.zeros_like(sym)
        prev[k:] = np.where(doc[k:] == doc[:-k], sym[:-k], 0)
        cols.append(prev)
    return cols[::-1]


def _windows(sym: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.ones(len(sym), dtype=bool)
    first[1:] = doc[1:] != doc[:-1]
    return np.unique(_pack(_columns(sym, doc, ORDER))[~first], return_counts=True)


def _columns_of(key: np.ndarray) -> np.ndarray:
    """Packed n-grams of the highest order as rows of symbols."""
    shifts = np.arange(ORDER - 1, -1, -1, dtype=np.uint64) * np.uint64(SYMBOL_BITS)
    return ((key[:, None] >> shifts) & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.uint32)


Level = tuple[np.ndarray, np.ndarray]


@dataclass
class Shard:
    """The two highest orders over one range of middle pairs, in the order of `Model.low` and `low_backs`."""

    grams: list[Level]
    backs: list[Level]


@dataclass
class Model:
    """Per order: sorted hashes and log-probabilities [n, languages]; for contexts one symbol
    shorter: sorted hashes and log backoff weights [n, languages]. The two lowest orders are
    here, the others in `shards` tables of the folder `path`."""

    langs: list[str]
    low: list[Level] | None = None
    low_backs: list[Level] | None = None
    unknown: np.ndarray | None = None
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    shards: int = 0
    path: str = ""


class Finder:
    """Search in a sorted hash array through a directory of its leading bits."""

    BITS = 18

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.append(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
        edges = np.arange(1 << self.BITS, dtype=np.uint64) << np.uint64(64 - self.BITS)
        self.start = np.searchsorted(hashes, edges).astype(np.int32)
        self.n = len(hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position of each hash, or n where it is not there."""
        at = np.take(self.start, (h >> np.uint64(64 - self.BITS)).view(np.int64))
        here = np.take(self.hashes, at)
        todo = np.flatnonzero(here < h)
        while len(todo):
            at[todo] += 1
            here[todo] = own = np.take(self.hashes, at[todo])
            todo = todo[own < h[todo]]
        at[here != h] = self.n
        return at


def _discount(n1: float, n2: float) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _level(s: np.ndarray, count: np.ndarray, d: float) -> dict:
    """One language's n-grams of one order (rows of symbols, distinct) by hash: discounted shares and backoff weights."""
    h = _hash(list(s.T))
    at = np.argsort(h)
    h, s, count = h[at], s[at], count[at].astype(np.float64)
    context, cinv = np.unique(_hash(list(s[:, :-1].T)) if s.shape[1] > 1 else np.zeros(len(s), np.uint64), return_inverse=True)
    total, kinds = np.bincount(cinv, weights=count), np.bincount(cinv)
    return {"h": h, "s": s, "count": count, "p": np.maximum(count - d, 0) / total[cinv], "context": context, "back": d * kinds / total, "cinv": cinv}


def _interpolated(level: dict, low: dict | None, floor: float = 0.0) -> np.ndarray:
    """Probabilities: discounted share and, weighted, that of the n-gram one symbol shorter."""
    if low is None:
        return level["p"] + level["back"][level["cinv"]] * floor
    at = np.searchsorted(low["h"], _hash(list(level["s"][:, 1:].T)))
    return level["p"] + level["back"][level["cinv"]] * low["q"][at]


def _shorter(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their first symbol, and in how many different contexts each stands."""
    _, at, n = np.unique(_pack(list(s[:, 1:].T)), return_index=True, return_counts=True)
    return s[at, 1:], n


def _rows_of(per: list[dict], low: Level | None, unknown: np.ndarray) -> tuple[Level, Level]:
    """The union of the languages' n-grams of one order: a full row of log-probabilities for each; their contexts."""
    hashes, at = np.unique(np.concatenate([x["h"] for x in per]), return_index=True)
    s = np.concatenate([x["s"] for x in per])[at]
    logp = np.full((len(hashes), len(per)), np.nan)
    contexts = np.unique(np.concatenate([x["context"] for x in per]))
    back = np.zeros((len(contexts), len(per)))
    for k, x in enumerate(per):
        logp[np.searchsorted(hashes, x["h"]), k] = np.log(x["q"])
        back[np.searchsorted(contexts, x["context"]), k] = np.log(x["back"])
    # what a language has not seen: its backoff weight and the shorter n-gram
    if low is None:
        rest = np.broadcast_to(unknown, logp.shape)
    else:
        rest = low[1][np.searchsorted(low[0], _hash(list(s[:, 1:].T)))] + back[np.searchsorted(contexts, _hash(list(s[:, :-1].T)))]
    return (hashes, np.where(np.isnan(logp), rest, logp)), (contexts, back)


def lowest(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, discounts: dict) -> tuple[Model, list[list[dict]]]:
    """The two lowest orders from all pairs of symbols, with the number of symbols before each pair."""
    sym = _columns_of(gram.astype(np.uint64))[:, -2:]
    per: list[list[dict]] = []
    unknown = []
    for k in range(len(langs)):
        s, count = sym[lang == k], n[lang == k]
        pairs = _level(s, count, discounts[k, 2])
        single, kinds = _shorter(s)
        ones = _level(single, kinds, _discount((kinds == 1).sum(), (kinds == 2).sum()))
        vocabulary = len(single) + 1
        ones["q"] = _interpolated(ones, None, 1 / vocabulary)
        pairs["q"] = _interpolated(pairs, ones)
        unknown.append(np.log(ones["back"][0] / vocabulary))
        per.append([ones, pairs])
    model = Model(langs, unknown=np.array(unknown))
    one, one_back = _rows_of([x[0] for x in per], None, model.unknown)
    two, two_back = _rows_of([x[1] for x in per], one, model.unknown)
    model.low, model.low_backs = [one, two], [one_back, two_back]
    return model, [x[1] for x in per]


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    """The shard of packed n-grams, by their middle two symbols; `_shard_column` in numpy."""
    middle = (grams.astype(np.uint64) >> np.uint64(SYMBOL_BITS)) & np.uint64((1 << 2 * SYMBOL_BITS) - 1)
    return ((((middle * np.uint64(2654435761)) % np.uint64(1 << 32)) >> np.uint64(12)) % np.uint64(shards)).astype(np.int64)


def _shard_column(gram: Column, shards: int) -> Column:
    middle = F.shiftright(gram, SYMBOL_BITS).bitwiseAND(F.lit((1 << 2 * SYMBOL_BITS) - 1))
    return (F.shiftright((middle * F.lit(2654435761)) % F.lit(1 << 32), 12) % F.lit(shards)).cast("int")


def build_shard(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, model: Model, pairs: list[dict], discounts: dict) -> tuple[Shard, np.ndarray]:
    """The two highest orders over one shard's counts; per language the sums of count, cost and squared cost."""
    sym = _columns_of(gram.astype(np.uint64))
    three, four, sums = [], [], np.zeros((len(model.langs), 3))
    for k in range(len(model.langs)):
        s, count = sym[lang == k], n[lang == k]
        x4 = _level(s, count, discounts[k, 4])
        x3 = _level(*_shorter(s), discounts[k, 3]) if len(s) else _level(s[:, 1:], count, discounts[k, 3])
        x3["q"] = _interpolated(x3, pairs[k])
        x4["q"] = _interpolated(x4, x3)
        cost = -np.log(x4["q"])
        sums[k] = x4["count"].sum(), (cost * x4["count"]).sum(), (cost**2 * x4["count"]).sum()
        three.append(x3)
        four.append(x4)
    g3, b3 = _rows_of(three, model.low[1], model.unknown)
    g4, b4 = _rows_of(four, g3, model.unknown)
    return Shard([g3, g4], [b3, b4]), sums


SHARD_ROWS = "shard int, part int, hashes binary, logs binary"


def _shards(shared):
    """Rows (shard, lang, gram, n) sorted by shard -> its arrays: part 0, 1 n-grams, 2, 3 contexts, 4 the sums."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, pairs, discounts = shared.value
        now, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            lang, gram, n = (np.concatenate(x) for x in zip(*held))
            shard, sums = build_shard(lang, gram, n, model, pairs, discounts)
            parts = [(h, x.astype(np.float32)) for h, x in (*shard.grams, *shard.backs)] + [(np.zeros(0, np.uint64), sums)]
            for i, (h, x) in enumerate(parts):
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([i], pa.int32()), pa.array([h.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["shard", "part", "hashes", "logs"])

        for b in batches:
            own = b["shard"].to_numpy()
            for shard in np.unique(own):
                if now is not None and shard != now:
                    yield from out()
                    held = []
                now, mask = int(shard), own == shard
                held.append(tuple(b[c].to_numpy()[mask] for c in ("lang", "gram", "n")))
        if now is not None:
            yield from out()

    return shards


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", shard_cells: int = SHARD_CELLS) -> Model:
    """A model from the texts and non-null languages of the rows where `learn` holds; its shards stay
    in a folder of the shared store."""
    small_batches(docs)
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    own = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = scratch(own.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "four")
    shorter = lambda df, order: df.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << order * SYMBOL_BITS) - 1)).alias("gram")).agg(F.count("*").alias("n"))
    three = scratch(shorter(counts, 3), "three")
    two = scratch(shorter(three, 2), "two")
    heads = [x.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.count("*").alias("rows")).withColumn("order", F.lit(order)) for x, order in ((counts, 4), (three, 3), (two, 2))]
    heads = heads[0].unionAll(heads[1]).unionAll(heads[2]).collect()  # three rows for each language
    langs = sorted({r["lang"] for r in heads})
    if not langs:
        removed(spark, scratch.folder)
        return Model([])
    number = {x: k for k, x in enumerate(langs)}
    discounts = {(number[r["lang"]], r["order"]): _discount(r["n1"], r["n2"]) for r in heads}
    # pairs of letters that occur, by language: bounded by the alphabets
    rows = two.toArrow()
    model, pairs = lowest(langs, np.array([number[x] for x in rows["lang"].to_pylist()]), rows["gram"].to_numpy(), rows["n"].to_numpy(), discounts)
    model.shards = max(1, -(-sum(r["rows"] for r in heads if r["order"] == 4) * len(langs) // shard_cells))
    shared = spark.sparkContext.broadcast((model, pairs, discounts))
    which = F.create_map(*[F.lit(x) for pair in number.items() for x in pair])[F.col("lang")]
    parts = counts.select(_shard_column(F.col("gram"), model.shards).alias("shard"), which.alias("lang"), "gram", "n")
    path = f"{shared_dir(spark)}/language-model-{uuid.uuid4().hex}"
    parts.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(shared), SHARD_ROWS).write.partitionBy("shard").parquet(path)
    model.path = path
    sums = spark.read.parquet(path).where("part = 4").select("logs").collect()
    total, cost, square = sum(np.frombuffer(r["logs"]).reshape(-1, 3) for r in sums).T
    model.mean = cost / total
    model.spread = np.sqrt(np.maximum(square / total - model.mean**2, 0))
    removed(spark, scratch.folder)
    return model


def shard(spark, model: Model, k: int) -> Shard:
    """Shard k of a model: about SHARD_CELLS numbers."""
    rows = {r["part"]: r for r in spark.read.parquet(model.path).where(F.col("shard") == k).where("part < 4").collect()}
    read = [(np.frombuffer(rows[i]["hashes"], np.uint64), np.frombuffer(rows[i]["logs"], np.float32).reshape(-1, len(model.langs))) for i in range(4)] if rows else []
    return Shard(read[:2], read[2:]) if rows else Shard([], [])


class Scorer:
    """Prices texts with one shard."""

    def __init__(self, model: Model, own: Shard, number: int = 0):
        self.m, self.number, none = model, number, (np.zeros(0, np.uint64), np.zeros((0, len(model.langs)), np.float32))
        self.grams = [(h, x.astype(np.float32)) for h, x in [*model.low, *(own.grams or [none, none])]]
        self.back = [(h, x.astype(np.float32)) for h, x in [*model.low_backs, *(own.backs or [none, none])]]
        self.unknown = model.unknown.astype(np.float32)
        self.finders = [Finder(h) for h, _ in self.grams]
        self.backs = [Finder(h) for h, _ in self.back]

    def _order(self, cols: list[np.ndarray], order: int) -> np.ndarray:
        finder, logp = self.finders[order - 1], self.grams[order - 1][1]
        at = finder.find(_hash(cols))
        out = np.take(logp, np.minimum(at, finder.n - 1), axis=0) if finder.n else np.zeros((len(at), len(self.m.langs)), np.float32)
        miss = np.flatnonzero(at == finder.n)
        if len(miss):
            rest = [c[miss] for c in cols]
            if order == 1:
                out[miss] = self.unknown
            else:
                low = self._order(rest[1:], order - 1)
                back = self.backs[order - 1]
                b = back.find(_hash(rest[:-1]))
                known = b < back.n
                low[known] += self.back[order - 1][1][b[known]]
                out[miss] = low
        return out

    def sums(self, texts: list[str | None]) -> np.ndarray:
        """[text, languages + 2]: the costs of the positions that the shard covers, all symbols, letters."""
        n, langs = len(texts), len(self.m.langs)
        out = np.zeros((n, langs + 2))
        texts = [t or "" for t in texts]
        for piece in _pieces(texts):
            sym, doc = _codes([texts[i] for i in piece])
            first = np.ones(len(sym), dtype=bool)
            first[1:] = doc[1:] != doc[:-1]
            out[piece, langs + 1] = np.bincount(doc, weights=sym > 0, minlength=len(piece))
            cols = [c[~first] for c in _columns(sym, doc, ORDER)]
            doc = doc[~first]
            out[piece, langs] = np.bincount(doc, minlength=len(piece))
            if self.m.shards > 1:
                mine = shard_of(_pack(cols), self.m.shards) == self.number
                cols, doc = [c[mine] for c in cols], doc[mine]
            logp = self._order(cols, ORDER)
            some, starts = np.unique(doc, return_index=True)
            if len(some):
                for k in range(langs):
                    out[np.array(piece)[some], k] = -np.add.reduceat(logp[:, k].astype(np.float64), starts)
        return out


def decide(model: Model, sums: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, rejected, from the sums of all shards."""
    total, count, letters = sums[:, :-2], sums[:, -2], sums[:, -1]
    mean = total / np.maximum(count, 1)[:, None]
    best = np.argmin(mean, axis=1)
    low = mean[np.arange(len(mean)), best]
    evidence = np.minimum(count, EVIDENCE)[:, None]
    score = 1 / np.exp(-(mean - low[:, None]) * evidence).sum(axis=1)
    excess = low - model.mean[best]
    error = model.spread[best] / np.sqrt(np.maximum(count, 1))
    rejected = (excess > REJECT_NATS) & (excess > REJECT_Z * error)
    some = letters > 0
    return [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), some)], np.where(some, score, 0.0), rejected | ~some


STRUCT = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _answer(pred: list[str], score: np.ndarray, rejected: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], fields=list(STRUCT))


def _predictor(shared):
    kept: dict = {}

    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        if not shared.value[0].langs:
            return _answer(["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool))
        if "scorer" not in kept:
            kept["scorer"] = Scorer(*shared.value)
        return _answer(*decide(shared.value[0], kept["scorer"].sums(texts.to_pylist())))

    return predict


def _adder(shared):
    kept: dict = {}

    @F.arrow_udf("array<double>")
    def added(texts: pa.Array, before: pa.Array) -> pa.Array:
        if "scorer" not in kept:
            kept["scorer"] = Scorer(*shared.value)
        sums, langs = kept["scorer"].sums(texts.to_pylist()), len(shared.value[0].langs)
        if shared.value[2]:  # symbols and letters are counted by the first shard
            sums[:, langs:] = 0
            sums += np.array(before.to_pylist()).reshape(sums.shape)
        return pa.array(list(sums), pa.list_(pa.float64()))

    return added


def _decider(shared):
    @F.arrow_udf("struct<lang:string,score:double,rejected:boolean>")
    def decided(sums: pa.Array) -> pa.Array:
        model = shared.value
        return _answer(*decide(model, np.array(sums.to_pylist()).reshape(-1, len(model.langs) + 2)))

    return decided


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct column `out`: lang, score (0 to 1), rejected. No shuffle. A model of
    several shards takes a pass for each, with `docs` and the sums so far written in between."""
    small_batches(docs)
    spark, send = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    if model.shards <= 1:
        return docs.withColumn(out, _predictor(send((model, shard(spark, model, 0) if model.langs else Shard([], []), 0)))(F.col(text)))
    column, before = unused(docs, "sums"), None
    rows = docs.withColumn(column, F.lit(None).cast("array<double>"))
    for k in range(model.shards):
        scratch = Scratch(spark, "priced")
        rows = scratch(rows.withColumn(column, _adder(send((model, shard(spark, model, k), k)))(F.col(text), F.col(column))), "pass")
        if before:
            removed(spark, before.folder)
        before = scratch
    return rows.withColumn(out, _decider(send(model))(F.col(column))).drop(column)


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
