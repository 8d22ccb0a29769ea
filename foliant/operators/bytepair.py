"""Encoding and decoding by byte pairs with special tokens, over whole columns of texts.

A text is first cut at the special tokens, wherever one stands the longest: one automaton finds all of them in a
single pass. What lies between is brought to NFC, split by the pattern, and each piece is merged from its bytes, the
neighbours of lowest rank first, leftmost on a tie. A piece is a linked list with a heap of its ranked neighbours, so n
bytes take n log n steps. Symbols without an id get the unknown id, or go if there is none. Decoding joins what ids stand for,
unknown ids left out, and specials too if they are skipped; bytes that are no UTF-8 become U+FFFD.

The texts of a batch are encoded together: each piece has a number, those not met before are merged at once, one merge of every piece
in a round over arrays of symbols (long pieces on their own, as above), and ids are gathered by the numbers.

Cases: null gives null, an empty text no ids; a special inside a piece still cuts it; an empty special is ignored.
A codec is the size of its vocabulary, in each Python worker once, with the pieces of a batch.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The splitting pattern (fixed value).
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
#: The same over ASCII, where its classes are ranges that the standard library's matcher takes faster.
ASCII_PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\nA-Za-z0-9]?[A-Za-z]+|[0-9]| ?[^\t-\r A-Za-z0-9]+[\r\n]*|[\t-\r ]*[\r\n]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
REMEMBERED = 1 << 16
#: Pieces that are remembered from batch to batch.
NUMBERED = 1 << 18
#: Cells of a table of all pairs of symbols, beyond which pairs are searched.
DENSE = 1 << 22
#: Bytes of a piece that is merged along with others.
TOGETHER = 256
_NONE = np.iinfo(np.int32).max
#: Symbols of a piece that is merged without a heap.
SHORT = 32


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(other)) for b in range(256)]


def merge_short(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same by looking at all neighbours each time, which takes less for a word than a heap does."""
    # any number may be a rank: they need not begin at 0, and a pair that is named twice leaves a gap
    symbols, none = list(symbols), float("inf")
    while len(symbols) > 1:
        found = [ranks.get(pair, none) for pair in zip(symbols, symbols[1:])]
        lowest = min(found)
        if lowest == none:
            break
        k = found.index(lowest)
        symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges the neighbours of lowest rank, leftmost first, until none has a rank."""
    n = len(symbols)
    if n < 2:
        return symbols
    if n <= SHORT:
        return merge_short(symbols, ranks)
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, k) for k in range(n - 1) if (r := ranks.get((symbols[k], symbols[k + 1]))) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        rank, k = heapq.heappop(heap)
        after = right[k]
        if gone[k] or after < 0 or ranks.get((symbols[k], symbols[after])) != rank:
            continue  # what stood here was merged before
        symbols[k] += symbols[after]
        gone[after] = True
        right[k] = right[after]
        if right[k] >= 0:
            left[right[k]] = k
        for first in (left[k], k):
            if first >= 0 and right[first] >= 0 and (r := ranks.get((symbols[first], symbols[right[first]]))) is not None:
                heapq.heappush(heap, (r, first))
    return [s for s, away in zip(symbols, gone) if not away]


class Pairs:
    """Ranks of pairs of symbols and what they become, by numbers: the bytes first, then what merges name."""

    def __init__(self, letters: list[str], ranks: dict[tuple[str, str], int]):
        self.symbols = {c: k for k, c in enumerate(letters)}
        for a, b in ranks:
            for s in (a, b, a + b):
                self.symbols.setdefault(s, len(self.symbols))
        self.size = n = len(self.symbols)
        keys = np.array([self.symbols[a] * n + self.symbols[b] for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        # ranks by their order, since any number may be one
        place = np.argsort(np.argsort(np.array(list(ranks.values()), np.int64), kind="stable"))
        self.ranks = place[order].astype(np.int32)
        self.merged = np.zeros(len(ranks), np.int32)
        self.merged[place] = [self.symbols[a + b] for a, b in ranks]
        self.table = None
        if n * n <= DENSE:
            self.table = np.full(n * n, _NONE, np.int32)
            self.table[self.keys] = self.ranks

    def ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first * np.int64(self.size) + second
        if self.table is not None:
            return self.table[keys]
        if not len(self.keys):
            return np.full(len(keys), _NONE, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], _NONE)

    def merge_all(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges many pieces, none empty, that lie one behind the other: their symbols and how many each has."""
        own, done = np.repeat(np.arange(len(sizes)), sizes), []
        while len(symbols):
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            ranks = np.full(len(symbols), _NONE, np.int32)
            ranks[:-1] = np.where(own[:-1] == own[1:], self.ranks_of(symbols[:-1], symbols[1:]), _NONE)
            lowest = np.minimum.reduceat(ranks, starts)
            lengths = np.diff(starts, append=len(symbols))
            more = np.repeat(lowest < _NONE, lengths)
            done.append((own[~more], symbols[~more]))
            # the leftmost neighbours of lowest rank in each piece that has any
            found = np.flatnonzero(more & (ranks == np.repeat(lowest, lengths)))
            found = found[np.flatnonzero(np.diff(own[found], prepend=-1))]
            symbols[found] = self.merged[ranks[found]]
            more[found + 1] = False
            own, symbols = own[more], symbols[more]
        own, symbols = (np.concatenate([x[k] for x in done]) if done else np.zeros(0, np.int64) for k in (0, 1))
        return symbols[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(sizes))


class Numbers(dict):
    """Pieces by number, in the order in which they are first asked for."""

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        return n


@dataclass
class Codec:
    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int] = field(default_factory=dict)
    unknown: int | None = None

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("vocab", "merges", "specials", "unknown")}

    @cached_property
    def ranks(self) -> dict[tuple[str, str], int]:
        return {tuple(pair): k for k, pair in reversed(list(enumerate(self.merges)))}

    @cached_property
    def finder(self):
        found = ahocorasick.Automaton()
        for text in self.specials:
            if text:
                found.add_word(text, text)
        found.make_automaton()
        return found

    @cached_property
    def pattern(self):
        return regex.compile(PATTERN)

    @cached_property
    def ascii_pattern(self):
        return re.compile(ASCII_PATTERN)

    @cached_property
    def letters(self) -> list[str]:
        return byte_letters()

    @cached_property
    def bytes_of(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(self.letters)}

    @cached_property
    def texts(self) -> dict[int, str]:
        return {k: t for t, k in [*self.vocab.items(), *self.specials.items()]}

    @cached_property
    def spelled(self) -> dict[int, bytes]:
        """The bytes that each id stands for."""
        return {k: bytes(self.bytes_of[c] for c in t if c in self.bytes_of) for k, t in self.texts.items()}

    @cached_property
    def spelled_plainly(self) -> dict[int, bytes]:
        """The same without specials."""
        gone = set(self.specials.values())
        return {k: b for k, b in self.spelled.items() if k not in gone}

    @cached_property
    def seen(self) -> dict[str, list[int]]:
        return {}

    def cut(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text's parts in order, and whether each is a special token: from the left, the longest that stands there."""
        if not len(self.finder):
            yield text, False
            return
        longest: dict[int, int] = {}
        for last, word in self.finder.iter(text):
            begin = last + 1 - len(word)
            longest[begin] = max(last + 1, longest.get(begin, 0))
        at = 0
        for begin in sorted(longest):
            if begin < at:
                continue
            if begin > at:
                yield text[at:begin], False
            at = longest[begin]
            yield text[begin:at], True
        if at < len(text):
            yield text[at:], False

    def piece_ids(self, piece: str) -> list[int]:
        known = self.seen.get(piece)
        if known is None:
            symbols = merge([self.letters[b] for b in piece.encode()], self.ranks)
            known = [self.vocab.get(s, self.unknown) for s in symbols]
            known = [k for k in known if k is not None]
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            if len(piece) <= 64:
                self.seen[piece] = known
        return known

    def pieces(self, text: str) -> list[str]:
        return self.ascii_pattern.findall(text) if text.isascii() else self.pattern.findall(unicodedata.normalize("NFC", text))

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.cut(text):
            if special:
                out.append(self.specials[part])
            else:
                seen, ids_of = self.seen, self.piece_ids
                for piece in self.pieces(part):
                    known = seen.get(piece)
                    out += ids_of(piece) if known is None else known
        return out

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.letters, self.ranks)

    @cached_property
    def ids_of_symbols(self) -> np.ndarray:
        """Ids of the symbols of `pairs`; -1 if there is none."""
        other = -1 if self.unknown is None else self.unknown
        return np.array([self.vocab.get(s, other) for s in self.pairs.symbols], np.int64)

    def ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one behind the other, and how many each has."""
        spelled = [p.encode() for p in pieces]
        sizes = np.array([len(b) if len(b) <= TOGETHER else 0 for b in spelled], np.int64)
        some = np.flatnonzero(sizes)
        symbols, merged = self.pairs.merge_all(np.frombuffer(b"".join([spelled[k] for k in some.tolist()]), np.uint8).astype(np.int32), sizes[some])
        ids, own = self.ids_of_symbols[symbols], np.repeat(some, merged)
        for k, b in enumerate(spelled):
            if len(b) > TOGETHER:
                long = np.array(self.piece_ids(pieces[k]), np.int64)
                ids, own = np.concatenate([ids, long]), np.concatenate([own, np.full(len(long), k)])
        ids, own = ids[ids >= 0], own[ids >= 0]
        return ids[np.argsort(own, kind="stable")].astype(np.int32), np.bincount(own, minlength=len(pieces))

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one behind the other, and where each ends; null has none."""
        kept = self.__dict__.get("_kept")
        if kept is None or len(kept[0]) > NUMBERED:
            special = np.array(list(self.specials.values()), np.int32)
            # a special token's number is told from a piece of the same letters by its kind of key
            kept = Numbers({(t,): k for k, t in enumerate(self.specials)}), special, np.ones(len(special), np.int64)
        numbers, ids, sizes = kept
        number, found, ends = numbers.__getitem__, [], []
        for text in texts:
            for part, special in self.cut(text) if text else ():
                if special:
                    found.append(numbers[part,])
                else:
                    found.extend(map(number, self.pieces(part)))
            ends.append(len(found))
        new = [p for k, p in enumerate(numbers) if k >= len(sizes)]
        if new:
            new_ids, new_sizes = self.ids_of_pieces(new)
            ids, sizes = np.concatenate([ids, new_ids]), np.concatenate([sizes, new_sizes])
        self._kept = numbers, ids, sizes
        places = np.array(found, np.int64)
        lengths = sizes[places]
        upto = np.cumsum(lengths)
        taken = np.arange(upto[-1] if len(upto) else 0) + np.repeat((np.cumsum(sizes) - sizes)[places] - upto + lengths, lengths)
        return ids[taken], np.concatenate([[0], upto])[np.array(ends, np.int64)]

    def decode(self, ids: list[int], skip_specials: bool = False) -> str:
        known = self.spelled_plainly if skip_specials else self.spelled
        return b"".join([known.get(k, b"") for k in ids]).decode(errors="replace")


def load(spark: SparkSession, path: str) -> Codec:
    """A codec from a tokenizer's JSON file: model.vocab, model.merges, added_tokens."""
    root = json.loads(spark.read.text(path, wholetext=True).first()[0])
    model = root["model"]
    if model.get("type") != "BPE":
        raise ValueError(f"{path}: no byte-pair model")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    vocab, specials = dict(model["vocab"]), {}
    for t in root.get("added_tokens", []):
        if t["content"]:
            (specials if t.get("special", True) else vocab)[t["content"]] = t["id"]
    if not vocab or not merges:
        raise ValueError(f"{path}: no vocabulary or no merges")
    return Codec(vocab, merges, specials, vocab.get(model.get("unk_token") or ""))


def encoded(c: Column, codec: Codec) -> Column:
    """Ids of a text."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(texts: pa.Array) -> pa.Array:
        ids, ends = codec.encode_all(texts.to_pylist())
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32(), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))

    # the same ids each time; called so, Spark encodes a text once where its ids are used several times
    return encode.asNondeterministic()(c)


def decoded(c: Column, codec: Codec, skip_specials: bool = False) -> Column:
    """The text of ids."""

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        flat = ids.flatten().to_pylist() if ids.flatten().null_count else ids.flatten().to_numpy().tolist()
        ends = np.cumsum([0, *ids.value_lengths().fill_null(0).to_numpy()]).tolist()
        return pa.array([None if null else codec.decode(flat[a:b], skip_specials) for a, b, null in zip(ends, ends[1:], ids.is_null().to_pylist())], pa.string())

    return decode(c)
