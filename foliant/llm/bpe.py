"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A text longer than a leaf is halved, and halved again down to leaves; all leaves are encoded side by
side, then the joins of each level of the tree. At a join a window around the cut is encoded afresh and
grows until both sides agree: its first token is the left half's there, and its last the right half's.

* Where the splitting pattern has places near the cut at which a piece ends whatever stands around it
  (a word before white space, letters before figures), the window reaches from one such place to another,
  so that the halves' tokens beyond it are those of the whole.
* Where the cut lies in one long unsplit piece (which may be megabytes), the window is one of tokens within
  that piece: every neighbouring pair of tokens then stands in some exact encoding, and for merge-rank BPE a
  sequence whose neighbouring pairs are all stable is the encoding of the whole.

Ids come from the vocabulary and merges of a tokenizers JSON file (its path is a parameter),
added tokens included; decoding is lossy only for ids that are no valid UTF-8, as in that library.
A vectorised UDF, no shuffle: a lost executor costs its own batches only, and memory is bounded
by a batch of texts.

Cases: a null or empty text has no ids and decodes to ''; repeated rows get equal answers; texts
may be of any length and need no spaces; the text of an added token is that token. Extra columns
are carried, never read; one with the name of the result gives way.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: A leaf has at most so many characters.
LEAF = 1 << 13
#: So many characters on either side of a cut the window begins with; in an unsplit piece so many tokens.
REACH, WINDOW = 64, 8
#: A window of tokens that grows beyond this gives way to the whole piece.
MOST_TOKENS = 64
#: A cut with no other piece's end so near lies in a long unsplit piece.
LONG_PIECE = 1 << 12
THREADS = 2

#: The splitting pattern of byte-level BPE vocabularies of this family (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Where a piece of the pattern ends in any context: the class of characters changes, but for white space
#: (which may go with what follows) and letters after an apostrophe.
ENDS = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])|(?<=[^\s\p{L}\p{N}])(?=\p{N})|(?<=[^\s\p{L}\p{N}'])(?=\p{L})"


def byte_symbols() -> dict[str, int]:
    """The printable symbol of each byte in such files: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, nxt = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            out[chr(nxt)] = b
            nxt += 1
    return out


class Codec:
    """Encoder and decoder for one tokenizers JSON file."""

    def __init__(self, path: str, leaf: int = LEAF, long_piece: int = LONG_PIECE, window: int = WINDOW, reach: int = REACH):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without prefix space or normaliser")
        symbol = byte_symbols()
        self.bytes_of = {i: bytes(symbol[c] for c in token) for token, i in model["vocab"].items() if all(c in symbol for c in token)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        ranks = {b: i for i, b in self.bytes_of.items() if i not in self.added.values()}
        # merging in rank order by id is the file's order of merges only if both agree
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        if ids != sorted(ids):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        self.encoding = tiktoken.Encoding("foliant", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.leaf, self.long_piece, self.window, self.reach = leaf, long_piece, window, reach
        self.rank = ranks
        self.next_end, self.last_end = regex.compile(ENDS), regex.compile(f"(?r)(?:{ENDS})")

    # encoding

    def encode(self, text: str | None, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        text = text or ""
        if self.split is None or not self.split.search(text):
            return self._plain(text, pool)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [self._plain(text[at : m.start()], pool), np.array([self.added[m[0]]], np.int32)]
            at = m.end()
        return np.concatenate([*out, self._plain(text[at:], pool)])

    def _plain(self, text: str, pool: ThreadPoolExecutor | None) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self._leaf(text), np.int32)
        return np.array(self.tree(text, pool), np.int32)

    def _leaf(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def tree(self, text: str, pool: ThreadPoolExecutor | None = None) -> list[int]:
        """Leaves side by side, then level by level the joins of neighbours."""
        run = pool.map if pool else map
        n = 1
        while len(text) > n * self.leaf:
            n *= 2
        cuts = [len(text) * i // n for i in range(n + 1)]
        parts = list(run(lambda i: self._leaf(text[cuts[i] : cuts[i + 1]]), range(n)))
        while len(parts) > 1:
            parts = list(run(lambda i: self.join(text, cuts[i], cuts[i + 1], cuts[i + 2], parts[i], parts[i + 1]), range(0, len(parts), 2)))
            cuts = cuts[::2]
        return parts[0]

    def _last(self, ids: list[int], size: int) -> int | None:
        """Where the last `size` bytes of ids begin, if a token begins there."""
        i = len(ids)
        while size > 0:
            i -= 1
            size -= len(self.bytes_of[ids[i]])
        return i if size == 0 else None

    def _first(self, ids: list[int], size: int) -> int | None:
        """Where the first `size` bytes of ids end, if a token ends there."""
        i = 0
        while size > 0:
            size -= len(self.bytes_of[ids[i]])
            i += 1
        return i if size == 0 else None

    def join(self, text: str, start: int, cut: int, end: int, left: list[int], right: list[int]) -> list[int]:
        """The encoding of text[start:end] from those of its parts on either side of `cut`."""
        reach = self.reach
        while True:
            m = self.last_end.search(text, start + 1, cut - reach) if cut - reach > start else None
            p = m.start() if m and m.start() > start else start
            m = self.next_end.search(text, cut + reach, end) if cut + reach < end else None
            q = m.start() if m else end
            if max(cut - p, q - cut) > self.long_piece:
                whole = self._unsplit(text, p, cut, q, left, right)
                if whole is not None:
                    return whole
            i, j = self._last(left, len(text[p:cut].encode())), self._first(right, len(text[cut:q].encode()))
            if i is not None and j is not None:
                inner = self._leaf(text[p:q])
                if (p == start or inner[0] == left[i]) and (q == end or inner[-1] == right[j - 1]):
                    return left[:i] + inner + right[j:]
            if p == start and q == end:
                return self._leaf(text[start:end])
            reach *= 2

    def _unsplit(self, text: str, p: int, cut: int, q: int, left: list[int], right: list[int]) -> list[int] | None:
        """The join within one piece of the pattern; None if the cut lies in a short piece or at a piece's end."""
        piece = next((m for m in self.pattern.finditer(text, p, q) if m.end() > cut), None)
        if piece is None or piece.start() >= cut or piece.end() - piece.start() <= self.long_piece:
            return None
        i0, j0 = self._last(left, len(text[piece.start() : cut].encode())), self._first(right, len(text[cut : piece.end()].encode()))
        if i0 is None or j0 is None:
            return None
        w = self.window
        while True:
            if w > MOST_TOKENS:  # a run of few characters may agree nowhere
                return left[:i0] + self._leaf(piece[0]) + right[j0:]
            i, j = max(len(left) - w, i0), min(w, j0)
            inner = self.merged(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == i0 or inner[0] == left[i]) and (j == j0 or inner[-1] == right[j - 1]):
                return left[:i] + inner + right[j:]
            w *= 2

    def merged(self, piece: bytes) -> list[int]:
        """A short piece by its definition: the neighbours of lowest rank are merged, the first of equals before others."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None:
                return [self.rank[x] for x in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    # decoding

    def decode(self, ids) -> str:
        return b"".join([self.bytes_of[int(i)] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_docs(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the ids of the whole text as array<int> in `out`."""
    small_batches(docs)

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        own = codec(path)
        with ThreadPoolExecutor(THREADS) as pool:
            ids = [own.encode(t, pool) for t in texts.to_pylist()]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))

    return docs.withColumn(out, encoded(F.col(text)))


def decode_docs(rows: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`rows` with the decoded text of array<int> `ids` in `out`."""

    @F.arrow_udf("string")
    def decoded(batch: pa.Array) -> pa.Array:
        own = codec(path)
        lists = batch if isinstance(batch, pa.ListArray) else pa.array(batch.to_pylist(), pa.list_(pa.int32()))
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        return pa.array([own.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())

    return rows.withColumn(out, decoded(F.col(ids)))
