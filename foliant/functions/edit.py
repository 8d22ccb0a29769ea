"""Edit distance and the edits of texts of any length.

A column of the distance matrix is two numbers of as many bits as the first text has characters: where it rises and
where it falls from a cell to the next. A character of the second text moves the whole column by a few operations on
these, so n by m characters take n times m / 64 steps and memory for one column. What two texts have in common at
both ends is taken off first.

The pairs of a batch are swept together: columns are words of 64 characters, those of many pairs lie in one array of LANES words, and a
word is one step behind the word above it, whose last cell it needs. So one operation on the array moves all words of all pairs, and
pairs of like lengths go together. One pair alone, and texts of very many different characters, move by whole numbers of any length.

Edits come from the same columns. Where those of all characters take HELD bits at most they are kept, and an alignment is
walked back through them; longer texts are cut first: the second text is halved, the first one cut where the distances of both
halves add up to the least. So no more than HELD bits are ever held for a pair (4 * HELD for the pairs of a sweep), and a text
within them takes one pass.

Cases: characters are code points; null gives null; an empty text is as far as the other one is long. Of several
alignments with the least number of edits one is counted, always the same: cuts come first, and on the way back a step along
both texts goes before one along the second, and that before one along the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Bits of columns that are held at once.
HELD = 1 << 28
#: Words of columns that are swept together.
LANES = 4096
#: Words that tell where the characters of the first texts of a sweep are, at most.
PLACES = 1 << 22
_WORD = np.dtype("<u8")
#: Room for the columns that a sweep holds, which the process's next sweep takes again.
_room = np.zeros(0, _WORD)


class Edits(NamedTuple):
    """How a text becomes the other: characters replaced, put in and taken out."""

    replaced: int = 0
    added: int = 0
    removed: int = 0

    def __add__(self, other: Edits) -> Edits:
        return Edits(*(a + b for a, b in zip(self, other)))


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _bare(a: str, b: str) -> tuple[str, str]:
    """Both without what they share at either end."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    return (a[: len(a) - n], b[: len(b) - n]) if n else (a, b)


def _column(a: str, b: str) -> tuple[int, int]:
    """Rises and falls of the last column of the matrix of `a` (down) and `b` (across)."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rises, falls = full, 0
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up = falls | ~(diagonal | rises) & full
        down = rises & diagonal
        up, down = (up << 1 | 1) & full, down << 1 & full
        rises, falls = (down | ~(diagonal | up)) & full, up & diagonal
    return rises, falls


def distance(a: str, b: str) -> int:
    a, b = _bare(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):  # the column is that of the shorter one
        a, b = b, a
    rises, falls = _column(a, b)
    return len(b) + rises.bit_count() - falls.bit_count()


def _distances(a: str, b: str) -> np.ndarray:
    """Distance of each beginning of `a`, the empty one first, to the whole of `b`."""
    rises, falls = _column(a, b)
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)].astype(np.int64)
    return np.concatenate([[len(b)], len(b) + np.cumsum(bits(rises) - bits(falls))])


def _walked(a: str, b: str) -> Edits:
    """Edits of two texts whose columns are held: each column's rises, and its falls along the second text, from the last cell back."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    rises, falls = full, 0
    columns: list[tuple[int, int, int]] = []
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & rises) + rises) ^ rises) | same | falls
        up = falls | ~(diagonal | rises) & full
        down = rises & diagonal
        # a cell is one more than its left one where `up` is set, and follows from the one above where `rises` is
        across, (up, down) = up, ((up << 1 | 1) & full, down << 1 & full)
        rises, falls = (down | ~(diagonal | up)) & full, up & diagonal
        columns.append((across, rises, same))
    size = len(a) // 8 + 1
    i, j, held = len(a), len(b), -1
    replaced = added = removed = 0
    while i and j:
        if held != j:
            across, rises, same = (x.to_bytes(size, "little") for x in columns[j - 1])
            held = j
        byte, bit = i - 1 >> 3, 1 << (i - 1 & 7)
        if same[byte] & bit:
            i, j = i - 1, j - 1
        elif across[byte] & bit:
            added, j = added + 1, j - 1
        elif rises[byte] & bit:
            removed, i = removed + 1, i - 1
        else:
            replaced, i, j = replaced + 1, i - 1, j - 1
    return Edits(replaced, added + j, removed + i)


def edits(a: str, b: str) -> Edits:
    """Edits of an alignment with the least number of them."""
    total, todo = Edits(), [(a, b)]
    while todo:
        a, b = _bare(*todo.pop())
        if not a or not b:
            total += Edits(added=len(b), removed=len(a))
        elif len(b) == 1:  # one character: in its place if `a` has it, else instead of one
            total += Edits(removed=len(a) - 1) if b in a else Edits(1, 0, len(a) - 1)
        elif len(a) == 1:
            total += Edits(added=len(b) - 1) if a in b else Edits(1, len(b) - 1, 0)
        elif 3 * len(a) * len(b) <= HELD:
            total += _walked(a, b)
        else:
            half = len(b) // 2
            cut = int(np.argmin(_distances(a, b[:half]) + _distances(a[::-1], b[half:][::-1])[::-1]))
            todo += [(a[:cut], b[:half]), (a[cut:], b[half:])]
    return total


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _grouped(pairs: list[tuple[str, str]], hold: bool) -> Iterator[list[int]]:
    """Numbers of the pairs that are swept together: of like steps, within LANES words and within HELD bits of characters or, if columns are held, twice HELD bits of each kind."""
    group: list[int] = []
    lanes = steps = 0
    for k in sorted(range(len(pairs)), key=lambda k: len(pairs[k][1])):
        words = -(-len(pairs[k][0]) // 64)
        longest = max(steps, len(pairs[k][1]) + words)
        if group and (lanes + words > LANES or ((lanes + words) / 2 if hold else len(group) + 1) * longest * 64 > HELD):
            yield group
            group, lanes, longest = [], 0, len(pairs[k][1]) + words
        group.append(k)
        lanes, steps = lanes + words, longest
    if group:
        yield group


class _Swept(NamedTuple):
    """What is left of a sweep: the words of each pair, the rises and falls of its last column, and if held, for each step and
    word where cells are one more than their left one, and the rises."""

    words: list[slice]
    rises: np.ndarray
    falls: np.ndarray
    across: np.ndarray | None
    held: np.ndarray | None


def _rooms(steps: int, lanes: int) -> np.ndarray:
    global _room
    if len(_room) < 2 * steps * lanes:
        _room = np.zeros(0, _WORD)  # the old one goes first
        _room = np.empty(2 * steps * lanes, _WORD)
    return _room[: 2 * steps * lanes].reshape(2, steps, lanes)


def _sweep(pairs: list[tuple[str, str]], hold: bool) -> _Swept | None:
    """Moves the columns of pairs of texts, neither of them empty; None if they have too many different characters."""
    counts = np.array([-(-len(a) // 64) for a, _ in pairs])
    starts = np.cumsum(counts) - counts
    lanes, longest = int(counts.sum()), max(len(b) for _, b in pairs)
    down = [_points(a) for a, _ in pairs]
    letters, code = np.unique(np.concatenate(down), return_inverse=True)
    if (len(letters) + 1) * lanes > PLACES:
        return None
    # row 0 is for characters that no first text has
    places = np.zeros((len(letters) + 1, lanes), _WORD)
    at = np.concatenate([np.arange(len(a)) + 64 * start for a, start in zip(down, starts.tolist())])
    np.add.at(places, (code.reshape(-1) + 1, at >> 6), np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)))
    places = places.reshape(-1)
    steps = int(max(len(b) + n for (_, b), n in zip(pairs, counts.tolist()))) - 1
    entering = np.zeros((steps, len(pairs)), np.int64)
    for k, (_, b) in enumerate(pairs):
        points = _points(b)
        near = np.minimum(np.searchsorted(letters, points), len(letters) - 1)
        entering[: len(b), k] = np.where(letters[near] == points, near + 1, 0) * lanes
    # a word is done with its pair's last character as many steps later as there are words above it
    ends = np.repeat([len(b) - 1 for _, b in pairs], counts) + np.arange(lanes) - np.repeat(starts, counts)
    done = np.argsort(ends, kind="stable")
    upto = np.searchsorted(ends[done], np.arange(-1, steps), side="right").tolist()
    new = lambda: np.zeros(lanes, _WORD)
    last_rises, last_falls = new(), new()
    across, held = _rooms(steps, lanes) if hold else (None, None)
    rises, falls, same, diagonal, either, right, down_, up, below, rises_in, falls_in = ~new(), *(new() for _ in range(10))
    entering += starts
    place, before = np.arange(lanes), np.arange(lanes)
    one, top = np.uint64(1), np.uint64(63)
    above, later, later_rises, later_falls = slice(None, -1), slice(1, None), rises_in[1:], falls_in[1:]
    for step in range(steps):
        # a word takes the character that the one above had; the same character's next word is the next place
        place, before = before, place
        np.add(before[above], 1, out=place[later])
        place[starts] = entering[step]
        rises_in[starts], falls_in[starts] = 1, 0
        places.take(place, out=same, mode="clip")
        np.bitwise_or(same, falls, out=either)
        np.bitwise_or(same, falls_in, out=same)
        np.bitwise_and(same, rises, out=diagonal)
        np.add(diagonal, rises, out=diagonal)
        np.bitwise_xor(diagonal, rises, out=diagonal)
        np.bitwise_or(diagonal, same, out=diagonal)
        if hold:
            right = across[step]
        np.bitwise_or(diagonal, rises, out=right)
        np.invert(right, out=right)
        np.bitwise_or(right, falls, out=right)
        np.bitwise_and(diagonal, rises, out=down_)
        np.left_shift(right, one, out=up)
        np.bitwise_or(up, rises_in, out=up)
        np.left_shift(down_, one, out=below)
        np.bitwise_or(below, falls_in, out=below)
        # what leaves a word at its end enters the next one a step later
        np.right_shift(right[above], top, out=later_rises)
        np.right_shift(down_[above], top, out=later_falls)
        if hold:
            rises = held[step]
        np.bitwise_or(either, up, out=rises)
        np.invert(rises, out=rises)
        np.bitwise_or(rises, below, out=rises)
        np.bitwise_and(up, either, out=falls)
        if upto[step] < upto[step + 1]:
            now = done[upto[step] : upto[step + 1]]
            last_rises[now], last_falls[now] = rises[now], falls[now]
    return _Swept([slice(s, s + n) for s, n in zip(starts.tolist(), counts.tolist())], last_rises, last_falls, across, held)


def _bits(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(np.int64)


def _all_distances(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """`_distances` of many pairs, neither text of any empty."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pairs)
    for group in _grouped(pairs, False):
        swept = _sweep([pairs[k] for k in group], False) if len(group) > 1 else None
        for n, k in enumerate(group):
            a, b = pairs[k]
            if swept is None:
                out[k] = _distances(a, b)
            else:
                change = _bits(swept.rises[swept.words[n]], len(a)) - _bits(swept.falls[swept.words[n]], len(a))
                out[k] = np.concatenate([[len(b)], len(b) + np.cumsum(change)])
    return out


def distances(pairs: list[tuple[str, str]]) -> list[int]:
    """`distance` of many pairs."""
    bare = [_bare(a, b) for a, b in pairs]
    out = [len(a) + len(b) for a, b in bare]
    # fewer steps if the column is that of the longer one
    todo = [(k, *((a, b) if len(a) >= len(b) else (b, a))) for k, (a, b) in enumerate(bare) if a and b]
    for (k, _, _), found in zip(todo, _all_distances([(a, b) for _, a, b in todo])):
        out[k] = int(found[-1])
    return out


def _walk(a: str, b: str, across: memoryview, rises: memoryview, width: int, start: int, turned: bool) -> Edits:
    """Edits of what `_walked` finds, through the columns of `a`, from byte `start` of `width` that a step holds; turned, those of `b` to `a`."""
    first, second = (rises, across) if turned else (across, rises)
    i, j = len(a) - 1, len(b) - 1
    replaced = left = above = 0
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            i -= 1
            j -= 1
            continue
        at, bit = (j + (i >> 6)) * width + start + (i >> 3), 1 << (i & 7)
        if first[at] & bit:
            if turned:
                above += 1
                i -= 1
            else:
                left += 1
                j -= 1
        elif second[at] & bit:
            if turned:
                left += 1
                j -= 1
            else:
                above += 1
                i -= 1
        else:
            replaced += 1
            i -= 1
            j -= 1
    left, above = left + j + 1, above + i + 1
    return Edits(replaced, above, left) if turned else Edits(replaced, left, above)


def _all_walked(pairs: list[tuple[str, str]]) -> tuple[list[int], list[Edits]]:
    """Distance by the last column and `_walked` of many pairs, neither text of any empty and whose columns take HELD bits at most each."""
    far, out = [0] * len(pairs), [Edits()] * len(pairs)
    turned = [len(a) < len(b) for a, b in pairs]  # fewer steps if the column is that of the longer one
    swapped = [(b, a) if t else (a, b) for (a, b), t in zip(pairs, turned)]
    for group in _grouped(swapped, True):
        swept = _sweep([swapped[k] for k in group], True) if len(group) > 1 else None
        if swept is None:
            for k in group:
                far[k], out[k] = distance(*pairs[k]), _walked(*pairs[k])
            continue
        across, held = (memoryview(x).cast("B") for x in (swept.across, swept.held))
        for k, words in zip(group, swept.words):
            a, b = swapped[k]
            far[k] = len(b) + int(_bits(swept.rises[words], len(a)).sum() - _bits(swept.falls[words], len(a)).sum())
            out[k] = _walk(a, b, across, held, swept.across.shape[1] * 8, words.start * 8, turned[k])
    return far, out


def measured(pairs: list[tuple[str, str]]) -> tuple[list[int], list[Edits]]:
    """`distance` and `edits` of many pairs, from the same columns."""
    far: list[int | None] = [None] * len(pairs)
    out, todo = [Edits()] * len(pairs), [(k, a, b) for k, (a, b) in enumerate(pairs)]
    while todo:
        held, cut = [], []
        for k, a, b in todo:
            a, b = _bare(a, b)
            if min(len(a), len(b)) < 2:
                out[k] += edits(a, b)
                far[k] = distance(a, b) if far[k] is None else far[k]
            else:
                (held if 3 * len(a) * len(b) <= HELD else cut).append((k, a, b))
        for (k, _, _), d, found in zip(held, *_all_walked([(a, b) for _, a, b in held])):
            out[k] += found
            far[k] = d if far[k] is None else far[k]
        halves = [x for _, a, b in cut for x in ((a, b[: len(b) // 2]), (a[::-1], b[len(b) // 2 :][::-1]))]
        columns = _all_distances(halves)
        todo = []
        for n, (k, a, b) in enumerate(cut):
            both = columns[2 * n] + columns[2 * n + 1][::-1]
            at = int(np.argmin(both))
            far[k] = int(both[at]) if far[k] is None else far[k]  # a pair's first cut tells its distance
            todo += [(k, a[:at], b[: len(b) // 2]), (k, a[at:], b[len(b) // 2 :])]
    return far, out


def _known(x: pa.Array, y: pa.Array) -> tuple[list[int], list[tuple[str, str]]]:
    """Rows without null, and their texts."""
    rows = [(k, (p, q)) for k, (p, q) in enumerate(zip(x.to_pylist(), y.to_pylist())) if p is not None and q is not None]
    return [k for k, _ in rows], [pair for _, pair in rows]


def long_distance(a: Column, b: Column) -> Column:
    """Edit distance of two columns of texts of any length."""

    @F.arrow_udf("bigint")
    def measured(x: pa.Array, y: pa.Array) -> pa.Array:
        rows, pairs = _known(x, y)
        found = dict(zip(rows, distances(pairs)))
        return pa.array([found.get(k) for k in range(len(x))], pa.int64())

    return measured(a, b)


def _counts(x: pa.Array, y: pa.Array, names: tuple[str, ...]) -> pa.Array:
    rows, pairs = _known(x, y)
    found = {k: {"distance": d} | e._asdict() for k, d, e in zip(rows, *measured(pairs))}
    return pa.array([found.get(k) for k in range(len(x))], pa.struct([(k, pa.int64()) for k in names]))


def edit_counts(a: Column, b: Column) -> Column:
    """struct<replaced, added, removed> of what makes b of a."""

    @F.arrow_udf("struct<replaced:bigint,added:bigint,removed:bigint>")
    def counted(x: pa.Array, y: pa.Array) -> pa.Array:
        return _counts(x, y, Edits._fields)

    return counted(a, b)


def distance_and_edits(a: Column, b: Column) -> Column:
    """struct<distance, replaced, added, removed>: what `long_distance` and `edit_counts` give, from the same columns."""

    @F.arrow_udf("struct<distance:bigint,replaced:bigint,added:bigint,removed:bigint>")
    def both(x: pa.Array, y: pa.Array) -> pa.Array:
        return _counts(x, y, ("distance", *Edits._fields))

    return both(a, b)
