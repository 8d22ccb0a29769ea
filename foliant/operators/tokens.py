"""Tokens: vocabulary lookups, byte-pair merges, repeats, placeholders, position ids, byte features."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfc
from .bytepair import PATTERN, merge

BEGIN, END, PAD, READ, LEAST_BYTES = 1024, 1024, 256, 4096, 8
_SPACES = b" \t\n\x0b\x0c\r"


def pieces(c: Column) -> Column:
    """The pieces of an NFC text that are encoded on their own."""
    return F.regexp_extract_all(nfc(c), F.lit(PATTERN), 0)


def specials_first(vocabulary: DataFrame) -> DataFrame:
    """Special tokens, longest first, ties by id."""
    return vocabulary.orderBy(F.desc(F.length("token")), "id")


def ids_of(tokens: DataFrame, vocabulary: DataFrame, unknown: int | None = None) -> DataFrame:
    """Rows (doc, pos, token) with their id; tokens outside the vocabulary get `unknown` or, without one, go."""
    out = tokens.join(vocabulary.select("token", "id"), "token", "left")
    return out.where(F.col("id").isNotNull()) if unknown is None else out.withColumn("id", F.coalesce("id", F.lit(unknown)))


def bpe(c: Column, ranks: dict[tuple[str, str], int]) -> Column:
    """The merged symbols of a token."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def merged(tokens: pa.Array) -> pa.Array:
        values = tokens.dictionary_encode()
        known = pa.array([None if t is None else merge(list(t), ranks) for t in values.dictionary.to_pylist()], pa.list_(pa.string()))
        return known.take(values.indices)

    return merged(c)


def banned_tokens(history: Column, n: int) -> Column:
    """Tokens that followed earlier copies of the last n - 1 tokens, in order, repeats kept."""
    if n <= 0:
        return F.array().cast("array<int>")
    size = F.size(history)
    last = F.slice(history, F.greatest(size - n + 2, F.lit(1)), n - 1) if n > 1 else F.array().cast("array<int>")
    starts = F.filter(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: (size >= n) & (F.slice(history, i, F.lit(n - 1)) == last) if n > 1 else size >= n)
    return F.transform(starts, lambda i: F.get(history, i + n - 2))


def expand_pads(ids: Column, pad: int, n: int) -> Column:
    """The first placeholder as n copies."""
    at = F.array_position(ids, pad).cast("int")
    return F.when(at == 0, ids).otherwise(F.concat(F.slice(ids, F.lit(1), at - 1), F.array_repeat(F.lit(pad), n), F.slice(ids, at + 1, F.size(ids))))


def chat_prompt(text: Column, system: str = "You are a helpful assistant.") -> Column:
    """A prompt with an image placeholder."""
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n<|vision_start|><|image_pad|><|vision_end|>"), text, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def rope_index(ids: Column, grid_t: int, grid_h: int, grid_w: int, merge: int, image_token: int, vision_start: int) -> Column:
    """Positions on three axes: text counts on all of them; the image's tokens take the grid's coordinates behind
    the text before it; text after it goes on from the largest position."""
    h, w = grid_h // merge, grid_w // merge
    cells = grid_t * h * w
    start = F.filter(F.sequence(F.lit(1), F.size(ids)), lambda i: (F.get(ids, i - 1) == vision_start) & (F.get(ids, i) == image_token))
    before = F.coalesce(F.try_element_at(start, F.lit(1)), F.size(ids)).cast("int")
    top = before + max(grid_t, h, w)

    def place(i: Column) -> Column:
        k = i - before
        image = (k >= 0) & (k < cells) & (before < F.size(ids))
        text = F.when(i < before, i).otherwise(top + k - cells)
        return F.struct(
            F.when(image, before + F.floor(k / (h * w))).otherwise(text).cast("int").alias("t"),
            F.when(image, before + F.floor(k / w) % h).otherwise(text).cast("int").alias("h"),
            F.when(image, before + k % w).otherwise(text).cast("int").alias("w"),
        )

    return F.transform(F.sequence(F.lit(0), F.size(ids) - 1), place)


def features(content: bytes) -> list[int] | None:
    """Bytes of both ends without outer white space, padded; None if there are too few for a model."""
    if len(content) < LEAST_BYTES:
        return None
    head, tail = content[:READ].lstrip(_SPACES)[:BEGIN], content[-READ:].rstrip(_SPACES)[-END:]
    out = [*head, *[PAD] * (BEGIN - len(head)), *[PAD] * (END - len(tail)), *tail]
    return None if out[LEAST_BYTES - 1] == PAD else out


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def byte_features(contents: pa.Array) -> pa.Array:
    return pa.array([None if b is None else features(b) for b in contents.to_pylist()], pa.list_(pa.int32()))


def python_pieces(text: str) -> list[str]:
    """The same pieces in plain Python."""
    return regex.findall(PATTERN, unicodedata.normalize("NFC", text))
