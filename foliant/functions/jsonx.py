"""Strict JSON and walks of any depth."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_DEPTH = 1024


class _Invalid(ValueError):
    pass


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _Invalid("duplicate key")
    return out


def _constant(name: str):
    raise _Invalid(name)


def depth_of(text: str) -> int:
    """Deepest nesting, by brackets outside of strings."""
    depth = most = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    return most


def check(text: str | None) -> str | None:
    """None for strict JSON, else why not."""
    if text is None:
        return "null"
    if depth_of(text) > MAX_DEPTH:
        return "nested too deeply"
    try:
        json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
        return None
    except RecursionError:
        return "nested too deeply"
    except (ValueError, _Invalid) as e:
        at = getattr(e, "pos", None)
        offset = "" if at is None else f" at byte {len(text[:at].encode())}"
        return f"{getattr(e, 'msg', str(e))}{offset}"


@F.arrow_udf(T.StringType())
def json_error(texts: pa.Array) -> pa.Array:
    """Why a text is no strict JSON; null if it is."""
    return pa.array([check(t) for t in texts.to_pylist()], pa.string())


def strict_variant(c: Column) -> Column:
    """The value of strict JSON, null for anything else; duplicate keys are refused and nesting is bounded by the JVM's parser,
    which passes over what follows a value. So the text must be a value both in a list and in an object: what closes the one
    early breaks the other."""
    listed, named = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}")))
    return F.when(listed.isNotNull() & named.isNotNull(), F.try_parse_json(c))


def is_json(c: Column) -> Column:
    """Strict JSON without leaving the JVM: `strict_variant` would have a value, be it a JSON null."""
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c, F.lit("}"))).isNotNull()


def _scores(value: object, keys: frozenset[str], out: list[float]) -> None:
    if isinstance(value, list):
        for v in value:
            _scores(v, keys, out)
    elif isinstance(value, dict):
        for k, v in value.items():
            if k in keys and isinstance(v, (int, float)) and not isinstance(v, bool):
                out.append(float(v))
            else:
                _scores(v, keys, out)


def collect_scores(c: Column, keys: tuple[str, ...] = ("score", "confidence")) -> Column:
    """All numbers under these keys at any depth; those outside [0, 1] are left out."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def collect(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            found: list[float] = []
            try:
                _scores(json.loads(t), frozenset(keys), found) if t else None
            except ValueError:
                pass
            out.append([x for x in found if 0 <= x <= 1])
        return pa.array(out, pa.list_(pa.float64()))

    return collect(c)


def _spelled(key: str) -> str:
    """A pattern of all that a key may be written as inside a JSON string."""
    short = {'"': '"', "\\": "\\\\", "/": "/", "\b": "b", "\f": "f", "\n": "n", "\r": "r", "\t": "t"}

    def sign(c: str) -> str:
        units = c.encode("utf-16-be").hex()
        coded = "".join("\\\\u" + "".join(f"[{h}{h.upper()}]" if h.isalpha() else h for h in units[k : k + 4]) for k in range(0, len(units), 4))
        own = [coded, *(["\\\\" + short[c]] if c in short else []), *([rf"\x{{{ord(c):x}}}"] if c >= " " and c not in '"\\' else [])]
        return f"(?:{'|'.join(own)})"

    return "".join(map(sign, key))


def walked_scores(rows: DataFrame, id: str, json: str, keys: tuple[str, ...] = ("score", "confidence")) -> DataFrame:
    """(id, score): a row for each number from 0 to 1 under these keys, at any depth, without leaving the JVM.

    A text is read once, whatever its depth: it is strict JSON, so outside of strings there is no quotation mark, and from the left
    each string is either a key with its number or passed over as a whole. Texts that are no strict JSON have no scores."""
    own = "|".join(map(_spelled, keys))
    pattern = rf'"(?:{own})"[ \t\r\n]*+:[ \t\r\n]*+(-?[0-9][-+.0-9eE]*+)|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    numbers = F.filter(F.regexp_extract_all(F.col(json), F.lit(pattern), 1), lambda n: n != "")
    # a negative zero is a zero
    scores = F.filter(F.transform(numbers, lambda n: n.try_cast("double") + F.lit(0.0)), lambda x: x.between(0, 1))
    # an inner explode would have the scores computed a second time, by a filter on their number
    return rows.where(is_json(F.col(json))).select(F.col(id).alias("id"), F.explode_outer(scores).alias("score")).where("score IS NOT NULL")
