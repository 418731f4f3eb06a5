"""JSON as data: canonical text that keeps number spellings, float text, bit hashes.

Spark's JSON functions rewrite numbers (1.50 becomes 1.5), so anything that
compares or exports raw values goes through these Arrow-batched functions.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import struct
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Lexeme(str):
    """A number as it was spelled."""

    __slots__ = ()


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_int=Lexeme, parse_float=Lexeme, parse_constant=_no_constant)
_ESCAPES = str.maketrans({"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", " ": "\\u2028", " ": "\\u2029"})
_quote = json.encoder.encode_basestring


#: One piece of JSON text: a mark, a string, a number or a word.
_PIECE = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


def loads(text: str) -> Any:
    """Parse JSON, however deeply it is nested; numbers come back as Lexeme. Raises ValueError."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        return deep_loads(text)


def deep_loads(text: str) -> Any:
    """loads() with a stack of its own: slower, for texts that are nested too deeply for the decoder."""
    root: list[Any] = []
    holder: Any = root
    stack: list[Any] = []
    at, want, key = 0, "value", ""
    while (m := _PIECE.match(text, at)) is not None:
        mark, string, number, word = m.groups()
        at = m.end()
        if mark and (mark == "]" and want == "first" or mark == "}" and want == "first key" or want == "next" and mark == ("]" if isinstance(holder, list) else "}") and stack):
            holder, want = stack.pop(), "next"
        elif want in ("value", "first"):
            value = [] if mark == "[" else {} if mark == "{" else json.loads(string) if string else Lexeme(number) if number else _WORDS.get(word, mark)
            if isinstance(value, str) and mark:
                raise ValueError(f"a value is expected at {m.start()}")
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[key] = value
            want = "next"
            if mark:
                stack.append(holder)
                holder, want = value, "first" if mark == "[" else "first key"
        elif want in ("key", "first key") and string:
            key, want = json.loads(string), "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "next" and mark == "," and stack:
            want = "value" if isinstance(holder, list) else "key"
        else:
            raise ValueError(f"unexpected text at {m.start()}")
    if stack or want != "next" or text[at:].strip(" \t\n\r"):
        raise ValueError(f"unexpected text at {at}")
    return root[0]


def quoted(text: str) -> str:
    """A JSON string literal in the wire's escaping."""
    return _quote(text).translate(_ESCAPES)


def write(value: Any) -> str:
    """Canonical text of a parsed value: sorted members, no spaces, number lexemes kept."""
    try:
        return _write(value)
    except RecursionError:
        return _deep_write(value)


def _members(value: dict) -> list[str]:
    return sorted(value, key=lambda k: k.encode("utf-8", "surrogatepass"))


def _deep_write(value: Any) -> str:
    """write() with a stack of its own; texts on the stack are written as they are."""
    out: list[str] = []
    todo: list[tuple[bool, Any]] = [(False, value)]
    while todo:
        ready, v = todo.pop()
        if ready:
            out.append(v)
        elif isinstance(v, list) and v:
            parts: list[tuple[bool, Any]] = [(True, "[")]
            for i, x in enumerate(v):
                parts += [(True, ","), (False, x)] if i else [(False, x)]
            todo += [(True, "]"), *reversed(parts)]
        elif isinstance(v, dict) and v:
            parts = []
            for i, k in enumerate(_members(v)):
                parts += [(True, f"{',' if i else '{'}{quoted(k)}:"), (False, v[k])]
            todo += [(True, "}"), *reversed(parts)]
        else:
            out.append(_write(v))
    return "".join(out)


def _write(value: Any) -> str:
    if isinstance(value, Lexeme):
        return str(value)
    if value is None:
        return "null"
    if value is True:
        return "true"
    if value is False:
        return "false"
    if isinstance(value, str):
        return quoted(value)
    if isinstance(value, float):
        return float_text(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join([_write(x) for x in value]) + "]"
    return "{" + ",".join([f"{quoted(k)}:{_write(value[k])}" for k in _members(value)]) + "}"


def canonical(text: str | None) -> str | None:
    """Canonical form of a JSON text; null and the empty text give null, broken text raises ValueError."""
    if not text:
        return None
    return write(loads(text))


def canonical_or_raw(text: str | None) -> str | None:
    """Canonical form, or the text itself, marked, where it isn't JSON."""
    try:
        return canonical(text)
    except ValueError:
        return "!" + text


def float_text(x: float) -> str:
    """Shortest text of a double: plain between 1e-6 and 1e21, else with an exponent; -0 keeps its sign."""
    digits = repr(x)
    if "e" not in digits and "n" not in digits:  # within 1e-4 and 1e16, where both write plain figures
        return digits[:-2] if digits.endswith(".0") else digits
    if x != x or math.isinf(x):
        raise ValueError("not a finite number")
    mantissa, _, exponent = digits.partition("e")
    sign = "-" if mantissa[0] == "-" else ""
    whole, _, fraction = mantissa.lstrip("-").partition(".")
    if fraction == "0":
        fraction = ""
    power = int(exponent or 0) + len(whole)
    figures = (whole + fraction).lstrip("0")
    power -= len(whole + fraction) - len(figures)
    figures = figures.rstrip("0") or "0"
    if 1e-6 <= abs(x) < 1e21:
        if power <= 0:
            return f"{sign}0.{'0' * -power}{figures}"
        if len(figures) <= power:
            return sign + figures + "0" * (power - len(figures))
        return f"{sign}{figures[:power]}.{figures[power:]}"
    e = power - 1
    tail = "." + figures[1:] if len(figures) > 1 else ""
    return f"{sign}{figures[0]}{tail}e{'-' if e < 0 else '+'}{abs(e)}"


def bits(values: Any) -> bytes:
    """The bit patterns of doubles, so that -0, 0 and each NaN stay different."""
    values = [float("nan") if v is None else v for v in values]
    return struct.pack(f">{len(values)}d", *values)


def _piece(value: str | bytes | None) -> bytes:
    """One field of a payload, framed by its length; null differs from the empty text."""
    if value is None:
        return b"-"
    if isinstance(value, str):
        value = value.encode("utf-8", "surrogatepass")
    return b"%d:" % len(value) + value


def payload_digest(op: dict[str, Any]) -> bytes:
    """Digest of one operation as data.

    Spacing, escapes and member order of JSON texts, the order of properties and
    whether a creating edit spells out the id it creates make no difference; an
    absent and an empty property map are both no properties. Everything else does,
    number spellings and the bits of coordinates included.
    """
    gen, edit = op.get("gen"), op.get("geometry_op")
    out = [_piece(op.get(k)) for k in ("type", "site_id", "feature_id", "property_key")]
    out += [f"{op.get('seq')},{op.get('ts')}".encode(), _piece(canonical_or_raw(op.get("geometry")))]
    properties = op.get("properties") or {}
    for key, value in sorted(properties.items() if isinstance(properties, dict) else properties):
        out += [_piece(key), _piece(canonical_or_raw(value))]
    out += [b"|", _piece(canonical_or_raw(op.get("property_value")))]
    out.append(b"-" if gen is None else _piece(gen["site_id"]) + b"%d" % (-1 if gen["seq"] is None else gen["seq"]))
    if edit is None:
        out.append(b"-")
    else:
        made = CREATED.get(edit["action"])
        for field in ("action", "part_id", "ring_id", "vertex_id", "after_vertex_id"):
            value = edit[field]
            if made and field == made[0] and not value:
                value = f"{made[1]}:{op.get('site_id')}:{op.get('seq')}"
            out.append(_piece(value))
        coord, ring = edit["coord"], edit["ring"]
        out.append(b"-" if coord is None else _piece(bits(coord)))
        out.append(b"-" if ring is None else b"%d" % len(ring) + b"".join(b"-" if p is None else _piece(bits(p)) for p in ring))
        out.append(_piece(canonical_or_raw(edit["part"])))
    return hashlib.sha256(b"\x00".join(out)).digest()


#: The action that creates an element: the field that names it and the prefix of its derived id.
CREATED = {"insert_vertex": ("vertex_id", "op"), "add_ring": ("ring_id", "ring"), "add_part": ("part_id", "part")}


@F.arrow_udf(T.BinaryType())
def op_digest(ops: pa.Array) -> pa.Array:
    """payload_digest over a struct column with the op fields."""
    return pa.array([payload_digest(r) for r in ops.to_pylist()], pa.binary())


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Canonical text; null for null, empty and broken JSON."""

    def one(text: str | None) -> str | None:
        try:
            return canonical(text)
        except ValueError:
            return None

    return texts.map(one, na_action="ignore").astype(object)


@F.pandas_udf(T.BooleanType())
def is_json(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON value; null gives null."""

    def one(text: str | None) -> bool | None:
        if text is None:
            return None
        try:
            loads(text)
        except ValueError:
            return False
        return True

    return pd.Series([one(t) for t in texts], dtype=object)


@F.pandas_udf(T.StringType())
def number_text(values: pd.Series) -> pd.Series:
    """float_text of a double column; null for null and for what isn't finite."""
    return pd.Series([float_text(v) if v is not None and math.isfinite(v) else None for v in values], dtype=object)


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def split_object(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Members of a JSON object as raw values in canonical text; null where it isn't an object."""
    for part in texts:
        out = []
        for text in part:
            try:
                value = loads(text) if text else None
            except ValueError:
                value = None
            out.append({k: write(v) for k, v in value.items()} if isinstance(value, dict) else None)
        yield pd.Series(out, dtype=object)


@F.arrow_udf(T.StringType())
def json_text(texts: pa.Array) -> pa.Array:
    """A text as a JSON string literal; null as JSON null."""
    return pa.array(["null" if t is None else quoted(t) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def object_text(maps: pa.Array) -> pa.Array:
    """A map of raw values as a canonical JSON object; JSON null for null and empty maps."""
    out = []
    for pairs in maps.to_pylist():
        members = ",".join(f"{quoted(k)}:{canonical_or_raw(v)}" for k, v in sorted(pairs or (), key=lambda kv: kv[0].encode()))
        out.append("{" + members + "}" if members else "null")
    return pa.array(out, pa.string())


def base_document_text(document_id: str, features: list[tuple[str, str | None, dict[str, str] | None]]) -> str:
    """The text whose SHA-256 names a base: features by id, geometry as exported, properties as canonical JSON."""
    from lamina.functions import geojson

    rows = []
    for feature_id, geometry, properties in sorted(features, key=lambda f: f[0].encode()):
        members = ",".join(f"{quoted(k)}:{canonical_or_raw(v)}" for k, v in sorted((properties or {}).items(), key=lambda kv: kv[0].encode()))
        rows.append(f'{{"id":{quoted(feature_id)},"geometry":{geojson.reexport(geometry) or "null"},"properties":{"{" + members + "}" if members else "null"}}}')
    return f'{{"document_id":{quoted(document_id)},"features":[{",".join(rows)}]}}'


def sha256_hex(column: Column) -> Column:
    """Hex SHA-256 of a text."""
    return F.sha2(column, 256)
