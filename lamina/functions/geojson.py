"""GeoJSON in and out: geometries as parts, rings and vertices; feature collections as rows."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import InvalidGeometry, UnsupportedGeometry
from lamina.functions.canon import Lexeme, float_text, loads, quoted, write
from lamina.schemas import GEOMETRY_TYPES

Position = tuple[float, ...]
_NUMBERS = frozenset({float, int, Lexeme})


def _no_constant(name: str) -> Any:
    raise ValueError(f"{name} is not JSON")


#: For geometries numbers are doubles, so the decoder makes them.
_DECODER = json.JSONDecoder(parse_int=float, parse_constant=_no_constant)
_ENCODER = json.JSONEncoder(separators=(",", ":"))
#: Arrays around a position, by type.
LEVELS = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}


@dataclass(frozen=True)
class Shape:
    """A geometry as parts of open rings; a point or line is a part with one ring."""

    type: str
    dims: int
    parts: list[list[list[Position]]]


def part_type(kind: str) -> str:
    """The type of the parts of a geometry type."""
    return kind.removeprefix("Multi")


def no_geometry(text: str | None) -> bool:
    """Whether a raw geometry says that there is none: null, empty or JSON null."""
    return not text or text.strip(" \t\r\n") == "null"


def _list(value: Any, what: str) -> list:
    if value is None:
        return []
    if not isinstance(value, list):
        raise InvalidGeometry(f"{what} must be an array")
    return value


def position(value: Any) -> Position:
    """Two or three finite numbers."""
    values = _list(value, "a position")
    if len(values) not in (2, 3):
        raise InvalidGeometry("a position has exactly 2 or 3 values")
    if not _NUMBERS.issuperset(map(type, values)):
        raise InvalidGeometry("position values must be numbers")
    out = tuple(map(float, values))
    if not all(map(math.isfinite, out)):
        raise InvalidGeometry("position values must be finite")
    return out


def line(value: Any) -> list[Position]:
    """Positions of an array; checked all at once, and one by one only where something is odd."""
    values = _list(value, "coordinates")
    try:
        flat = list(chain.from_iterable(values))
        kinds = set(map(type, flat))
        if {2, 3}.issuperset(map(len, values)) and kinds <= _NUMBERS and {list}.issuperset(map(type, values)):
            out = list(map(tuple, values)) if kinds <= {float} else [tuple(map(float, p)) for p in values]
            if math.isfinite(sum(flat) if kinds <= {float} else sum(map(sum, out))):
                return out
    except TypeError:
        pass
    return [position(p) for p in values]


def open_ring(ring: list[Position]) -> list[Position]:
    """Without the closing position, if it repeats the first in all values."""
    return ring[:-1] if len(ring) >= 2 and ring[0] == ring[-1] else ring


def distinct_xy(ring: list[Position]) -> int:
    """Number of different planar positions."""
    return len({(p[0] + 0.0, p[1] + 0.0) for p in ring})


def has_area(ring: list[Position]) -> bool:
    """Whether there are three different planar positions; looks no further."""
    seen = set()
    for p in ring:
        seen.add((p[0] + 0.0, p[1] + 0.0))
        if len(seen) > 2:
            return True
    return False


def polygon(value: Any) -> list[list[Position]]:
    """Open rings of polygon coordinates, each with three distinct positions or more."""
    rings = [open_ring(line(r)) for r in _list(value, "polygon coordinates")]
    if not rings:
        raise InvalidGeometry("a polygon has at least one ring")
    if not all(map(has_area, rings)):
        raise InvalidGeometry("a polygon ring has at least 3 distinct positions")
    return rings


def shape_of(value: Any) -> Shape:
    """The shape of a parsed GeoJSON geometry object."""
    if not isinstance(value, dict):
        raise InvalidGeometry("a geometry must be an object")
    kind, raw = value.get("type"), value.get("coordinates")
    if kind not in GEOMETRY_TYPES or isinstance(kind, Lexeme):
        raise UnsupportedGeometry(f"geometry type {kind!r}")
    if kind == "Point":
        parts = [[[position(raw)]]]
    elif kind == "LineString":
        parts = [[line(raw)]]
    elif kind == "Polygon":
        parts = [polygon(raw)]
    elif kind == "MultiPoint":
        parts = [[[p]] for p in line(raw)]
    elif kind == "MultiLineString":
        parts = [[line(v)] for v in _list(raw, "coordinates")]
    else:
        parts = [polygon(v) for v in _list(raw, "coordinates")]
    if part_type(kind) == "LineString" and any(len(p[0]) < 2 for p in parts):
        raise InvalidGeometry("a line has at least 2 positions")
    dims = set(map(len, chain.from_iterable(chain.from_iterable(parts))))
    if len(dims) > 1:
        raise InvalidGeometry("XY and XYZ positions are mixed")
    return Shape(kind, dims.pop() if dims else 2, parts)


def parse(text: str) -> Shape:
    """Shape of a GeoJSON geometry text; raises InvalidGeometry or UnsupportedGeometry."""
    try:
        value = _DECODER.decode(text)
    except (ValueError, OverflowError) as e:
        raise InvalidGeometry(str(e)) from None
    except RecursionError:  # some foreign member is nested deeply
        try:
            value = loads(text)
        except ValueError as e:
            raise InvalidGeometry(str(e)) from None
    return shape_of(value)


def coordinates_text(value: Any) -> str:
    """Nested lists of positions as JSON; values are floats. Where no value needs an exponent the encoder writes all at once."""
    text = _ENCODER.encode(value)
    if "e" not in text and "N" not in text and "I" not in text:
        return text.replace(".0,", ",").replace(".0]", "]") if text[0] == "[" else float_text(value)
    return _coordinates_text(value)


def _coordinates_text(value: Any) -> str:
    if isinstance(value, float):
        return float_text(value)
    if value and isinstance(value[0], float):
        return "[" + ",".join(map(float_text, value)) + "]"
    return "[" + ",".join([_coordinates_text(v) for v in value]) + "]"


def export(shape: Shape) -> str:
    """GeoJSON text of a shape; rings are closed with their first position."""
    kind, parts = shape.type, shape.parts
    if part_type(kind) == "Polygon":
        members: list[Any] = [[[*ring, ring[0]] if ring else [] for ring in part] for part in parts]
    elif part_type(kind) == "LineString":
        members = [part[0] for part in parts]
    else:
        members = [part[0][0] for part in parts]
    return f'{{"type":"{kind}","coordinates":{coordinates_text(members if kind.startswith("Multi") else members[0])}}}'


def reexport(text: str | None) -> str | None:
    """A geometry as the engine would export it; the text itself, canonical, if it can't be parsed; None for none."""
    if no_geometry(text):
        return None
    try:
        return export(parse(text))
    except (InvalidGeometry, UnsupportedGeometry):
        try:
            return write(loads(text))
        except ValueError:
            return text


VERTICES = T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("coord", T.ArrayType(T.DoubleType()))]))
SHAPE = T.StructType([T.StructField("error", T.StringType()), T.StructField("type", T.StringType()), T.StructField("dims", T.IntegerType()), T.StructField("vertices", VERTICES)])
_ARROW_VERTICES = pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("pos", pa.int32()), ("coord", pa.list_(pa.float64()))]))
_ARROW_SHAPE = pa.struct([("error", pa.string()), ("type", pa.string()), ("dims", pa.int32()), ("vertices", _ARROW_VERTICES)])


@F.arrow_udf(SHAPE)
def shape(texts: pa.Array) -> pa.Array:
    """Parsed geometry as a struct: error (null if good), type, dims, vertices. Null for no geometry."""
    out = []
    for text in texts.to_pylist():
        if no_geometry(text):
            out.append(None)
            continue
        try:
            s = parse(text)
        except (InvalidGeometry, UnsupportedGeometry) as e:
            out.append({"error": str(e), "type": None, "dims": None, "vertices": None})
            continue
        vertices = [{"part": i, "ring": r, "pos": k, "coord": list(p)} for i, part in enumerate(s.parts) for r, ring in enumerate(part) for k, p in enumerate(ring)]
        out.append({"error": None, "type": s.type, "dims": s.dims, "vertices": vertices})
    return pa.array(out, _ARROW_SHAPE)


@F.arrow_udf(T.StringType())
def geometry_error(texts: pa.Array) -> pa.Array:
    """Why a geometry can't be used; null if it can or if there is none."""
    out = []
    for text in texts.to_pylist():
        try:
            out.append(None if no_geometry(text) or parse(text) else None)
        except (InvalidGeometry, UnsupportedGeometry) as e:
            out.append(str(e))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def geometry_text(kinds: pa.Array, parts: pa.Array) -> pa.Array:
    """GeoJSON text of (type, parts), parts as ARRAY<ARRAY<ARRAY<ARRAY<DOUBLE>>>> of open rings; null for null."""
    out = []
    for kind, nested in zip(kinds.to_pylist(), parts.to_pylist(), strict=True):
        out.append(None if kind is None or nested is None else export(Shape(kind, 0, nested)))
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def normal_geometry(texts: pa.Array) -> pa.Array:
    """reexport() of each text."""
    return pa.array([reexport(t) for t in texts.to_pylist()], pa.string())


def feature_id(raw: Any, index: int) -> str:
    """A feature's id: a text that isn't blank, a number as it was spelled, or from the index if there is none."""
    if raw is None:
        return f"feature:{index}"
    if isinstance(raw, Lexeme):
        return str(raw)
    if isinstance(raw, str):
        if not raw.strip():
            raise InvalidGeometry("a feature id can't be empty")
        return raw
    raise InvalidGeometry("a feature id is a string or a number")


def features_of(text: str) -> list[tuple[str, str | None, dict[str, str]]]:
    """(id, geometry, raw properties) of a FeatureCollection text; foreign members are dropped."""
    try:
        value = loads(text)
    except ValueError as e:
        raise InvalidGeometry(str(e)) from None
    if not isinstance(value, dict) or value.get("type") != "FeatureCollection":
        raise InvalidGeometry("a FeatureCollection is expected")
    out, seen = [], set()
    for i, feature in enumerate(_list(value.get("features"), "features")):
        if not isinstance(feature, dict) or feature.get("type") != "Feature":
            raise InvalidGeometry(f"feature {i} isn't a Feature")
        own = feature_id(feature.get("id"), i)
        if own in seen:
            raise InvalidGeometry(f"feature id {own!r} is there twice")
        seen.add(own)
        geometry, properties = feature.get("geometry"), feature.get("properties")
        if properties is not None and not isinstance(properties, dict):
            raise InvalidGeometry(f"properties of feature {i} aren't an object")
        text = None if geometry is None else write(geometry)
        if text is not None:
            parse(text)
        out.append((own, text, {k: write(v) for k, v in (properties or {}).items()}))
    return out


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection files as base features; document_id is the file's name without its ending.

    A file is one document. A broken file fails the read with the reason.
    """

    def rows(batches):
        for batch in batches:
            names, ids, shapes, props = [], [], [], []
            for name, text in zip(batch.column("document_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                for own, geometry, properties in features_of(text):
                    names.append(name)
                    ids.append(own)
                    shapes.append(geometry)
                    props.append(list(properties.items()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(ids, pa.string()), pa.array(shapes, pa.string()), pa.array(props, pa.map_(pa.string(), pa.string()))],
                ["document_id", "feature_id", "geometry", "properties"],
            )

    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.(geo)?json$", "")
    text = spark.read.text(path, wholetext=True).select(name.alias("document_id"), "value")
    return text.mapInArrow(rows, "document_id string, feature_id string, geometry string, properties map<string,string>")


def feature_text(own: str, geometry: str | None, properties: dict[str, str]) -> str:
    """One Feature as GeoJSON: type, id, geometry, properties; members of properties by name."""
    members = ",".join(f"{quoted(k)}:{write(loads(v))}" for k, v in sorted(properties.items(), key=lambda kv: kv[0].encode()))
    return f'{{"type":"Feature","id":{quoted(own)},"geometry":{geometry or "null"},"properties":{{{members}}}}}'


@F.arrow_udf(T.StringType())
def feature_json(ids: pa.Array, geometries: pa.Array, properties: pa.Array) -> pa.Array:
    """feature_text() of rows; null properties are none."""
    rows = zip(ids.to_pylist(), geometries.to_pylist(), properties.to_pylist(), strict=True)
    return pa.array([feature_text(i, g, dict(p or ())) for i, g, p in rows], pa.string())


def collection_text(features: list[str]) -> str:
    """A FeatureCollection of feature texts, which come in id order."""
    return f'{{"type":"FeatureCollection","features":[{",".join(features)}]}}'
