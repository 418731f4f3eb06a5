"""Deltas and snapshots as JSON of the wire protocol, version 3."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import errors
from lamina.functions.canon import Lexeme, loads, quoted, write
from lamina.schemas import OPS_DDL, SNAPSHOT_DDL, WIRE_VERSION

#: Members of each wire type, in order: name, kind of value, whether an empty value is left out. Fixed by the protocol.
TYPES: dict[str, list[tuple[str, str, bool]]] = {
    "ref": [("site_id", "text", False), ("seq", "int", False)],
    "stamp": [("ts", "int", False), ("site_id", "text", False), ("seq", "int", False)],
    "edit": [
        ("action", "text", False), ("part_id", "text", True), ("ring_id", "text", True), ("vertex_id", "text", True), ("after_vertex_id", "text", True),
        ("coord", "numbers", True), ("ring", "numbers", True), ("part", "raw", True),
    ],
    "op": [
        ("type", "text", False), ("site_id", "text", False), ("seq", "int", False), ("ts", "int", False), ("feature_id", "text", False), ("geometry", "raw", True),
        ("properties", "map raw", True), ("property_key", "text", True), ("property_value", "raw", True), ("gen", "ref", True), ("geometry_op", "edit", True),
    ],
    "delta": [
        ("version", "int", False), ("document_id", "text", False), ("site_id", "text", False), ("base_hash", "text", False), ("clock", "int", False),
        ("vector_clock", "map int", False), ("compacted", "map int", True), ("ops", "list op", False),
    ],
    "key": [("init", "int", None), ("stamp", "stamp", True)],
    "vertex": [("id", "text", False), ("parent", "text", True), ("key", "key", False), ("coord", "numbers", False), ("deleted", "bool", True), ("move_reg", "stamp", True)],
    "ring": [("id", "text", False), ("key", "key", False), ("exterior", "bool", True), ("deleted", "bool", True), ("vertices", "list vertex", False)],
    "part": [("id", "text", False), ("key", "key", False), ("part_type", "text", False), ("deleted", "bool", True), ("rings", "list ring", False)],
    "geometry": [("type", "text", False), ("dims", "int", False), ("parts", "list part", False)],
    "property": [("value", "raw", True), ("deleted", "bool", True), ("reg", "stamp", True)],
    "feature": [
        ("id", "text", False), ("base", "bool", True), ("create_reg", "stamp", True), ("delete_reg", "stamp", True), ("gen_id", "ref", True), ("gen_stamp", "stamp", True),
        ("seen_gens", "list ref", True), ("properties", "map property", True), ("geometry", "geometry", True),
    ],
    "snapshot": [
        ("version", "int", False), ("id", "text", True), ("document_id", "text", False), ("site_id", "text", False), ("base_hash", "text", False), ("clock", "int", False),
        ("vector_clock", "map int", False), ("applied", "map int", True), ("synced_through", "int", True), ("outbox_ops", "list op", True), ("features", "list feature", False),
        ("retained_ops", "list op", True), ("pending_ops", "list op", True),
    ],
}


def _text(value: Any, kind: str) -> str:
    if kind in TYPES:
        out = []
        for name, inner, optional in TYPES[kind]:
            member = value.get(name)
            # None as rule: left out only where there is no value at all.
            if member is None and optional is not False or optional and not member:
                continue
            out.append(f"{quoted(name)}:{_text(member, inner)}")
        return "{" + ",".join(out) + "}"
    if kind.startswith("list "):
        return "[" + ",".join([_text(v, kind[5:]) for v in value or ()]) + "]"
    if kind.startswith("map "):
        return "{" + ",".join([f"{quoted(k)}:{_text(v, kind[4:])}" for k, v in sorted((value or {}).items(), key=lambda kv: kv[0].encode())]) + "}"
    if kind == "raw":
        return write(loads(value))
    if kind == "numbers":
        return write([list(map(float, v)) if isinstance(v, (list, tuple)) else float(v) for v in value or ()])
    if kind == "int":
        return str(value or 0)
    if kind == "bool":
        return "true" if value else "false"
    return quoted(value or "")


def dump(value: dict[str, Any], kind: str) -> str:
    """JSON text of a "delta" or a "snapshot"."""
    return _text(value, kind)


def _value(value: Any, kind: str, at: str) -> Any:
    if value is None:
        return None
    if kind in TYPES:
        if not isinstance(value, dict):
            raise errors.InvalidSyncState(f"{at} must be an object")
        return {name: _value(value.get(name), inner, f"{at}.{name}") for name, inner, _ in TYPES[kind]}
    try:
        if kind.startswith("list "):
            return [_value(v, kind[5:], at) for v in value if isinstance(value, list) or 1 / 0]
        if kind.startswith("map "):
            return {k: _value(v, kind[4:], at) for k, v in value.items()}
        if kind == "raw":
            return write(value)
        if kind == "numbers":
            return [[float(x) for x in v] if isinstance(v, list) else float(v) for v in value]
        if kind == "int":
            if not isinstance(value, Lexeme):
                raise ValueError
            return int(value)
        if kind == "bool" and isinstance(value, bool) or kind == "text" and isinstance(value, str) and not isinstance(value, Lexeme):
            return value
        raise ValueError
    except (ValueError, TypeError, AttributeError, ZeroDivisionError):
        raise errors.InvalidSyncState(f"{at} is malformed") from None


def load(text: str, kind: str) -> dict[str, Any]:
    """A "delta" or "snapshot" from JSON; raw members stay raw. Malformed texts raise InvalidSyncState."""
    try:
        value = loads(text)
    except ValueError as e:
        raise errors.InvalidSyncState(str(e)) from None
    out = _value(value, kind, kind)
    for name, inner, optional in TYPES[kind]:
        if out[name] is None and not optional:
            out[name] = [] if inner.startswith("list") else {} if inner.startswith("map") else 0 if inner == "int" else ""
        if out[name] is None and inner.startswith("map"):
            out[name] = {}
        if out[name] is None and inner == "int":
            out[name] = 0
    return out


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    """Operations of delta files (one JSON document each) as ops rows, each with its envelope's document."""

    def rows(batches):
        for batch in batches:
            ops = []
            for text in batch.column("value").to_pylist():
                delta = load(text, "delta")
                if delta["version"] != WIRE_VERSION:
                    raise errors.UnsupportedVersion(str(delta["version"]))
                ops += [op | {"document_id": delta["document_id"], "properties": list((op["properties"] or {}).items()) or None} for op in delta["ops"]]
            yield pa.RecordBatch.from_pylist(ops, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], OPS_DDL).schema
    schema = to_arrow_schema(kind)
    return spark.read.text(path, wholetext=True).mapInArrow(rows, kind)


def packed(value: Any, kind: T.DataType) -> Any:
    """Dictionaries of map columns as pairs, as Arrow takes them; members that a type doesn't have are dropped."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: packed(value.get(f.name), f.dataType) for f in kind}
    if isinstance(kind, T.MapType):
        return [(k, packed(v, kind.valueType)) for k, v in value.items()]
    if isinstance(kind, T.ArrayType):
        return [packed(v, kind.elementType) for v in value]
    return value


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files (one JSON document each) as rows of SNAPSHOT_DDL.

    A file is one value and so one row; files are read in parallel. Malformed files fail the read with the reason, and so
    do those of another version; whether a snapshot keeps the structural rules is judged by snapshots.judged.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = spark.createDataFrame([], SNAPSHOT_DDL).schema
    schema = to_arrow_schema(kind)

    def rows(batches):
        for batch in batches:
            for text in batch.column("value").to_pylist():
                value = load(text, "snapshot")
                if value["version"] != WIRE_VERSION:
                    raise errors.UnsupportedVersion(str(value["version"]))
                yield pa.RecordBatch.from_pylist([packed(value, kind)], schema=schema)

    return spark.read.text(path, wholetext=True).mapInArrow(rows, kind)


def delta_rows(op: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(document_id, delta): wire texts of deltas whose envelopes (one row per document) and ops are given as rows.

    A delta is one message and so one row; its operations come by (site, number).
    """
    inner = [c for c, *_ in TYPES["op"]]
    ops = op.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.struct("site_id", "seq").alias("order"), F.to_json(F.struct(*[F.col(c) for c in inner])).alias("op")))).alias("ops"))

    @F.arrow_udf(T.StringType())
    def text(heads: pa.Array, lists: pa.Array) -> pa.Array:
        out = []
        for head, ops in zip(heads.to_pylist(), lists.to_pylist(), strict=True):
            value = {k: dict(v) if isinstance(v, list) else v for k, v in head.items()}
            members = [_value(loads(o["op"]), "op", "op") for o in ops or ()]
            for m, o in zip(members, ops or (), strict=True):
                source = loads(o["op"])
                for name in ("geometry", "property_value"):
                    m[name] = source.get(name)
                m["properties"] = source.get("properties")
                if m["geometry_op"]:
                    m["geometry_op"]["part"] = source["geometry_op"].get("part")
            out.append(dump(value | {"ops": members}, "delta"))
        return pa.array(out, pa.string())

    head = F.struct("version", "document_id", "site_id", "base_hash", "clock", "vector_clock", "compacted")
    return envelopes.join(ops, "document_id", "left").select("document_id", text(head, F.col("ops")).alias("delta"))
