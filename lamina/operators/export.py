"""Exported geometries by one fold per feature.

The newest move of each vertex is aggregated first, with a map-side combine, so that what
reaches a feature's group is bounded by its elements rather than by how often they were
moved. The group then holds the feature's generations, its creations and deletions, and one
position per moved vertex; their order doesn't matter. Only a geometry that grew (vertices, rings or
parts inserted or removed) is built element by element; others are changed in place. The tables of geometry.py give the
same state element by element, without gathering a feature.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.errors import InvalidGeometry, UnsupportedGeometry
from lamina.functions import geojson
from lamina.functions.geojson import Shape, feature_json, part_type
from lamina.functions.topology import polygon_repair
from lamina.operators import replay
from lamina.operators.engine import Engine, stamp_of
from lamina.operators.geometry import FEATURE, generations, property_values, usable

SCHEMA = "document_id string, feature_id string, type string, dims int, geometry string"
_ARROW = pa.schema([("document_id", pa.string()), ("feature_id", pa.string()), ("type", pa.string()), ("dims", pa.int32()), ("geometry", pa.string())])


def _index(vertex: str, prefix: str) -> int:
    """Place of an initial vertex in its ring, from its id; -1 for other ids."""
    digits = vertex[len(prefix) :] if vertex.startswith(prefix) else ""
    return int(digits) if digits.isascii() and digits.isdigit() and (digits[0] != "0" or digits == "0") else -1


def _in_place(s: Shape, deletes: list[tuple], moves: list[tuple]) -> str:
    """Exported GeoJSON of a geometry whose vertices were only moved and deleted: rings keep their order, so nothing is walked."""
    rings = {(f"part:{p}", f"ring:{p}:{r}"): (ring, f"init:{r}:") for p, part in enumerate(s.parts) for r, ring in enumerate(part)}
    for part, ring, vertex, coord in moves:
        if len(coord) == s.dims and (found := rings.get((part, ring))) and 0 <= (k := _index(vertex, found[1])) < len(found[0]):
            found[0][k] = tuple(coord)
    gone: dict[tuple, set] = {}
    if part_type(s.type) != "Point":
        for part, ring, vertex in deletes:
            if (part, ring) in rings:
                gone.setdefault((part, ring), set()).add(_index(vertex, rings[part, ring][1]))
    for key, places in gone.items():
        ring = rings[key][0]
        ring[:] = [c for k, c in enumerate(ring) if k not in places]
    return geojson.export(s)


def _fold(group: pa.Table) -> pa.Table:
    """One feature: pick the newest generation that can be parsed, apply what addresses it, export."""
    none = pa.table([pa.array([], f.type) for f in _ARROW], schema=_ARROW)
    kinds = group["row"].to_pylist()
    makers, edits, moves = (pa.array([i for i, k in enumerate(kinds) if k == name], pa.int64()) for name in ("generation", "edit", "move"))
    candidates = sorted(group.take(makers).select(["ts", "site_id", "seq", "geometry"]).to_pylist(), key=stamp_of, reverse=True)
    shape = gen = None
    for c in candidates:
        try:
            shape = None if geojson.no_geometry(c["geometry"]) else geojson.parse(c["geometry"])
        except (InvalidGeometry, UnsupportedGeometry):
            continue
        gen = (c["site_id"], c["seq"])
        break
    if shape is None:
        return none
    rows = [r for r in group.take(edits).select(["gen_site", "gen_seq", "ts", "site_id", "seq", "edit"]).to_pylist() if (r["gen_site"], r["gen_seq"]) == gen]
    moved = group.take(moves)
    columns = [moved[c].to_pylist() for c in ("gen_site", "gen_seq", "part_id", "ring_id", "vertex_id", "coord")]
    placed = [m for site, seq, *m in zip(*columns, strict=True) if (site, seq) == gen and None not in m]
    if all(r["edit"]["action"] == "delete_vertex" for r in rows):
        text = _in_place(shape, [(e["part_id"], e["ring_id"], e["vertex_id"] or "") for e in (r["edit"] for r in rows)], placed)
    else:
        grown = Engine.of(shape)
        for op in sorted(rows, key=stamp_of):
            grown.put(op["edit"] | op)
        for part, ring, vertex, coord in placed:
            grown.place(part, ring, vertex, coord)
        text = grown.geojson()
    own = [[group["document_id"][0].as_py()], [group["feature_id"][0].as_py()], [shape.type], [shape.dims], [text]]
    return pa.table([pa.array(v, f.type) for v, f in zip(own, _ARROW, strict=True)], schema=_ARROW)


def geometries(op: DataFrame, base: DataFrame) -> DataFrame:
    """(document_id, feature_id, type, dims, geometry): exported GeoJSON of each feature whose winner has a geometry.

    Equal to geometry.geometries over geometry.Tables. Two shuffles: moves by vertex, combined first, and
    everything by feature.
    """
    e, g = F.col("geometry_op"), F.struct(F.coalesce("gen.site_id", F.lit("")).alias("gen_site"), F.coalesce("gen.seq", F.lit(0)).alias("gen_seq"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = op.schema["geometry_op"].dataType
    text, number = "string", "bigint"
    blank = {"ts": number, "site_id": text, "seq": number, "geometry": text, "gen_site": text, "gen_seq": number, "edit": kind, "part_id": text, "ring_id": text, "vertex_id": text, "coord": "array<double>"}

    def rows(df: DataFrame, name: str, **columns) -> DataFrame:
        return df.select(*FEATURE, F.lit(name).alias("row"), *[columns.get(c, none(t)).alias(c) for c, t in blank.items()])

    made = generations(op, base)
    made = rows(made, "generation", ts=F.col("ts"), site_id=F.col("gen_site"), seq=F.col("gen_seq"), geometry=F.col("geometry"))
    edits = op.where("type = 'edit_geometry' AND geometry_op IS NOT NULL").withColumn("g", g)
    other = rows(edits.where(F.coalesce(e.action, F.lit("")) != "move_vertex"), "edit", ts=F.col("ts"), site_id=F.col("site_id"), seq=F.col("seq"), gen_site=F.col("g.gen_site"), gen_seq=F.col("g.gen_seq"), edit=e)
    finite = F.forall(e.coord, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sent = edits.where((e.action == "move_vertex") & F.coalesce(finite, F.lit(False)))
    # Moves of another layout can't apply and must not hide older ones that can, so the layout is part of the key.
    key = [*FEATURE, "g", e.part_id.alias("part_id"), e.ring_id.alias("ring_id"), e.vertex_id.alias("vertex_id"), F.size(e.coord).alias("dims")]
    newest = sent.groupBy(*key).agg(F.max(F.struct("ts", "site_id", "seq", e.coord.alias("coord"))).alias("m"))
    moves = rows(newest, "move", gen_site=F.col("g.gen_site"), gen_seq=F.col("g.gen_seq"), part_id=F.col("part_id"), ring_id=F.col("ring_id"), vertex_id=F.col("vertex_id"), coord=F.col("m.coord"))
    return made.unionByName(other).unionByName(moves).groupBy(*FEATURE).applyInArrow(_fold, SCHEMA)


def features(op: DataFrame, base: DataFrame, repairs: int = 0) -> DataFrame:
    """Visible features as GeoJSON: (document_id, feature_id, geometry, feature). Geometry null where there is none.

    ``repairs`` is a mask of topology's bits, applied to polygons on the way out.
    """
    alive = replay.liveness(usable(op), base).where("visible").select(*FEATURE)
    shown = geometries(op, base).select(*FEATURE, polygon_repair(F.col("geometry"), repairs).alias("geometry"))
    held = property_values(op, base).groupBy(*FEATURE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_key", "value")))).alias("properties"))
    rows = alive.join(shown, list(FEATURE), "left").join(held, list(FEATURE), "left")
    return rows.select(*FEATURE, "geometry", feature_json("feature_id", "geometry", "properties").alias("feature"))


def next_base(op: DataFrame, base: DataFrame) -> DataFrame:
    """Base features of the next epoch: (document_id, feature_id, geometry, properties) of visible features, as exported."""
    alive = replay.liveness(usable(op), base).where("visible").select(*FEATURE)
    shown = geometries(op, base).select(*FEATURE, "geometry")
    held = property_values(op, base).groupBy(*FEATURE).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property_key", "value")))).alias("properties"))
    return alive.join(shown, list(FEATURE), "left").join(held, list(FEATURE), "left")


def write_features(rows: DataFrame, path: str) -> None:
    """Write features() as GeoJSON, one Feature per line, in folders by document; within and across a folder's files by feature id.

    A document of any size is spread over many files; the FeatureCollection text of a document, which is one value, is
    bounded by what a row can hold (2 GB). Features are compared bytewise.
    """
    placed = rows.select(F.sha2("document_id", 256).alias("document"), *FEATURE, "feature").repartitionByRange("document", "feature_id").sortWithinPartitions("document", "feature_id")
    placed.select("document", "feature").write.mode("overwrite").partitionBy("document").text(path)
