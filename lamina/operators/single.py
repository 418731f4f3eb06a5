"""A geometry that is edited by itself, without a document around it: one replica, and the fold over many.

A single geometry is a document with one synthetic base feature. Its lineage is the SHA-256 of the geometry as it
would be exported, so that replicas whose geometry was only written differently belong together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina import errors
from lamina.functions import geojson
from lamina.functions.canon import sha256_hex
from lamina.functions.geojson import geometry_error, normal_geometry
from lamina.operators import export
from lamina.operators.replica import EDIT_FIELDS, Replica, Tally

#: Name of the synthetic feature.
FEATURE_ID = "geometry"
IDENTITY = ("site_id", "seq", "ts")


def to_document(edit: dict) -> dict:
    """An edit with its own identity as an operation on the synthetic feature."""
    blank = {"geometry": None, "properties": None, "property_key": None, "property_value": None, "gen": None}
    return blank | {k: edit[k] for k in IDENTITY} | {"type": "edit_geometry", "feature_id": FEATURE_ID, "geometry_op": {f: edit.get(f) for f in EDIT_FIELDS}}


def from_document(op: dict) -> dict:
    """The edit of an operation, with the operation's identity."""
    return {f: op["geometry_op"][f] for f in EDIT_FIELDS} | {k: op[k] for k in IDENTITY}


class GeometryReplica:
    """One geometry at one site. Replicas merge only if their lineage is the same; edits are as those of documents."""

    def __init__(self, site_id: str, geometry: str) -> None:
        if geojson.no_geometry(geometry):
            raise errors.InvalidGeometry("an initial geometry is required")
        self.lineage = hashlib.sha256(geojson.export(geojson.parse(geometry)).encode()).hexdigest()
        self._inner = Replica(self.lineage, site_id, [(FEATURE_ID, geometry, None)])

    @property
    def site_id(self) -> str:
        return self._inner.site_id

    @property
    def clock(self) -> int:
        return self._inner.clock

    @property
    def _engine(self):
        return self._inner.features[FEATURE_ID].geometry

    def layout(self) -> str:
        return self._inner.layout(FEATURE_ID)

    def geometry(self) -> str:
        """The geometry as it is now."""
        return self._engine.geojson()

    def info(self) -> list[dict]:
        """Visible structure with the ids that edits name."""
        return self._engine.info()

    def vertex_at(self, part_id: str, ring_id: str, index: int) -> str:
        return self._engine.vertex_at(part_id, ring_id, index)

    def apply(self, change: dict) -> dict:
        """Apply a local edit (replica.move_vertex and so on); the edit with its identity. InvalidCommand if it doesn't fit."""
        return from_document(self._inner.edit_geometry(FEATURE_ID, change))

    def ops(self) -> list[dict]:
        """All edits known here, in the order of arrival."""
        return [from_document(op) for op in self._inner.ops]

    def merge_ops(self, edits: Iterable[dict]) -> Tally:
        """Merge edits, all or none: an invalid one or a collision refuses the batch.

        An edit of this site beyond its own history means that its name is used elsewhere: InvalidSyncState.
        """
        edits = list(edits)
        for e in edits:
            if e["site_id"] == self.site_id and e["seq"] > self._inner.local_seq:
                raise errors.InvalidSyncState(f"{e['site_id']}:{e['seq']} is beyond local history; the site's identity is used elsewhere")
        return self._inner.merge_ops(self.lineage, [to_document(e) for e in edits])

    def merge(self, other: GeometryReplica) -> Tally:
        """Merge all that another replica knows; itself, nothing."""
        if other is self:
            return Tally()
        if other.lineage != self.lineage:
            raise errors.BaseMismatch(other.lineage)
        tally = self.merge_ops(other.ops())
        self._inner.clock = max(self._inner.clock, other.clock)
        return tally

    def pending_ops(self) -> tuple[list[dict], int]:
        """Own edits not yet acknowledged, and the watermark to acknowledge them with."""
        ops, mark = self._inner.pending_ops()
        return [from_document(op) for op in ops], mark

    def mark_synced(self, watermark: int) -> None:
        self._inner.mark_synced(watermark)


def lineages(bases: DataFrame) -> DataFrame:
    """(geometry_id, lineage) of initial geometries (geometry_id, geometry); null where the geometry is none or broken."""
    good = F.col("geometry").isNotNull() & geometry_error("geometry").isNull()
    return bases.select("geometry_id", F.when(good, sha256_hex(normal_geometry("geometry"))).alias("lineage"))


def geometries(edits: DataFrame, bases: DataFrame) -> DataFrame:
    """(geometry_id, type, dims, geometry): single geometries after all their edits.

    ``edits``: (geometry_id, site_id, seq, ts, geometry_op); ``bases``: (geometry_id, geometry). The fold of
    documents with one synthetic feature each.
    """
    none = lambda kind: F.lit(None).cast(kind)
    op = edits.select(
        F.col("geometry_id").alias("document_id"), F.lit("edit_geometry").alias("type"), "site_id", "seq", "ts", F.lit(FEATURE_ID).alias("feature_id"),
        none("string").alias("geometry"), none("struct<site_id:string,seq:bigint>").alias("gen"), "geometry_op",
    )
    base = bases.select(F.col("geometry_id").alias("document_id"), F.lit(FEATURE_ID).alias("feature_id"), "geometry")
    return export.geometries(op, base).select(F.col("document_id").alias("geometry_id"), "type", "dims", "geometry")
