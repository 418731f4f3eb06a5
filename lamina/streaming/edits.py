"""Merging the live stream of geometry edits: each feature's geometry and what waits for it are keyed state.

An edit may arrive before the vertex, ring, part or generation it names. It then waits in the feature's state, by
what it waits for, and is applied as soon as that comes into being, which may release others in turn. State per
(document, feature) is the geometry of its newest generation and the waiting edits; it is bounded by what the feature
holds, not by how often it was edited. Repeated deliveries change nothing.

A call of the processor costs milliseconds whatever it is given, so rows are grouped by buckets of features, and a map
in each bucket's state has one entry per feature: only entries of features that a micro-batch names are read and written.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lamina.errors import InvalidGeometry, UnsupportedGeometry
from lamina.functions.geojson import normal_geometry, shape
from lamina.operators.engine import APPLIED, BUFFERED, Engine, Part, Ring, Vertex
from lamina.operators.geometry import FEATURE, MAKERS
from lamina.operators.messages import messages
from lamina.operators.replica import EDIT_FIELDS, Feature, Ref, Replica, ref_of
from lamina.streaming.merge import start

OUTPUT = "document_id string, feature_id string, kind string, site_id string, seq bigint, outcome string, reason string, geometry string, version bigint"
_COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
_OP = ("type", "site_id", "seq", "ts", "geometry", "gen", "geometry_op")
_NO_OP = dict.fromkeys((*_OP, "delivery_id", "properties", "property_key", "property_value"))
_NO_GEN, _NO_EDIT = dict.fromkeys(("site_id", "seq")), dict.fromkeys(EDIT_FIELDS)
#: Groups of features, for good: the state is kept by bucket.
BUCKETS = 512

def _bucket() -> Column:
    return F.pmod(F.xxhash64(*FEATURE), F.lit(BUCKETS)).alias("bucket")

def _numbers(position: list | None) -> list | None:
    """A position from JSON, where numbers that aren't finite are texts; no number counts as a missing value."""
    return position and [v if type(v) is float else None if v is None or v == "NaN" else float(v) for v in position]

def _op(feature: str, row: dict) -> dict:
    """A row of the stream, which leaves missing values out, as an operation."""
    op = _NO_OP | row
    op["feature_id"] = feature
    if op["gen"] is not None:
        op["gen"] = _NO_GEN | op["gen"]
    if op["geometry_op"] is not None:
        edit = op["geometry_op"] = _NO_EDIT | op["geometry_op"]
        edit["coord"], edit["ring"] = _numbers(edit["coord"]), edit["ring"] and [_numbers(p) for p in edit["ring"]]
    return op

def _packed(e: Engine | None) -> tuple | None:
    """A geometry as plain tuples, which take a fraction of the time and room in the state that its objects would."""
    return e and (e.kind, e.dims, e.waiting, [
        (p, part.pos, part.made, part.deleted, [
            (r, ring.pos, ring.made, ring.exterior, ring.deleted, [(i, v.coord, v.pos, v.after, v.made, v.deleted, v.moved) for i, v in ring.vertices.items()])
            for r, ring in part.rings.items()
        ])
        for p, part in e.parts.items()
    ])


def _unpacked(packed: tuple | None) -> Engine | None:
    if packed is None:
        return None
    kind, dims, waiting, parts = packed
    ring = lambda pos, made, exterior, deleted, vertices: Ring(pos, made, exterior, {i: Vertex(*v) for i, *v in vertices}, deleted)
    return Engine(kind, dims, {p: Part(pos, made, {r: ring(*x) for r, *x in rings}, deleted) for p, pos, made, deleted, rings in parts}, waiting)


class Geometries(StatefulProcessor):
    """The newest generations of a bucket's features and the edits that wait, each feature as a replica would hold it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("features", "document_id string, feature_id string", "version bigint, held binary")
        self.replica = Replica("d", "stream")

    def _save(self, own: tuple[str, str], version: int, feature: Feature | None, orphans: dict[Ref, list[dict]]) -> None:
        """Write an entry; the feature is of no use afterwards."""
        if feature is not None:
            feature.geometry = _packed(feature.geometry)
        self.state.updateValue(own, (version, zlib.compress(pickle.dumps((feature, orphans), pickle.HIGHEST_PROTOCOL), 1)))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Base features; of repeated rows one, and broken geometries count as none."""
        for document, name, geometry in zip(*(initialState[c] for c in (*FEATURE, "geometry")), strict=True):
            try:
                base = Replica("d", "stream", [(name, geometry if isinstance(geometry, str) else None, None)])
            except (InvalidGeometry, UnsupportedGeometry):
                base = Replica("d", "stream", [(name, None, None)])
            self._save((document, name), 0, base.features[name], {})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = defaultdict(list)
        for part in rows:
            for document, name, row in zip(part["document_id"], part["feature_id"], json.loads(f"[{','.join(part['op'])}]"), strict=True):
                batch[document, name].append(_op(name, row))
        out = []
        for own, ops in batch.items():
            ops.sort(key=lambda op: (op["delivery_id"] is None, op["delivery_id"] or 0))
            out += self._merge(own, ops)
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS, dtype=object)

    def _merge(self, own: tuple[str, str], ops: list[dict]) -> list[tuple]:
        """Apply a feature's operations to its state; the rows that say so."""
        held, name, replica = self.state.getValue(own), own[1], self.replica
        version, (feature, orphans) = (held[0], pickle.loads(zlib.decompress(held[1]))) if held else (0, (None, {}))
        if feature is not None:
            feature.geometry = _unpacked(feature.geometry)
        replica.features, replica.orphan_edits = {} if feature is None else {name: feature}, orphans
        before = after = self._export(feature)
        out, waiting = [], self._waiting(replica)
        for op in ops:
            if ref_of(op) in waiting:
                continue
            for settled, result in replica._apply(op):
                (waiting.add if result.outcome == BUFFERED else waiting.discard)(ref_of(settled))
                out.append((*own, "outcome", *ref_of(settled), result.outcome, result.reason or None, None, version + 1))
        if not out:
            return out
        feature = replica.features.get(name)
        if any(row[5] == APPLIED for row in out):  # nothing else changes a geometry
            after = self._export(feature)
        if after != before:
            out.append((*own, "geometry", None, None, None, None, after, version + 1))
        self._save(own, version + 1, feature, orphans)
        return out

    @staticmethod
    def _export(feature: Feature | None) -> str | None:
        return None if feature is None or feature.geometry is None else feature.geometry.geojson()

    @staticmethod
    def _waiting(replica: Replica) -> set[Ref]:
        """Identities of the edits that wait."""
        edits = [e for ops in replica.orphan_edits.values() for e in ops]
        for held in replica.features.values():
            edits += [e for ops in held.geometry.waiting.values() for e in ops] if held.geometry else []
        return {ref_of(e) for e in edits}

    def close(self) -> None:
        pass

def merge(stream: DataFrame, base: DataFrame) -> DataFrame:
    """Outcomes of edits and makers of generations, and changed geometries, of a stream of op messages over base features.

    Rows of kind ``outcome`` say what became of an operation, again when a waiting one is settled; rows of kind
    ``geometry`` have a feature's export after a micro-batch that changed it, with a rising version. An edit that names an
    operation of another feature waits. Needs the RocksDB state store (merge.start).
    """
    op = messages(stream).where(F.col("type").isin(*MAKERS, "edit_geometry") & ((F.col("type") != "edit_geometry") | F.col("geometry_op").isNotNull()))
    rows = op.select(_bucket(), *FEATURE, F.to_json(F.struct("delivery_id", *_OP)).alias("op")).groupBy("bucket")
    start_ = base.where("document_id IS NOT NULL AND feature_id IS NOT NULL").dropDuplicates(list(FEATURE)).select(_bucket(), *FEATURE, "geometry").groupBy("bucket")
    return rows.transformWithStateInPandas(statefulProcessor=Geometries(), outputStructType=OUTPUT, outputMode="Update", timeMode="None", initialState=start_)

def settle(changes: DataFrame, base: DataFrame) -> DataFrame:
    """(document_id, feature_id, geometry): the newest exported geometry of each feature from all changes, over the base."""
    last = changes.where("kind = 'geometry'").groupBy(*FEATURE).agg(F.max_by("geometry", "version").alias("now"), F.lit(True).alias("changed"))
    old = base.dropDuplicates(list(FEATURE)).select(*FEATURE, "geometry").withColumn("s", shape("geometry"))
    old = old.select(*FEATURE, F.when(F.col("s.error").isNull() & F.col("s").isNotNull(), normal_geometry("geometry")).alias("old"))
    both = old.join(last, list(FEATURE), "full").select(*FEATURE, F.when(F.col("changed"), F.col("now")).otherwise(F.col("old")).alias("geometry"))
    return both.where("geometry IS NOT NULL")

def run_available(stream: DataFrame, base: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop: changes land in ``out`` as Parquet, each micro-batch once (its own folder, replaced on retry)."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    start(merge(stream, base).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save)).awaitTermination()
