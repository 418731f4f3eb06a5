"""One document as one replica edits it: commands, merges, deltas, snapshots, epoch cuts.

This is the control plane for a single document: it runs on the driver, or inside a grouped
map over many documents. Bulk work over logs is in the DataFrame operators; both follow the
same rules and are tested against each other.
"""

from __future__ import annotations

import copy
import hashlib
import json
import secrets
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from lamina import errors
from lamina.functions import geojson, topology
from lamina.functions.canon import CREATED, base_document_text, loads, payload_digest, write
from lamina.operators import engine as en
from lamina.operators.engine import Engine, Result, Stamp, stamp_of
from lamina.schemas import ACTIONS, COUNTER_BOUND, OP_TYPES, WIRE_VERSION

Ref = tuple[str, int]
#: The generation of base features.
BASE: Ref = ("", 0)
EDIT_FIELDS = ("action", "part_id", "ring_id", "vertex_id", "after_vertex_id", "coord", "ring", "part")


def ref_of(op: dict) -> Ref:
    return op["site_id"], op["seq"]


def edit(action: str, **fields: Any) -> dict:
    """A geometry edit with all its fields."""
    return {f: None for f in EDIT_FIELDS} | {"action": action} | fields


def coord(x: float, y: float, z: float | None = None) -> list[float]:
    """A position; three-dimensional if z is given."""
    return [float(x), float(y)] if z is None else [float(x), float(y), float(z)]


def insert_vertex(part_id: str, ring_id: str, after: str | None, at: list[float]) -> dict:
    return edit("insert_vertex", part_id=part_id, ring_id=ring_id, after_vertex_id=after, coord=at)


def move_vertex(part_id: str, ring_id: str, vertex_id: str, at: list[float]) -> dict:
    return edit("move_vertex", part_id=part_id, ring_id=ring_id, vertex_id=vertex_id, coord=at)


def delete_vertex(part_id: str, ring_id: str, vertex_id: str) -> dict:
    return edit("delete_vertex", part_id=part_id, ring_id=ring_id, vertex_id=vertex_id)


def add_ring(part_id: str, ring: list[list[float]]) -> dict:
    return edit("add_ring", part_id=part_id, ring=ring)


def remove_ring(part_id: str, ring_id: str) -> dict:
    return edit("remove_ring", part_id=part_id, ring_id=ring_id)


def add_part(part: str) -> dict:
    return edit("add_part", part=part)


def remove_part(part_id: str) -> dict:
    return edit("remove_part", part_id=part_id)


@dataclass
class Register:
    """A property: its raw value or a tombstone, and the stamp of its writer (None: the base)."""

    value: str | None
    deleted: bool = False
    stamp: Stamp | None = None


@dataclass
class Feature:
    """Registers of one feature; it may hold state before it exists."""

    base: bool = False
    created: Stamp | None = None
    deleted: Stamp | None = None
    gen: Ref = BASE
    gen_stamp: Stamp | None = None
    seen: set[Ref] = field(default_factory=set)
    properties: dict[str, Register] = field(default_factory=dict)
    geometry: Engine | None = None

    @property
    def visible(self) -> bool:
        if self.deleted is None:
            return self.base or self.created is not None
        return self.created is not None and self.created > self.deleted


@dataclass
class Tally:
    """What a merge did."""

    applied: int = 0
    duplicates: int = 0
    superseded: list[Ref] = field(default_factory=list)
    buffered: list[Ref] = field(default_factory=list)
    quarantined: list[tuple[Ref, str]] = field(default_factory=list)


def wire_error(op: dict) -> str | None:
    """Why an operation's envelope is invalid; None if it is valid. The row form is envelope.op_error."""
    e, kind = op.get("geometry_op"), op.get("type")
    if e is not None and (made := CREATED.get(e["action"])):
        derived = f"{made[1]}:{op['site_id']}:{op['seq']}"
        if e[made[0]] and e[made[0]] != derived:
            return f"{made[0]} must be {derived}"
    if not (op.get("site_id") or "").strip():
        return "site_id is required"
    for name in ("seq", "ts"):
        if not 0 < (op.get(name) or 0) < COUNTER_BOUND:
            return f"{name} is out of range"
    if not (op.get("feature_id") or "").strip():
        return "feature_id is required"
    if kind not in OP_TYPES:
        return f"unknown operation type {kind!r}"

    def is_json(text: str | None) -> bool:
        try:
            loads(text or "")
        except ValueError:
            return False
        return True

    if kind in ("insert_feature", "set_geometry") and not geojson.no_geometry(op.get("geometry")) and not is_json(op["geometry"]):
        return "geometry must be JSON"
    if kind == "insert_feature" and not all(map(is_json, (op.get("properties") or {}).values())):
        return "property values must be JSON"
    if kind in ("set_property", "delete_property") and not (op.get("property_key") or "").strip():
        return "property_key is required"
    if kind == "set_property" and not is_json(op.get("property_value")):
        return "property_value must be JSON"
    if kind != "edit_geometry":
        return None
    if e is None:
        return "geometry_op is required"
    needs = {"insert_vertex": ("part_id", "ring_id"), "move_vertex": ("part_id", "ring_id", "vertex_id"), "delete_vertex": ("part_id", "ring_id", "vertex_id")}
    needs |= {"add_ring": ("part_id", "ring"), "remove_ring": ("part_id", "ring_id"), "add_part": ("part",), "remove_part": ("part_id",)}
    if e["action"] not in ACTIONS:
        return f"unknown geometry action {e['action']!r}"
    lacks = [f for f in needs[e["action"]] if not e[f]]
    return f"{lacks[0]} is required" if lacks else None


def check_clock(clock: dict[str, int] | None, name: str = "vector_clock") -> None:
    for site, seq in (clock or {}).items():
        if not site.strip() or not 0 <= seq < COUNTER_BOUND:
            raise errors.InvalidSyncState(f"{name} has an invalid entry {site!r}: {seq}")


def covered_by(a: dict[str, int], b: dict[str, int]) -> bool:
    return all(seq <= b.get(site, 0) for site, seq in a.items())


class Replica:
    """A document at one site.

    ``base`` has (feature_id, geometry, properties) rows; replicas merge only if their document and
    base are the same. ``repairs`` is a mask of topology's bits for reads; with ``validate_export``
    exports fail on polygons that aren't valid.
    """

    def __init__(self, document_id: str = "", site_id: str = "", base: Iterable[tuple[str, str | None, dict[str, str] | None]] = (), repairs: int = 0, validate_export: bool = False) -> None:
        self.document_id = document_id if document_id.strip() else secrets.token_hex(16)
        self.site_id = site_id.strip() or secrets.token_hex(16)
        self.repairs, self.validate_export = repairs, validate_export
        base = list(base)
        self._reset(base)
        self.base_hash = hashlib.sha256(base_document_text(self.document_id, base).encode("utf-8", "surrogatepass")).hexdigest()

    @classmethod
    def from_collection(cls, document_id: str, site_id: str, text: str, **options: Any) -> Replica:
        """Over a GeoJSON FeatureCollection as base."""
        return cls(document_id, site_id, geojson.features_of(text), **options)

    def _reset(self, base: Iterable[tuple[str, str | None, dict[str, str] | None]]) -> None:
        self.features: dict[str, Feature] = {}
        for own, geometry, properties in base:
            shape = None if geojson.no_geometry(geometry) else Engine.parse(geometry)
            self.features[own] = Feature(base=True, seen={BASE}, properties={k: Register(v) for k, v in (properties or {}).items()}, geometry=shape)
        self.clock = self.local_seq = self.synced_through = self.issued_through = 0
        self.ops: list[dict] = []
        self.seen: dict[Ref, bytes] = {}
        self.frontier: dict[str, int] = {}
        self.staged: dict[str, set[int]] = {}
        self.compacted: dict[str, int] = {}
        self.orphan_edits: dict[Ref, list[dict]] = {}  # edits whose generation hasn't arrived

    # --- clocks ---

    def vector_clock(self) -> dict[str, int]:
        """Per site the number up to which everything is known."""
        return {s: max(self.frontier.get(s, 0), self.compacted.get(s, 0)) for s in {*self.frontier, *self.compacted}}

    def applied(self) -> dict[str, int]:
        """Per site the highest number known, beyond gaps too."""
        out = dict(self.compacted)
        for site, seq in self.seen:
            out[site] = max(out.get(site, 0), seq)
        return out

    def _observe(self, site: str, seq: int) -> None:
        at = self.frontier.get(site, 0)
        if seq <= at:
            return
        beyond = self.staged.setdefault(site, set())
        beyond.add(seq)
        while at + 1 in beyond:
            at += 1
            beyond.discard(at)
        if at:
            self.frontier[site] = at
        if not beyond:
            del self.staged[site]

    def _record(self, op: dict) -> None:
        self.ops.append(op)
        self.seen[ref_of(op)] = payload_digest(op)
        self._observe(*ref_of(op))

    # --- state ---

    def _feature(self, own: str) -> Feature:
        return self.features.setdefault(own, Feature())

    def _write(self, feature: Feature, key: str, register: Register) -> bool:
        old = feature.properties.get(key)
        if old is not None and old.stamp is not None and register.stamp <= old.stamp:
            return False
        feature.properties[key] = register
        return True

    def _apply(self, op: dict) -> list[tuple[dict, Result]]:
        """Apply one operation; its result and those of edits that it released."""
        own, stamp, kind = self._feature(op["feature_id"]) if op["type"] not in ("insert_feature", "set_geometry") else None, stamp_of(op), op["type"]
        if kind in ("insert_feature", "set_geometry"):
            try:
                shape = None if geojson.no_geometry(op["geometry"]) else Engine.parse(op["geometry"])
            except (errors.InvalidGeometry, errors.UnsupportedGeometry) as e:
                return [(op, Result(en.QUARANTINED, f"geometry: {e}"))]
            own = self._feature(op["feature_id"])
            if kind == "insert_feature":
                for key, value in (op["properties"] or {}).items():
                    self._write(own, key, Register(value, False, stamp))
                own.created = max(own.created or stamp, stamp)
            released = self._adopt(op["feature_id"], own, ref_of(op), stamp, shape)
            lost = kind == "set_geometry" and own.gen != ref_of(op)
            return [(op, Result(en.SUPERSEDED if lost else en.APPLIED)), *released]
        if kind == "delete_feature":
            if own.deleted is not None and stamp <= own.deleted:
                return [(op, Result(en.SUPERSEDED))]
            own.deleted = stamp
            return [(op, Result(en.APPLIED))]
        if kind in ("set_property", "delete_property"):
            won = self._write(own, op["property_key"], Register(op["property_value"], kind == "delete_property", stamp))
            return [(op, Result(en.APPLIED if won else en.SUPERSEDED))]
        return self._edit(own, op)

    def _edit(self, own: Feature, op: dict) -> list[tuple[dict, Result]]:
        gen = BASE if op["gen"] is None else (op["gen"]["site_id"], op["gen"]["seq"])
        if gen in own.seen:
            return self._to_engine(own, op) if gen == own.gen else [(op, Result(en.SUPERSEDED))]
        if gen == BASE:
            return [(op, Result(en.QUARANTINED, "the feature has no base generation"))]
        if gen[1] <= self.compacted.get(gen[0], 0) or gen in self.seen:
            return [(op, Result(en.QUARANTINED, f"{gen[0]}:{gen[1]} defines no generation of the feature"))]
        self.orphan_edits.setdefault(gen, []).append(op)
        return [(op, Result(en.BUFFERED))]

    def _to_engine(self, own: Feature, op: dict) -> list[tuple[dict, Result]]:
        if own.geometry is None:
            return [(op, Result(en.QUARANTINED, "the generation has no geometry"))]
        return [(e["op"], r) for e, r in own.geometry.put(op["geometry_op"] | {"site_id": op["site_id"], "seq": op["seq"], "ts": op["ts"], "op": op})]

    def _adopt(self, name: str, own: Feature, ref: Ref, stamp: Stamp, shape: Engine | None) -> list[tuple[dict, Result]]:
        """A generation arrived: install it if it is the newest, and settle the edits that waited for it.

        Edits that wait inside a generation that is replaced are reported as superseded.
        """
        own.seen.add(ref)
        waiting = sorted(self.orphan_edits.pop(ref, ()), key=stamp_of)
        if own.gen_stamp is not None and stamp <= own.gen_stamp:
            return [(op, Result(en.SUPERSEDED)) for op in waiting]
        out = [(e["op"], Result(en.SUPERSEDED)) for e in (own.geometry.pending() if own.geometry else ())]
        own.geometry, own.gen, own.gen_stamp = shape, ref, stamp
        for op in waiting:
            if op["feature_id"] != name:
                out.append((op, Result(en.QUARANTINED, f"the generation belongs to feature {name!r}")))
            else:
                out += self._to_engine(own, op)
        return out

    # --- merging ---

    def merge_ops(self, document_id: str, ops: Iterable[dict]) -> Tally:
        """Merge operations, all or none: an invalid envelope or a collision refuses the batch."""
        if document_id != self.document_id:
            raise errors.DocumentMismatch(document_id)
        batch, digests, clock = [], {}, self.clock
        for op in ops:
            if error := wire_error(op):
                raise errors.InvalidOp(error)
            site, seq = ref_of(op)
            if site == self.site_id and seq > self.local_seq:
                raise errors.InvalidOp(f"{site}:{seq} is beyond local history; the site's identity is used elsewhere")
            clock = max(clock, op["ts"])
            digest = payload_digest(op)
            if self.seen.get((site, seq), digest) != digest or digests.setdefault((site, seq), digest) != digest:
                raise errors.IdentityCollision(f"{site}:{seq}")
            batch.append(copy.deepcopy(op))
        batch.sort(key=stamp_of)
        tally, waiting = Tally(), {}
        for op in batch:
            if op["seq"] <= self.compacted.get(op["site_id"], 0) or ref_of(op) in self.seen:
                tally.duplicates += 1
                continue
            results = self._apply(op)
            self._record(op)
            for own, result in results:
                ref = ref_of(own)
                if result.outcome == en.BUFFERED:
                    waiting.setdefault(ref)
                    continue
                if result.outcome != en.DUPLICATE:
                    waiting.pop(ref, None)
                if result.outcome == en.APPLIED:
                    tally.applied += 1
                elif result.outcome == en.DUPLICATE:
                    tally.duplicates += 1
                elif result.outcome == en.SUPERSEDED:
                    tally.superseded.append(ref)
                else:
                    tally.quarantined.append((ref, result.reason))
        tally.buffered = list(waiting)
        self.clock = clock
        return tally

    def merge(self, other: Replica) -> Tally:
        """Merge another replica's whole log; merging itself does nothing."""
        if other is self:
            return Tally()
        self._require_lineage(other.document_id, other.base_hash, other.compacted)
        tally = self.merge_ops(other.document_id, other.ops)
        self._take_clock(other.clock, other.compacted)
        return tally

    def _require_lineage(self, document_id: str, base_hash: str, compacted: dict[str, int]) -> None:
        if document_id != self.document_id:
            raise errors.DocumentMismatch(document_id)
        if base_hash != self.base_hash:
            raise errors.BaseMismatch(base_hash)
        if not covered_by(compacted, self.vector_clock()):
            raise errors.CompactionGap("the sender compacted operations that are unknown here")

    def _take_clock(self, clock: int, compacted: dict[str, int]) -> None:
        self.clock = max(self.clock, clock)
        for site, seq in compacted.items():
            self.compacted[site] = max(self.compacted.get(site, 0), seq)

    def delta_since(self, clock: dict[str, int]) -> dict:
        """What a peer with ``clock`` lacks, as a delta: its operations by (site, number)."""
        ops = sorted((op for op in self.ops if op["seq"] > clock.get(op["site_id"], 0)), key=lambda o: (o["site_id"].encode(), o["seq"]))
        return {
            "version": WIRE_VERSION, "document_id": self.document_id, "site_id": self.site_id, "base_hash": self.base_hash, "clock": self.clock,
            "vector_clock": self.vector_clock(), "compacted": dict(self.compacted), "ops": copy.deepcopy(ops),
        }

    def merge_delta(self, delta: dict) -> Tally:
        """Merge a delta after checking its version, numbers, document, base, claims and compaction, in this order."""
        if delta["version"] != WIRE_VERSION:
            raise errors.UnsupportedVersion(str(delta["version"]))
        check_clock(delta["vector_clock"])
        check_clock(delta.get("compacted"), "compacted")
        if not 0 <= delta["clock"] < COUNTER_BOUND or any((op.get("ts") or 0) > delta["clock"] for op in delta["ops"]):
            raise errors.InvalidSyncState("clock is out of range or behind an operation")
        compacted = delta.get("compacted") or {}
        if not covered_by(compacted, delta["vector_clock"]):
            raise errors.InvalidSyncState("compacted exceeds the vector clock")
        if delta["document_id"] != self.document_id:
            raise errors.DocumentMismatch(delta["document_id"])
        if delta["base_hash"] != self.base_hash:
            raise errors.BaseMismatch(delta["base_hash"])
        if max(delta["vector_clock"].get(self.site_id, 0), compacted.get(self.site_id, 0)) > self.local_seq:
            raise errors.InvalidSyncState("the delta claims more of this site than it has issued")
        self._require_lineage(delta["document_id"], delta["base_hash"], compacted)
        tally = self.merge_ops(self.document_id, delta["ops"])
        self._take_clock(delta["clock"], compacted)
        return tally

    def pending_ops(self) -> tuple[list[dict], int]:
        """Own operations not yet acknowledged, and the watermark to acknowledge them with."""
        out = [copy.deepcopy(op) for op in self.ops if op["site_id"] == self.site_id and op["seq"] > self.synced_through]
        watermark = max([self.synced_through, *(op["seq"] for op in out)])
        self.issued_through = max(self.issued_through, watermark)
        return out, watermark

    def mark_synced(self, watermark: int) -> None:
        """Acknowledge up to a watermark that pending_ops gave; older ones change nothing."""
        if watermark <= self.synced_through:
            return
        if watermark > min(self.issued_through, self.local_seq):
            raise errors.InvalidSyncState(f"watermark {watermark} was never issued")
        self.synced_through = watermark

    # --- commands ---

    def _local(self, kind: str, feature_id: str, **fields: Any) -> dict:
        if max(self.clock, self.local_seq) + 1 >= COUNTER_BOUND:
            raise errors.InvalidCommand("the clock is exhausted")
        if not feature_id.strip():
            raise errors.InvalidCommand("feature_id is required")
        if kind != "insert_feature" and (feature_id not in self.features or not self.features[feature_id].visible):
            raise errors.UnknownFeature(feature_id)
        if not geojson.no_geometry(fields.get("geometry")):
            try:
                geojson.parse(fields["geometry"])
            except (errors.InvalidGeometry, errors.UnsupportedGeometry) as e:
                raise errors.InvalidCommand(str(e)) from None
        blank = {"geometry": None, "properties": None, "property_key": None, "property_value": None, "gen": None, "geometry_op": None}
        op = blank | fields | {"type": kind, "site_id": self.site_id, "seq": self.local_seq + 1, "ts": self.clock + 1, "feature_id": feature_id}
        if kind == "edit_geometry":
            shape = self.features[feature_id].geometry
            if shape is None:
                raise errors.InvalidCommand("the feature has no geometry")
            shape.require(op["geometry_op"] | {k: op[k] for k in ("site_id", "seq", "ts")})
        results = self._apply(op)
        if results[0][1].outcome != en.APPLIED:
            raise errors.InvalidCommand(results[0][1].reason or f"the command was {results[0][1].outcome}")
        self._record(op)
        self.clock, self.local_seq = op["ts"], op["seq"]
        return op

    def insert_feature(self, feature_id: str, geometry: str | None = None, properties: dict[str, Any] | None = None) -> dict:
        """Create or re-create a feature; properties are host values."""
        return self._local("insert_feature", feature_id, geometry=geometry, properties={k: encode(v) for k, v in (properties or {}).items()} or None)

    def delete_feature(self, feature_id: str) -> dict:
        return self._local("delete_feature", feature_id)

    def set_geometry(self, feature_id: str, geometry: str | None) -> dict:
        return self._local("set_geometry", feature_id, geometry=geometry)

    def set_property(self, feature_id: str, key: str, value: Any) -> dict:
        if not key.strip():
            raise errors.InvalidCommand("a property key is required")
        return self._local("set_property", feature_id, property_key=key, property_value=encode(value))

    def delete_property(self, feature_id: str, key: str) -> dict:
        if not key.strip():
            raise errors.InvalidCommand("a property key is required")
        return self._local("delete_property", feature_id, property_key=key)

    def edit_geometry(self, feature_id: str, change: dict) -> dict:
        """Apply one of the edits above to a feature's current geometry."""
        own = self.features.get(feature_id)
        gen = None if own is None or own.gen == BASE else {"site_id": own.gen[0], "seq": own.gen[1]}
        return self._local("edit_geometry", feature_id, geometry_op=change | self._created(change), gen=gen)

    def _created(self, change: dict) -> dict:
        made = CREATED.get(change["action"])
        return {made[0]: f"{made[1]}:{self.site_id}:{self.local_seq + 1}"} if made else {}

    # --- reads ---

    def feature(self, feature_id: str) -> tuple[str | None, dict[str, str]] | None:
        """(geometry, raw properties) of a visible feature; None otherwise."""
        own = self.features.get(feature_id)
        if own is None or not own.visible:
            return None
        geometry = None if own.geometry is None else topology.repaired(own.geometry.geojson(), self.repairs)
        return geometry, {k: r.value for k, r in sorted(own.properties.items()) if not r.deleted}

    def visible_ids(self) -> list[str]:
        return sorted((f for f, own in self.features.items() if own.visible), key=str.encode)

    def geometry_info(self, feature_id: str) -> list[dict] | None:
        own = self.features.get(feature_id)
        return own.geometry.info() if own is not None and own.visible and own.geometry else None

    def layout(self, feature_id: str) -> str | None:
        own = self.features.get(feature_id)
        return None if own is None or not own.visible or own.geometry is None else "XYZ" if own.geometry.dims == 3 else "XY"

    def vertex_at(self, feature_id: str, part_id: str, ring_id: str, index: int) -> str:
        own = self.features.get(feature_id)
        if own is None or not own.visible:
            raise errors.UnknownFeature(feature_id)
        if own.geometry is None:
            raise errors.InvalidCommand("the feature has no geometry")
        return own.geometry.vertex_at(part_id, ring_id, index)

    def collection(self) -> str:
        """The visible features as a FeatureCollection, by id."""
        texts = []
        for own in self.visible_ids():
            geometry, properties = self.feature(own)
            if self.validate_export and (problem := topology.problem(geometry)):
                raise errors.InvalidTopology(f"{own}: {problem}")
            texts.append(geojson.feature_text(own, geometry, properties))
        return geojson.collection_text(texts)

    # --- snapshots and epochs ---

    def snapshot(self, own: str) -> dict:
        """All state as one nested value (the row layout of replica_snapshots)."""
        known = self.vector_clock()
        by_ref = lambda op: (op["site_id"].encode(), op["seq"])
        held = [e["op"] for f in self.features.values() if f.geometry for e in f.geometry.pending()] + [op for ops in self.orphan_edits.values() for op in ops]
        features = [_feature_out(name, f) for name, f in sorted(self.features.items(), key=lambda kv: kv[0].encode()) if _holds(f)]
        return copy.deepcopy(
            {
                "version": WIRE_VERSION, "id": own, "document_id": self.document_id, "site_id": self.site_id, "base_hash": self.base_hash, "clock": self.clock,
                "vector_clock": known, "applied": self.applied(), "synced_through": self.synced_through,
                "outbox_ops": [op for op in self.ops if op["site_id"] == self.site_id and op["seq"] > self.synced_through],
                "retained_ops": sorted((op for op in self.ops if op["seq"] > known.get(op["site_id"], 0)), key=by_ref),
                "pending_ops": sorted(held, key=by_ref), "features": features,
            }
        )

    @classmethod
    def restore(cls, site_id: str, snapshot: dict, **options: Any) -> Replica:
        """A replica from a snapshot; its history up to the vector clock counts as compacted.

        Restoring under another site id that occurs in the history is refused; under the same, local
        numbering goes on above what was applied.
        """
        from lamina.operators.snapshots import require_valid

        if snapshot["version"] != WIRE_VERSION:
            raise errors.UnsupportedVersion(str(snapshot["version"]))
        require_valid(snapshot)
        snapshot = copy.deepcopy(snapshot)
        site = site_id.strip() or secrets.token_hex(16)
        if site != snapshot["site_id"] and snapshot["applied"].get(site, 0):
            raise errors.InvalidSyncState(f"site {site!r} already has history here")
        new = cls(snapshot["document_id"], site, (), **options)
        new.base_hash, new.clock = snapshot["base_hash"], snapshot["clock"]
        new.compacted = {s: n for s, n in snapshot["vector_clock"].items() if n}
        if site == snapshot["site_id"]:
            new.local_seq, new.synced_through = snapshot["applied"].get(site, 0), snapshot["synced_through"]
        new.features = {f["id"]: _feature_in(f) for f in snapshot["features"] or ()}
        new.frontier = dict(new.compacted)
        logged = set()
        for op in [*(snapshot["retained_ops"] or ()), *(snapshot["outbox_ops"] or ())]:
            if ref_of(op) not in logged:
                logged.add(ref_of(op))
                new._record(op)
        for op in sorted(snapshot["pending_ops"] or (), key=stamp_of):
            new._apply(op)
        return new

    def rebase(self, document_id: str, stable: dict[str, int], snapshot_id: str) -> dict:
        """Cut the epoch: the visible state becomes the base of a new document. A receipt with the snapshot.

        Refused unless ``stable`` equals what is known contiguously, nothing is staged, waiting or
        unacknowledged, and every visible geometry can be parsed again.
        """
        document_id = document_id.strip()
        if not document_id or document_id == self.document_id:
            raise errors.RebaseUnsafe("a new document_id is required")
        try:
            check_clock(stable, "stable clock")
        except errors.InvalidSyncState as e:
            raise errors.RebaseUnsafe(str(e)) from None
        known = self.vector_clock()
        if not covered_by(stable, known) or not covered_by(known, stable):
            raise errors.RebaseUnsafe("the stable clock isn't what is known here")
        if self.staged:
            raise errors.RebaseUnsafe("delivery gaps remain")
        if self.synced_through != self.local_seq:
            raise errors.RebaseUnsafe("local operations aren't acknowledged")
        if self.orphan_edits or any(f.geometry and f.geometry.waiting for f in self.features.values()):
            raise errors.RebaseUnsafe("edits still wait for what they depend on")
        base = []
        for own in self.visible_ids():
            f = self.features[own]
            geometry = f.geometry.geojson() if f.geometry else None
            try:
                if geometry:
                    geojson.parse(geometry)
            except (errors.InvalidGeometry, errors.UnsupportedGeometry) as e:
                raise errors.RebaseUnsafe(f"{own}: {e}") from None
            base.append((own, geometry, {k: r.value for k, r in f.properties.items() if not r.deleted}))
        old_id, old_hash = self.document_id, self.base_hash
        self._reset(base)
        self.document_id = document_id
        self.base_hash = hashlib.sha256(base_document_text(document_id, base).encode("utf-8", "surrogatepass")).hexdigest()
        return {
            "previous_document_id": old_id, "document_id": document_id, "previous_base_hash": old_hash, "base_hash": self.base_hash,
            "stable_clock": dict(stable), "snapshot": self.snapshot(snapshot_id),
        }


def encode(value: Any) -> str:
    """A host value as raw JSON."""
    try:
        return write(loads(json.dumps(value, ensure_ascii=False, allow_nan=False)))
    except (TypeError, ValueError) as e:
        raise errors.InvalidCommand(f"property value: {e}") from None


def _stamp_out(s: Stamp | None) -> dict | None:
    return None if s is None else {"ts": s[0], "site_id": s[1].decode("utf-8", "surrogatepass"), "seq": s[2]}


def _stamp_in(s: dict | None) -> Stamp | None:
    return None if s is None else (s["ts"], s["site_id"].encode("utf-8", "surrogatepass"), s["seq"])


def _key_out(pos: int | None, made: Stamp | None) -> dict:
    return {"init": pos, "stamp": _stamp_out(made)}


def _holds(f: Feature) -> bool:
    """Whether a feature has anything worth keeping."""
    return bool(f.base or f.created or f.deleted or f.gen_stamp or f.seen or f.properties or f.geometry)


def _feature_out(name: str, f: Feature) -> dict:
    ref = lambda r: {"site_id": r[0], "seq": r[1]}
    return {
        "id": name, "base": f.base, "create_reg": _stamp_out(f.created), "delete_reg": _stamp_out(f.deleted),
        "gen_id": None if f.gen == BASE else ref(f.gen), "gen_stamp": _stamp_out(f.gen_stamp), "seen_gens": [ref(r) for r in sorted(f.seen - {BASE}, key=lambda r: (r[0].encode(), r[1]))],
        "properties": {k: {"value": r.value, "deleted": r.deleted, "reg": _stamp_out(r.stamp)} for k, r in sorted(f.properties.items())},
        "geometry": None if f.geometry is None else _engine_out(f.geometry),
    }


def _engine_out(g: Engine) -> dict:
    def vertices(ring: en.Ring) -> list[dict]:
        before = {v.pos: name for name, v in ring.vertices.items() if v.pos is not None}
        rows = []
        for name in g.order(ring):
            v = ring.vertices[name]
            parent = before.get(v.pos - 1) if v.pos is not None else v.after
            rows.append({"id": name, "parent": parent, "key": _key_out(v.pos, v.made), "coord": list(v.coord), "deleted": v.deleted, "move_reg": _stamp_out(v.moved)})
        return rows

    parts = []
    for p, part, rings in g.in_order():
        out = [{"id": r, "key": _key_out(ring.pos, ring.made), "exterior": ring.exterior, "deleted": ring.deleted, "vertices": vertices(ring)} for r, ring in rings]
        parts.append({"id": p, "key": _key_out(part.pos, part.made), "part_type": g.part_kind, "deleted": part.deleted, "rings": out})
    return {"type": g.kind, "dims": g.dims, "parts": parts}


def _feature_in(f: dict) -> Feature:
    gen = BASE if f["gen_id"] is None else (f["gen_id"]["site_id"], f["gen_id"]["seq"])
    seen = {(r["site_id"], r["seq"]) for r in f["seen_gens"] or ()} | ({BASE} if f["base"] else set())
    properties = {k: Register(r["value"], bool(r["deleted"]), _stamp_in(r["reg"])) for k, r in (f["properties"] or {}).items()}
    return Feature(bool(f["base"]), _stamp_in(f["create_reg"]), _stamp_in(f["delete_reg"]), gen, _stamp_in(f["gen_stamp"]), seen, properties, None if f["geometry"] is None else _engine_in(f["geometry"]))


def _engine_in(g: dict) -> Engine:
    parts = {}
    for p in g["parts"] or ():
        rings = {}
        for r in p["rings"] or ():
            held = {}
            for v in r["vertices"] or ():
                initial = v["key"]["init"] is not None
                held[v["id"]] = en.Vertex(tuple(v["coord"]), v["key"]["init"], None if initial else v["parent"] or None, _stamp_in(v["key"]["stamp"]), bool(v["deleted"]), _stamp_in(v["move_reg"]))
            rings[r["id"]] = en.Ring(r["key"]["init"], _stamp_in(r["key"]["stamp"]), bool(r["exterior"]), held, bool(r["deleted"]))
        parts[p["id"]] = en.Part(p["key"]["init"], _stamp_in(p["key"]["stamp"]), rings, bool(p["deleted"]))
    return Engine(g["type"], g["dims"], parts)
