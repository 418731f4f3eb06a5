"""Structural rules of snapshots, as one list of violations; rows of snapshots judged in Arrow batches."""

from __future__ import annotations

from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina import errors
from lamina.functions import geojson
from lamina.functions.canon import loads, payload_digest
from lamina.operators.geometry import document_order
from lamina.schemas import COUNTER_BOUND, GEOMETRY_TYPES, WIRE_VERSION


class _Judge:
    """Collects what is wrong with one snapshot."""

    def __init__(self, s: dict[str, Any]) -> None:
        self.s, self.found = s, []
        self.clock = s["clock"] or 0
        self.applied = dict(s["applied"] or {})
        self.known = dict(s["vector_clock"] or {})

    def need(self, good: Any, rule: str) -> bool:
        if not good:
            self.found.append(rule)
        return bool(good)

    def stamp(self, stamp: dict | None, what: str) -> None:
        if stamp is None:
            return
        self.need((stamp["site_id"] or "").strip() and 0 < (stamp["seq"] or 0) < COUNTER_BOUND and 0 < (stamp["ts"] or 0) < COUNTER_BOUND, f"{what}: invalid stamp")
        self.need((stamp["ts"] or 0) <= self.clock, f"{what}: stamp beyond the clock")
        self.need((stamp["seq"] or 0) <= self.applied.get(stamp["site_id"], 0), f"{what}: stamp beyond what was applied")

    def ref(self, ref: dict, what: str) -> None:
        self.need((ref["site_id"] or "").strip() and 0 < (ref["seq"] or 0) < COUNTER_BOUND, f"{what}: invalid reference")
        self.need((ref["seq"] or 0) <= self.applied.get(ref["site_id"], 0), f"{what}: reference beyond what was applied")

    def head(self) -> None:
        s = self.s
        self.need(s["version"] == WIRE_VERSION, "unsupported version")
        self.need(s["base_hash"], "base_hash is required")
        self.need((s["document_id"] or "").strip(), "document_id is required")
        self.need((s["site_id"] or "").strip(), "site_id is required")
        self.need(0 <= self.clock < COUNTER_BOUND, "clock is out of range")
        for name, clock in (("vector_clock", self.known), ("applied", self.applied)):
            self.need(all(k.strip() and v is not None and 0 <= v < COUNTER_BOUND for k, v in clock.items()), f"{name} is invalid")
        self.need(all((v or 0) <= self.applied.get(k, 0) for k, v in self.known.items()), "vector_clock exceeds applied")
        self.need((s["synced_through"] or 0) <= self.applied.get(s["site_id"], 0), "synced_through exceeds applied")

    def feature(self, f: dict) -> None:
        self.stamp(f["create_reg"], "create register")
        self.stamp(f["delete_reg"], "delete register")
        gen, stamp = f["gen_id"], f["gen_stamp"]
        seen = [(r["site_id"], r["seq"]) for r in f["seen_gens"] or ()]
        self.need((gen is None) == (stamp is None), "generation and its stamp go together")
        if gen is not None:
            self.ref(gen, "generation")
            self.stamp(stamp, "generation stamp")
            self.need(stamp is None or (stamp["site_id"], stamp["seq"]) == (gen["site_id"], gen["seq"]), "generation doesn't match its stamp")
            self.need((gen["site_id"], gen["seq"]) in seen, "the current generation isn't among those seen")
        for r in f["seen_gens"] or ():
            self.ref(r, "seen generation")
        self.need(len(set(seen)) == len(seen), "a seen generation is there twice")
        for p in dict(f["properties"] or {}).values():
            self.stamp(p["reg"], "property register")
            if not p["value"]:
                self.need(p["deleted"], "a property has no value")
                continue
            try:
                loads(p["value"])
            except ValueError:
                self.found.append("a property isn't JSON")
        if f["geometry"] is not None:
            self.need(f["base"] or gen is not None, "a geometry has no generation")
            self.geometry(f["geometry"])

    def key(self, key: dict, what: str) -> tuple | None:
        init, stamp = key["init"], key["stamp"]
        if not self.need((init is None) != (stamp is None), f"{what}: a key is either initial or a stamp"):
            return None
        if init is not None:
            self.need(init >= 0, f"{what}: negative initial key")
            return (0, init, b"", 0)
        self.stamp(stamp, f"{what} key")
        return (1, stamp["ts"], stamp["site_id"].encode("utf-8", "surrogatepass"), stamp["seq"])

    def members(self, rows: list[dict], what: str) -> list[tuple | None]:
        """Rules that parts and rings share: ids given and unique, keys in strict order."""
        ids = [r["id"] for r in rows]
        self.need(all((i or "").strip() for i in ids), f"a {what} has no id")
        self.need(len(set(ids)) == len(ids), f"a {what} id is there twice")
        keys = [self.key(r["key"], what) for r in rows]
        good = [k for k in keys if k is not None]
        self.need(all(a < b for a, b in zip(good, good[1:], strict=False)), f"{what}s aren't in order")
        self.need(all(k[1] == i for i, k in enumerate(keys) if k is not None and k[0] == 0), f"an initial {what} isn't at its position")
        return keys

    def geometry(self, g: dict) -> None:
        kind, parts = g["type"], list(g["parts"] or ())
        if not self.need(g["dims"] in (2, 3), "dims must be 2 or 3") | self.need(kind in GEOMETRY_TYPES, "unsupported geometry type"):
            return
        multi, member = (kind or "").startswith("Multi"), geojson.part_type(kind or "")
        self.need(multi or len(parts) == 1, "a simple geometry has one part")
        for part, key in zip(parts, self.members(parts, "part"), strict=True):
            if key is None:
                continue
            tag = "" if key[0] == 0 else f"{key[2].decode('utf-8', 'surrogatepass')}:{key[3]}"
            self.need(part["id"] == (f"part:{key[1]}" if key[0] == 0 else f"part:{tag}") and (multi or key[0] == 0), "a part id isn't derived from its key")
            self.need(part["part_type"] == member, "a part has the wrong type")
            self.need(multi or not part["deleted"], "the part of a simple geometry is deleted")
            rings = list(part["rings"] or ())
            self.need(len(rings) == 1 if member != "Polygon" else rings, "a part has the wrong number of rings")
            for i, (ring, ring_key) in enumerate(zip(rings, self.members(rings, "ring"), strict=True)):
                if ring_key is None:
                    continue
                own = f"ring:{tag or key[1]}:{ring_key[1]}" if ring_key[0] == 0 else f"ring:{ring_key[2].decode('utf-8', 'surrogatepass')}:{ring_key[3]}"
                self.need(ring["id"] == own and (ring_key[0] == 0 or member == "Polygon"), "a ring id isn't derived from its key")
                outer = member == "Polygon" and i == 0
                self.need(bool(ring["exterior"]) == outer, "exterior is on the wrong ring")
                self.need(not (outer and ring["deleted"]), "an exterior ring is deleted")
                stem = own.replace("ring:", "v:", 1) if tag or ring_key[0] else f"init:{ring_key[1]}"
                self.ring(ring, stem, g["dims"], member)

    def ring(self, ring: dict, stem: str, dims: int, member: str) -> None:
        rows = list(ring["vertices"] or ())
        keys = [self.key(v["key"], "vertex") for v in rows]
        if None in keys:
            return
        ids = [v["id"] for v in rows]
        place = {v: i for i, v in enumerate(ids)}
        self.need(len(place) == len(ids), "a vertex id is there twice")
        for i, (v, k) in enumerate(zip(rows, keys, strict=True)):
            parent = v["parent"] or None
            self.need(parent is None or place.get(parent, i) < i, "a vertex comes before its predecessor")
            if k[0] == 0:
                self.need(v["id"] == f"{stem}:{k[1]}" and parent == (f"{stem}:{k[1] - 1}" if k[1] else None), "an initial vertex isn't derived from its key")
            else:
                self.need(v["id"] == f"op:{k[2].decode('utf-8', 'surrogatepass')}:{k[3]}", "a vertex id isn't derived from its key")
            try:
                self.need(len(geojson.position(list(v["coord"] or ()))) == dims, "a vertex has the wrong layout")
            except errors.InvalidGeometry:
                self.found.append("a vertex has an invalid position")
            self.stamp(v["move_reg"], "move register")
        siblings = [(v["parent"] or None, k) for v, k in zip(rows, keys, strict=True)]
        self.need(len(set(siblings)) == len(siblings), "two vertices have one key")
        positions = [k[1] if k[0] == 0 else None for k in keys]
        order = document_order(ids, [v["parent"] or None for v in rows], positions, [k[1:] for k in keys])
        self.need(order == list(range(len(rows))), "vertices aren't in document order")
        if member == "Point":
            self.need(len(rows) == 1 and not rows[0]["deleted"], "a point has one visible vertex")

    def operations(self) -> None:
        from lamina.operators.replica import ref_of, wire_error

        s = self.s
        lists = {name: list(s[f"{name}_ops"] or ()) for name in ("retained", "outbox", "pending")}
        digests: dict = {}
        for name, ops in lists.items():
            for op in ops:
                if not self.need(wire_error(op) is None, f"{name}: invalid operation"):
                    continue
                self.need(op["ts"] <= self.clock, f"{name}: operation beyond the clock")
                self.need(op["seq"] <= self.applied.get(op["site_id"], 0), f"{name}: operation beyond what was applied")
                self.need(digests.setdefault(ref_of(op), d := payload_digest(op)) == d, "two operations claim one identity")
            refs = [ref_of(op) for op in ops]
            self.need(len(set(refs)) == len(refs), f"{name}: an operation is there twice")
        kept = {ref_of(op) for op in lists["retained"]}
        self.need(all((op["seq"] or 0) > self.known.get(op["site_id"], 0) for op in lists["retained"]), "retained: operation within the contiguous frontier")
        synced = s["synced_through"] or 0
        self.need(all(op["site_id"] == s["site_id"] and (op["seq"] or 0) > synced for op in lists["outbox"]), "outbox: operation of another site or acknowledged")
        self.need(len({ref_of(op) for op in lists["outbox"]}) == self.applied.get(s["site_id"], 0) - synced, "outbox has the wrong number of operations")
        self.need(all(op["type"] == "edit_geometry" for op in lists["pending"]), "pending: operation that isn't an edit")
        self.need(all((op["seq"] or 0) <= self.known.get(op["site_id"], 0) or ref_of(op) in kept for op in lists["pending"]), "pending: sparse operation that isn't retained")


def violations(snapshot: dict[str, Any]) -> list[str]:
    """Every rule that a snapshot breaks, each once; empty for a valid one. Never raises on malformed members."""
    judge = _Judge(snapshot)
    try:
        judge.head()
        features = list(snapshot["features"] or ())
        ids = [f["id"] for f in features]
        judge.need(all((i or "").strip() for i in ids), "a feature has no id")
        judge.need(len(set(ids)) == len(ids), "a feature id is there twice")
        for f in features:
            judge.feature(f)
        judge.operations()
    except (TypeError, KeyError, AttributeError) as e:
        judge.found.append(f"malformed: {type(e).__name__}")
    return list(dict.fromkeys(judge.found))


def require_valid(snapshot: dict[str, Any]) -> None:
    if found := violations(snapshot):
        raise errors.InvalidSnapshot("; ".join(found[:5]))


def judged(snapshots: DataFrame) -> DataFrame:
    """(id, rule) for each rule that a snapshot breaks; snapshots once per id. One row is one snapshot, judged on its own."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def judge(rows: pa.Array) -> pa.Array:
        return pa.array([violations(_plain(r)) for r in rows.to_pylist()], pa.list_(pa.string()))

    columns = [c for c in snapshots.columns]
    once = snapshots.groupBy("id").agg(F.first(F.struct(*columns)).alias("s"))
    return once.select("id", F.explode(judge("s")).alias("rule"))


def _plain(value: Any) -> Any:
    """Arrow's map entries as dictionaries."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        if value and isinstance(value[0], tuple):
            return {k: _plain(v) for k, v in value}
        return [_plain(v) for v in value]
    return value
