"""One geometry generation as it is edited: elements by id, and edits that wait for one.

Elements are flat dictionaries keyed by their path; nothing is kept in order. Order is a function
of the keys and is computed when the geometry is read.
"""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, field
from typing import Any

from lamina.errors import InvalidCommand, InvalidGeometry, UnsupportedGeometry
from lamina.functions import geojson
from lamina.functions.geojson import Position, Shape, distinct_xy, open_ring, part_type
from lamina.operators.geometry import document_order

Stamp = tuple[int, bytes, int]
APPLIED, DUPLICATE, SUPERSEDED, BUFFERED, QUARANTINED = "applied", "duplicate", "superseded", "buffered", "quarantined"


@dataclass(slots=True)
class Vertex:
    """A vertex: its place among the initial ones, or the stamp and predecessor of its insertion."""

    coord: Position
    pos: int | None = None
    after: str | None = None
    made: Stamp | None = None
    deleted: bool = False
    moved: Stamp | None = None


@dataclass
class Ring:
    pos: int | None
    made: Stamp | None
    exterior: bool
    vertices: dict[str, Vertex]
    deleted: bool = False


@dataclass
class Part:
    pos: int | None
    made: Stamp | None
    rings: dict[str, Ring]
    deleted: bool = False


@dataclass(frozen=True)
class Result:
    """What became of an operation."""

    outcome: str
    reason: str = ""
    waits_for: tuple | None = None


def _no(reason: str) -> Result:
    return Result(QUARANTINED, reason)


_DONE, _AGAIN, _OLD = Result(APPLIED), Result(DUPLICATE), Result(SUPERSEDED)


def _chain(ids: list[str], coords: list[Position]) -> dict[str, Vertex]:
    return {own: Vertex(c, pos=i) for i, (own, c) in enumerate(zip(ids, coords, strict=True))}


def _set_order(item: tuple[str, Any]) -> tuple:
    """Parts and rings: initial ones by position, then added ones, oldest first."""
    e = item[1]
    return (e.pos is None, e.pos or 0, e.made or (0, b"", 0))


@dataclass
class Engine:
    kind: str
    dims: int
    parts: dict[str, Part]
    waiting: dict[tuple, list[dict]] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> Engine:
        """From GeoJSON; raises InvalidGeometry or UnsupportedGeometry."""
        return cls.of(geojson.parse(text))

    @classmethod
    def of(cls, s: Shape) -> Engine:
        """From a parsed shape."""
        parts = {}
        for p, rings in enumerate(s.parts):
            made = {f"ring:{p}:{r}": Ring(r, None, part_type(s.type) == "Polygon" and r == 0, _chain([f"init:{r}:{k}" for k in range(len(c))], c)) for r, c in enumerate(rings)}
            parts[f"part:{p}"] = Part(p, None, made)
        return cls(s.type, s.dims, parts)

    @property
    def multi(self) -> bool:
        return self.kind.startswith("Multi")

    @property
    def part_kind(self) -> str:
        return part_type(self.kind)

    # --- remote edits ---

    def put(self, op: dict) -> list[tuple[dict, Result]]:
        """Apply an edit and then, repeatedly, what waited for what it made; each with its result, the edit first."""
        out, queue = [], deque([op])
        while queue:
            edit = queue.popleft()
            result = self._try(edit)
            out.append((edit, result))
            if result.waits_for is not None:
                self.waiting.setdefault(result.waits_for, []).append(edit)
            elif result.outcome == APPLIED:
                for made in self._makes(edit):
                    queue.extend(self.waiting.pop(made, ()))
        return out

    def _makes(self, op: dict) -> list[tuple]:
        """What an applied edit has brought into being, as keys that others may wait for."""
        tag = f"{op['site_id']}:{op['seq']}"
        action = op["action"]
        if action == "insert_vertex":
            return [(op["part_id"], op["ring_id"], f"op:{tag}")]
        if action == "add_ring":
            part, ring = op["part_id"], f"ring:{tag}"
            return [(part, ring), *((part, ring, v) for v in self.parts[part].rings[ring].vertices)]
        if action == "add_part":
            part = f"part:{tag}"
            rings = self.parts[part].rings
            return [(part,), *((part, r) for r in rings), *((part, r, v) for r, x in rings.items() for v in x.vertices)]
        return []

    def _part(self, op: dict) -> Part | Result:
        part = self.parts.get(op["part_id"])
        if part is not None:
            return part
        return Result(BUFFERED, waits_for=(op["part_id"],)) if self.multi else _no(f"no part {op['part_id']!r}")

    def _ring(self, part: Part, op: dict) -> Ring | Result:
        ring = part.rings.get(op["ring_id"])
        if ring is not None:
            return ring
        return Result(BUFFERED, waits_for=(op["part_id"], op["ring_id"])) if self.part_kind == "Polygon" else _no(f"no ring {op['ring_id']!r}")

    def _coord_error(self, coord: Any) -> str:
        if coord is None or len(coord) != self.dims:
            return "coordinate layout doesn't match the geometry"
        return "" if all(v is not None and math.isfinite(v) for v in coord) else "coordinate values must be finite"

    def _try(self, op: dict) -> Result:
        return getattr(self, f"_on_{op['action']}", lambda _: _no(f"unknown action {op['action']!r}"))(op)

    def _vertex_target(self, op: dict) -> Ring | Result:
        part = self._part(op)
        if isinstance(part, Result):
            return part
        ring = self._ring(part, op)
        if isinstance(ring, Ring) and self.part_kind == "Point" and op["action"] != "move_vertex":
            return _no("points can only be moved")
        return ring

    def _on_insert_vertex(self, op: dict) -> Result:
        ring = self._vertex_target(op)
        if isinstance(ring, Result):
            return ring
        own, after = f"op:{op['site_id']}:{op['seq']}", op["after_vertex_id"] or None
        if own in ring.vertices:
            return _AGAIN
        if error := self._coord_error(op["coord"]):
            return _no(error)
        if after is not None and after not in ring.vertices:
            return Result(BUFFERED, waits_for=(op["part_id"], op["ring_id"], after))
        ring.vertices[own] = Vertex(tuple(op["coord"]), after=after, made=stamp_of(op))
        return _DONE

    def _on_move_vertex(self, op: dict) -> Result:
        ring = self._vertex_target(op)
        if isinstance(ring, Result):
            return ring
        if error := self._coord_error(op["coord"]):
            return _no(error)
        vertex = ring.vertices.get(op["vertex_id"])
        if vertex is None:
            return Result(BUFFERED, waits_for=(op["part_id"], op["ring_id"], op["vertex_id"]))
        if vertex.moved is not None and stamp_of(op) <= vertex.moved:
            return _OLD
        vertex.coord, vertex.moved = tuple(op["coord"]), stamp_of(op)
        return _DONE

    def _on_delete_vertex(self, op: dict) -> Result:
        ring = self._vertex_target(op)
        if isinstance(ring, Result):
            return ring
        vertex = ring.vertices.get(op["vertex_id"])
        if vertex is None:
            return Result(BUFFERED, waits_for=(op["part_id"], op["ring_id"], op["vertex_id"]))
        if vertex.deleted:
            return _AGAIN
        vertex.deleted = True
        return _DONE

    def _ring_coords(self, op: dict) -> list[Position] | str:
        """Open coordinates of a new ring, or what is wrong with them."""
        try:
            coords = [geojson.position(list(p)) for p in op["ring"] or ()]
        except (InvalidGeometry, TypeError) as e:
            return str(e)
        if any(len(c) != self.dims for c in coords) or (not coords and self.dims != 2):
            return "ring layout doesn't match the geometry"
        coords = open_ring(coords)
        return coords if distinct_xy(coords) >= 3 else "a ring has at least 3 distinct positions"

    def _on_add_ring(self, op: dict) -> Result:
        part = self._part(op)
        if isinstance(part, Result):
            return part
        if self.part_kind != "Polygon":
            return _no("only polygons hold rings")
        tag = f"{op['site_id']}:{op['seq']}"
        if f"ring:{tag}" in part.rings:
            return _AGAIN
        coords = self._ring_coords(op)
        if isinstance(coords, str):
            return _no(coords)
        part.rings[f"ring:{tag}"] = Ring(None, stamp_of(op), False, _chain([f"v:{tag}:{k}" for k in range(len(coords))], coords))
        return _DONE

    def _on_remove_ring(self, op: dict) -> Result:
        part = self._part(op)
        if isinstance(part, Result):
            return part
        ring = self._ring(part, op)
        if isinstance(ring, Result):
            return ring
        if ring.exterior:
            return _no("the exterior ring can't be removed")
        if ring.deleted:
            return _AGAIN
        ring.deleted = True
        return _DONE

    def _new_part(self, op: dict) -> Shape | str:
        try:
            s = geojson.parse(op["part"] or "")
        except (InvalidGeometry, UnsupportedGeometry) as e:
            return str(e)
        if s.type != self.part_kind:
            return f"{self.kind} takes {self.part_kind} parts"
        return s if s.dims == self.dims else "part layout doesn't match the geometry"

    def _on_add_part(self, op: dict) -> Result:
        if not self.multi:
            return _no("a simple geometry takes no parts")
        tag = f"{op['site_id']}:{op['seq']}"
        if f"part:{tag}" in self.parts:
            return _AGAIN
        s = self._new_part(op)
        if isinstance(s, str):
            return _no(s)
        rings = {f"ring:{tag}:{r}": Ring(r, None, self.part_kind == "Polygon" and r == 0, _chain([f"v:{tag}:{r}:{k}" for k in range(len(c))], c)) for r, c in enumerate(s.parts[0])}
        self.parts[f"part:{tag}"] = Part(None, stamp_of(op), rings)
        return _DONE

    def _on_remove_part(self, op: dict) -> Result:
        if not self.multi:
            return _no("a simple geometry keeps its part")
        part = self._part(op)
        if isinstance(part, Result):
            return part
        if part.deleted:
            return _AGAIN
        part.deleted = True
        return _DONE

    def place(self, part_id: str, ring_id: str, vertex_id: str, coord: list[float]) -> None:
        """Give a vertex, if it exists, the position of its newest valid move; order doesn't matter then."""
        part = self.parts.get(part_id)
        ring = part.rings.get(ring_id) if part else None
        vertex = ring.vertices.get(vertex_id) if ring else None
        if vertex is not None and len(coord) == self.dims:
            vertex.coord = tuple(coord)

    # --- local edits, checked strictly ---

    def require(self, op: dict) -> None:
        """Raise InvalidCommand unless a local edit fits the geometry as it is."""

        def check(good: Any, reason: str) -> None:
            if not good:
                raise InvalidCommand(reason)

        action = op["action"]
        if action in ("add_part", "remove_part"):
            check(self.multi, f"{self.kind} has one part only")
        if action == "add_part":
            s = self._new_part(op)
            check(not isinstance(s, str), str(s))
            return
        part = self.parts.get(op["part_id"])
        check(part is not None, f"no part {op['part_id']!r}")
        if action == "remove_part":
            check(not part.deleted, "the part is deleted")
            return
        if action == "add_ring":
            check(self.part_kind == "Polygon", "only polygons hold rings")
            coords = self._ring_coords(op)
            check(not isinstance(coords, str), str(coords))
            return
        ring = part.rings.get(op["ring_id"])
        check(ring is not None, f"no ring {op['ring_id']!r}")
        if action == "remove_ring":
            check(not ring.exterior, "the exterior ring can't be removed")
            check(not ring.deleted, "the ring is deleted")
            return
        check(not part.deleted and not ring.deleted, "the part or ring is deleted")
        check(self.part_kind != "Point" or action == "move_vertex", "points can only be moved")
        if action == "insert_vertex":
            check(not op["after_vertex_id"] or op["after_vertex_id"] in ring.vertices, f"no vertex {op['after_vertex_id']!r}")
        else:
            vertex = ring.vertices.get(op["vertex_id"])
            check(vertex is not None, f"no vertex {op['vertex_id']!r}")
            check(not vertex.deleted, "the vertex is deleted")
        if action == "delete_vertex":
            floor = 3 if self.part_kind == "Polygon" else 2
            check(sum(not v.deleted for v in ring.vertices.values()) > floor, f"a {self.part_kind} keeps {floor} vertices")
        else:
            check(not (error := self._coord_error(op["coord"])), error)

    # --- reads ---

    def order(self, ring: Ring) -> list[str]:
        """Vertex ids in document order, tombstones included."""
        ids = list(ring.vertices)
        v = list(ring.vertices.values())
        if all([x.after is None and x.made is None for x in v]):
            return sorted(ids, key=lambda i: ring.vertices[i].pos)
        rows = document_order(ids, [x.after for x in v], [x.pos for x in v], [x.made for x in v])
        return [ids[r] for r in rows]

    def in_order(self) -> list[tuple[str, Part, list[tuple[str, Ring]]]]:
        """Parts with their rings, in order, deleted ones included."""
        return [(p, part, sorted(part.rings.items(), key=_set_order)) for p, part in sorted(self.parts.items(), key=_set_order)]

    def visible(self, ring: Ring) -> list[tuple[str, Position]]:
        return [(v, ring.vertices[v].coord) for v in self.order(ring) if not ring.vertices[v].deleted]

    def info(self) -> list[dict]:
        """Visible structure: parts with id and rings, rings with id, exterior and vertices (id, coord)."""
        return [
            {"id": p, "type": self.part_kind, "rings": [{"id": r, "exterior": ring.exterior, "vertices": self.visible(ring)} for r, ring in rings if not ring.deleted]}
            for p, part, rings in self.in_order()
            if not part.deleted
        ]

    def vertex_at(self, part_id: str, ring_id: str, index: int) -> str:
        """Id of the visible vertex at an index; deleted parts and rings answer too."""
        part = self.parts.get(part_id)
        ring = part.rings.get(ring_id) if part else None
        if ring is None:
            raise InvalidCommand(f"no ring {part_id!r}/{ring_id!r}")
        seen = self.visible(ring)
        if not 0 <= index < len(seen):
            raise InvalidCommand(f"index {index} is out of range")
        return seen[index][0]

    def geojson(self) -> str:
        """Exported GeoJSON. A removed ring of a point or line hides it from info() only: the part is nothing without it."""
        shown = lambda ring: self.part_kind != "Polygon" or not ring.deleted
        nested = [[[c for _, c in self.visible(ring)] for _, ring in rings if shown(ring)] for _, part, rings in self.in_order() if not part.deleted or not self.multi]
        return geojson.export(Shape(self.kind, self.dims, nested))

    def pending(self) -> list[dict]:
        """Edits that wait, by stamp."""
        return sorted((op for ops in self.waiting.values() for op in ops), key=stamp_of)


def stamp_of(op: dict) -> Stamp:
    """The total order of operations; sites compare bytewise."""
    return (op["ts"], op["site_id"].encode("utf-8", "surrogatepass"), op["seq"])
