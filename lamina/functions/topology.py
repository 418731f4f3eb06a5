"""Polygon validity and repair.

Ring arithmetic is Spark higher-order functions (area, duplicates, closing, orientation,
degeneracy). Full polygon validity is an Arrow function over a small exact kernel.
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.errors import InvalidTopology
from lamina.functions import geojson
from lamina.functions.canon import loads

#: Repairs as bits. Fixed values of the interface.
CLOSE_RINGS, NORMALIZE_ORIENTATION, REMOVE_DUPLICATES, DROP_DEGENERATE = 2, 4, 8, 16
BASIC = CLOSE_RINGS | NORMALIZE_ORIENTATION | REMOVE_DUPLICATES | DROP_DEGENERATE

# --- rings as ARRAY<ARRAY<DOUBLE>> columns ---


def same_xy(a: Column, b: Column) -> Column:
    """Equal in the plane."""
    return (a[0] == b[0]) & (a[1] == b[1])


def signed_area(ring: Column) -> Column:
    """Shoelace area over XY, positive counter-clockwise; 0 for fewer than three positions."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    terms = F.zip_with(ring, after, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / 2)


def without_duplicates(ring: Column) -> Column:
    """Without positions that repeat the one before in XY."""
    return F.filter(ring, lambda p, i: (i == 0) | ~same_xy(p, F.get(ring, i - 1)))


def closed(ring: Column) -> Column:
    """With the first position at the end, unless it's there already or the ring has fewer than three positions."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.when((F.size(ring) < 3) | same_xy(first, last), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))


def reversed_ring(ring: Column) -> Column:
    """In the other direction; a closed ring stays closed and begins with its last position before closing."""
    shut = same_xy(F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)) & (F.size(ring) >= 2)
    body = F.reverse(F.slice(ring, 1, F.size(ring) - 1))
    return F.when(shut, F.concat(body, F.slice(body, 1, 1))).otherwise(F.reverse(ring))


def oriented(ring: Column, exterior: Column) -> Column:
    """Exterior rings counter-clockwise, others clockwise."""
    area = signed_area(ring)
    wrong = F.when(exterior, area < 0).otherwise(area > 0)
    return F.when((F.size(ring) >= 3) & wrong, reversed_ring(ring)).otherwise(ring)


def degenerate(ring: Column) -> Column:
    """Fewer than three positions once repeats and the closing one are gone."""
    kept = without_duplicates(ring)
    shut = (F.size(kept) >= 2) & same_xy(F.get(kept, F.lit(0)), F.get(kept, F.size(kept) - 1))
    return F.size(kept) - F.when(shut, 1).otherwise(0) < 3


# --- the same over Python lists, for whole geometries ---

Ring = list[Any]


def area(ring: Ring) -> float:
    n = len(ring)
    return 0.0 if n < 3 else sum(ring[i][0] * ring[(i + 1) % n][1] - ring[(i + 1) % n][0] * ring[i][1] for i in range(n)) / 2


def _same(a: Any, b: Any) -> bool:
    return a[0] == b[0] and a[1] == b[1]


def repair_ring(ring: Ring, exterior: bool, mask: int) -> Ring | None:
    """Duplicates, closing, orientation, degeneracy, in this order; None for a dropped ring."""
    if mask & REMOVE_DUPLICATES:
        ring = [p for i, p in enumerate(ring) if not i or not _same(p, ring[i - 1])]
    if mask & CLOSE_RINGS and len(ring) >= 3 and not _same(ring[0], ring[-1]):
        ring = [*ring, ring[0]]
    if mask & NORMALIZE_ORIENTATION and len(ring) >= 3 and (area(ring) < 0 if exterior else area(ring) > 0):
        ring = [*ring[-2::-1], ring[-2]] if _same(ring[0], ring[-1]) else ring[::-1]
    if mask & DROP_DEGENERATE:
        kept = [p for i, p in enumerate(ring) if not i or not _same(p, ring[i - 1])]
        if len(kept) - (len(kept) >= 2 and _same(kept[0], kept[-1])) < 3:
            return None
    return ring


def repair_rings(rings: list[Ring], mask: int) -> list[Ring]:
    """Repaired rings; a dropped exterior drops the polygon."""
    out = []
    for i, ring in enumerate(rings):
        fixed = repair_ring(ring, i == 0, mask)
        if fixed is None:
            if i == 0:
                return []
            continue
        out.append(fixed)
    return out


def _turn(a: Any, b: Any, c: Any) -> int:
    """Sign of the turn a → b → c, exact."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > 1e-14 * (abs(left) + abs(right)) and math.isfinite(det):
        return 1 if det > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (a[0], a[1], b[0], b[1], c[0], c[1]))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def _on(a: Any, b: Any, p: Any) -> bool:
    """Whether p, known to be in line with a and b, lies between them."""
    return min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def _meet(a: Any, b: Any, c: Any, d: Any) -> tuple[str, Any] | None:
    """How segments ab and cd meet: ("cross", None), ("overlap", None), ("touch", point) or None."""
    if max(a[0], b[0]) < min(c[0], d[0]) or max(c[0], d[0]) < min(a[0], b[0]) or max(a[1], b[1]) < min(c[1], d[1]) or max(c[1], d[1]) < min(a[1], b[1]):
        return None
    t1, t2, t3, t4 = _turn(a, b, c), _turn(a, b, d), _turn(c, d, a), _turn(c, d, b)
    if not (t1 or t2 or t3 or t4):
        shared = {(p[0], p[1]) for p in (c, d) if _on(a, b, p)} | {(p[0], p[1]) for p in (a, b) if _on(c, d, p)}
        return None if not shared else ("overlap", None) if len(shared) > 1 else ("touch", shared.pop())
    if t1 * t2 < 0 and t3 * t4 < 0:
        return "cross", None
    for turn, p, u, v in ((t1, c, a, b), (t2, d, a, b), (t3, a, c, d), (t4, b, c, d)):
        if not turn and _on(u, v, p):
            return "touch", (p[0], p[1])
    return None


def _segments(ring: Ring) -> list[tuple[Any, Any]]:
    return [(ring[i], ring[i + 1]) for i in range(len(ring) - 1) if not _same(ring[i], ring[i + 1])]


def _pairs(one: list[tuple[Any, Any]], other: list[tuple[Any, Any]] | None = None):
    """Pairs of segments whose extents in x overlap, by a sweep."""
    events = [(min(a[0], b[0]), max(a[0], b[0]), 0, i) for i, (a, b) in enumerate(one)]
    events += [(min(a[0], b[0]), max(a[0], b[0]), 1, i) for i, (a, b) in enumerate(other or ())]
    events.sort()
    live: list[list[tuple[float, int]]] = [[], []]
    for low, high, side, i in events:
        against = side if other is None else 1 - side
        live[against] = [x for x in live[against] if x[0] >= low]
        for _, j in live[against]:
            yield (i, j) if side == 0 else (j, i)
        live[side].append((high, i))


def _inside(ring: Ring, p: Any) -> int:
    """1 inside, 0 on the border, -1 outside."""
    odd = False
    for a, b in _segments(ring):
        turn = _turn(a, b, p)
        if not turn and _on(a, b, p):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and (turn > 0) == (b[1] > a[1]):
            odd = not odd
    return 1 if odd else -1


def _within(outer: Ring, inner: Ring) -> bool | None:
    """Whether a ring that doesn't cross another lies in it; None if all its positions are on the border."""
    for p in inner:
        if side := _inside(outer, p):
            return side > 0
    for a, b in _segments(inner):
        if side := _inside(outer, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)):
            return side > 0
    return None


def _simple(ring: Ring, name: str) -> None:
    segments = _segments(ring)
    n = len(segments)
    if n < 3:
        raise InvalidTopology(f"{name} has no area")
    for i, j in _pairs(segments):
        met = _meet(*segments[i], *segments[j])
        if met is None:
            continue
        apart = abs(i - j)
        if met[0] == "touch" and apart in (1, n - 1):
            continue
        raise InvalidTopology(f"{name} intersects itself")


def check_rings(rings: list[Ring]) -> None:
    """Raise InvalidTopology unless closed rings form a valid polygon.

    Each ring: four positions or more, one layout, finite, closed; exterior not clockwise, holes not
    counter-clockwise; simple. Together: rings neither cross nor share a line, holes lie in the exterior
    and not in one another, and touching points leave the interior in one piece.
    """
    if not rings:
        raise InvalidTopology("a polygon has at least one ring")
    layout = None
    for i, ring in enumerate(rings):
        name = f"interior ring {i}" if i else "exterior ring"
        if not isinstance(ring, list) or len(ring) < 4:
            raise InvalidTopology(f"{name} has fewer than 4 positions")
        for p in ring:
            if not isinstance(p, (list, tuple)) or len(p) not in (2, 3):
                raise InvalidTopology(f"{name} has a position without 2 or 3 values")
            layout = layout or len(p)
            if len(p) != layout:
                raise InvalidTopology("XY and XYZ positions are mixed")
            if not all(map(math.isfinite, p)):
                raise InvalidTopology(f"{name} has a position that isn't finite")
        if not _same(ring[0], ring[-1]):
            raise InvalidTopology(f"{name} isn't closed")
        turn = area(ring)
        if turn < 0 if i == 0 else turn > 0:
            raise InvalidTopology(f"{name} winds the wrong way")
    for i, ring in enumerate(rings):
        _simple(ring, f"interior ring {i}" if i else "exterior ring")
    joined = list(range(len(rings)))  # rings that touch, as a forest: a cycle would cut the interior

    def root(k: int) -> int:
        while joined[k] != k:
            k = joined[k]
        return k

    segments = [_segments(r) for r in rings]
    at: dict[Any, set[int]] = {}
    for i in range(len(rings)):
        for j in range(i + 1, len(rings)):
            for a, b in _pairs(segments[i], segments[j]):
                if met := _meet(*segments[i][a], *segments[j][b]):
                    if met[0] != "touch":
                        raise InvalidTopology(f"rings {i} and {j} cross or share a line")
                    at.setdefault(met[1], set()).update((i, j))
            inside = _within(rings[i], rings[j])
            if i == 0 and not inside:
                raise InvalidTopology(f"interior ring {j} isn't inside the exterior")
            if i and (inside or _within(rings[j], rings[i])):
                raise InvalidTopology(f"interior rings {i} and {j} are nested")
    for touching in at.values():
        first, *others = sorted(touching)
        for other in others:
            a, b = root(first), root(other)
            if a == b:
                raise InvalidTopology("touching rings cut the interior")
            joined[b] = a


def check_polygons(polygons: list[list[Ring]]) -> None:
    """Raise InvalidTopology unless each polygon is valid and no two share more than points."""
    for rings in polygons:
        check_rings(rings)
    segments = [[s for r in rings for s in _segments(r)] for rings in polygons]
    for i in range(len(polygons)):
        for j in range(i + 1, len(polygons)):
            for a, b in _pairs(segments[i], segments[j]):
                met = _meet(*segments[i][a], *segments[j][b])
                if met and met[0] != "touch":
                    raise InvalidTopology(f"polygons {i} and {j} overlap or share a line")
            for outer, inner in ((polygons[i], polygons[j]), (polygons[j], polygons[i])):
                if _within(outer[0], inner[0]) is not False and not any(_within(hole, inner[0]) for hole in outer[1:]):
                    raise InvalidTopology(f"polygons {i} and {j} overlap")


def problem(text: str | None) -> str | None:
    """Why an exported geometry is not valid; None if it is, or isn't polygonal, or is none."""
    if geojson.no_geometry(text):
        return None
    try:
        value = loads(text)
        kind = value.get("type") if isinstance(value, dict) else None
        if kind not in ("Polygon", "MultiPolygon"):
            return None
        floats = lambda v: [floats(x) for x in v] if isinstance(v, list) else float(v)
        coordinates = floats(value.get("coordinates") or [])
        if kind == "Polygon":
            check_rings(coordinates)
        else:
            check_polygons(coordinates)
    except (InvalidTopology, ValueError, TypeError) as e:
        return str(e) or type(e).__name__
    return None


def repaired(text: str | None, mask: int) -> str | None:
    """An exported geometry with repairs applied; others than polygons pass through."""
    if not mask or geojson.no_geometry(text):
        return text
    try:
        value = loads(text)
        kind = value.get("type") if isinstance(value, dict) else None
        if kind not in ("Polygon", "MultiPolygon"):
            return text
        floats = lambda v: [floats(x) for x in v] if isinstance(v, list) else float(v)
        coordinates = floats(value.get("coordinates") or [])
        if kind == "Polygon":
            fixed = repair_rings(coordinates, mask)
        else:
            fixed = [r for r in (repair_rings(rings, mask) for rings in coordinates) if r or not mask & DROP_DEGENERATE]
    except (ValueError, TypeError, IndexError):
        return text
    return f'{{"type":"{kind}","coordinates":{geojson.coordinates_text(fixed)}}}'


@F.arrow_udf(T.StringType())
def polygon_problem(texts: pa.Array) -> pa.Array:
    """problem() of each geometry text."""
    return pa.array([problem(t) for t in texts.to_pylist()], pa.string())


def polygon_repair(text: Column, mask: int = BASIC) -> Column:
    """repaired() of a geometry text column; mask 0 leaves it as it is."""
    if not mask:
        return text

    @F.arrow_udf(T.StringType())
    def fix(texts: pa.Array) -> pa.Array:
        return pa.array([repaired(t, mask) for t in texts.to_pylist()], pa.string())

    return fix(text)
