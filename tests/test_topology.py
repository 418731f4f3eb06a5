"""Polygon validity and repair: generated shapes against rules that can be counted out, and the columns against Python."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lamina import errors
from lamina.functions import topology as t


def star(rng, corners, centre=(0.0, 0.0), scale=1.0):
    """A closed ring whose corners go once around the centre, counter-clockwise: simple whatever the radii."""
    angles = [2 * math.pi * (k + 0.8 * rng.random()) / corners for k in range(corners)]
    ring = [[centre[0] + scale * r * math.cos(a), centre[1] + scale * r * math.sin(a)] for a, r in ((a, 1 + 4 * rng.random()) for a in angles)]
    return [*ring, ring[0]]


def box(x, y, w, h):
    return [[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]]


def diamond(x, y, r):
    """Clockwise, as a hole is."""
    return [[x, y + r], [x + r, y], [x, y - r], [x - r, y], [x, y + r]]


def valid(rings):
    try:
        t.check_rings(rings)
    except errors.InvalidTopology:
        return False
    return True


def crossing_free(ring):
    """Brute force: segments share nothing but the corner between neighbours. Integers, so that it is exact."""
    cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    between = lambda a, b, p: cross(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])
    sides = list(zip(ring, ring[1:]))  # noqa: B905
    for i, j in combinations(range(len(sides)), 2):
        (a, b), (c, d) = sides[i], sides[j]
        if j == i + 1 or (i == 0 and j == len(sides) - 1):
            corner = b if j == i + 1 else a
            others = [p for p in (a, b, c, d) if p != corner]
            if len(others) != 2 or between(a, b, others[1]) or between(c, d, others[0]):
                return False
        elif any(between(a, b, p) for p in (c, d)) or any(between(c, d, p) for p in (a, b)) or (cross(a, b, c) * cross(a, b, d) < 0 and cross(c, d, a) * cross(c, d, b) < 0):
            return False
    return True


@pytest.mark.parametrize("scale, centre", [(1.0, (0.0, 0.0)), (1e-5, (151.2, -33.8)), (250.0, (3.1e5, 6.2e6))])
def test_stars_are_valid_one_way_round_and_closed(scale, centre):
    rng = random.Random(5)
    for corners in (3, 4, 9, 40):
        ring = star(rng, corners, centre, scale)
        assert valid([ring]) and not valid([ring[::-1]]) and not valid([ring[:-1]]) and not valid([ring[:2] + ring[:1]])
    assert not valid([]) and not valid([[]])


def test_random_rings_agree_with_brute_force():
    rng, seen = random.Random(11), set()
    for _ in range(4000):
        n = rng.randint(3, 6)
        points = rng.sample([[x, y] for x in range(5) for y in range(5)], n)
        ring = [*points, points[0]]
        turn = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))  # noqa: B905
        want = turn > 0 and crossing_free(ring)
        assert valid([ring]) == want, ring
        seen.add((n, want))
    assert len(seen) == 8


def test_one_hole_may_touch_the_exterior_once():
    rng, seen = random.Random(3), set()
    for _ in range(500):
        w, h, r, x, y = rng.randint(2, 9), rng.randint(2, 9), rng.randint(1, 4), rng.randint(-2, 10), rng.randint(-2, 10)
        room = [x, w - x, y, h - y]
        want = min(room) >= r and sum(d == r for d in room) <= 1
        assert valid([box(0, 0, w, h), diamond(x, y, r)]) == want, (w, h, r, x, y)
        seen.add((want, sum(d == r for d in room)))
    assert {(True, 0), (True, 1), (False, 2)} <= seen
    assert not valid([box(0, 0, 9, 9), diamond(4, 4, 1)[::-1]])


def test_two_holes_stay_apart():
    """Diamonds are balls of the taxicab distance: they are apart from r + s on, share a side there unless their centres are in line."""
    rng, seen = random.Random(4), set()
    for _ in range(500):
        (x, y, r), (u, v, s) = ((rng.randint(20, 32), rng.randint(20, 32), rng.randint(1, 5)) for _ in range(2))
        distance = abs(x - u) + abs(y - v)
        want = distance > r + s or (distance == r + s and 0 in (x - u, y - v))
        assert valid([box(0, 0, 60, 60), diamond(x, y, r), diamond(u, v, s)]) == want, (x, y, r, u, v, s)
        seen.add((want, distance == r + s))
    assert len(seen) == 4
    ring_of_four = [diamond(10, 10, 2), diamond(14, 10, 2), diamond(14, 14, 2), diamond(10, 14, 2)]
    assert valid([box(0, 0, 60, 60), *ring_of_four[:3]])
    assert not valid([box(0, 0, 60, 60), *ring_of_four])  # what they enclose is cut off


def test_polygons_share_points_at_most():
    rng, seen = random.Random(6), set()
    for _ in range(500):
        (x, y, w, h), (u, v, a, b) = ((rng.randint(0, 6), rng.randint(0, 6), rng.randint(1, 5), rng.randint(1, 5)) for _ in range(2))
        over = min(x + w, u + a) - max(x, u), min(y + h, v + b) - max(y, v)
        want = min(over) < 0 or over == (0, 0)
        try:
            t.check_polygons([[box(x, y, w, h)], [box(u, v, a, b)]])
            got = True
        except errors.InvalidTopology:
            got = False
        assert got == want, (x, y, w, h, u, v, a, b)
        seen.add((want, over == (0, 0)))
    assert {(True, False), (True, True), (False, False)} <= seen
    t.check_polygons([[box(0, 0, 30, 30), diamond(12, 12, 9)], [box(10, 10, 3, 3)]])  # an island in a hole


@pytest.mark.parametrize("ring", [[[4], [9, 4], [9, 9], [4]], [[4, 4, 1], [9, 4], [9, 9, 1], [4, 4, 1]], [[4, 4], [math.inf, 4], [9, 9], [4, 4]], [[4, 4, 1, 1]] * 4, [4, 9, 9, 4]])
def test_odd_positions_are_named(ring):
    with pytest.raises(errors.InvalidTopology):
        t.check_rings([ring])


def soiled(rng, ring):
    """A ring turned, opened or with repeats, at random."""
    ring = ring[::-1] if rng.random() < 0.5 else ring
    ring = ring[:-1] if rng.random() < 0.5 else ring
    return [p for p in ring for _ in range(rng.choice((1, 1, 2, 3)))]


def test_basic_repairs_make_soiled_stars_valid():
    rng = random.Random(8)
    for _ in range(100):
        ring = star(rng, rng.randint(3, 12))
        hole = [[0.01 * x, 0.01 * y] for x, y in star(rng, 5)][::-1]
        fixed = t.repair_rings([soiled(rng, ring), soiled(rng, hole), [[0.2, 0.2]] * 5], t.BASIC)
        assert [{tuple(p) for p in r} for r in fixed] == [{tuple(p) for p in r} for r in (ring, hole)]
        assert all(len(r) == len(want) for r, want in zip(fixed, (ring, hole), strict=True))
        if min(math.hypot(*p) for p in ring) > 0.1 and len(ring) > 5:
            assert valid(fixed)


def test_each_repair_alone():
    rng = random.Random(9)
    for _ in range(100):
        ring = soiled(rng, star(rng, 6))
        assert t.repair_rings([ring], 0) == [ring]
        (thin,) = t.repair_rings([ring], t.REMOVE_DUPLICATES)
        assert {tuple(p) for p in thin} == {tuple(p) for p in ring} and all(p != q for p, q in zip(thin, thin[1:]))  # noqa: B905
        (shut,) = t.repair_rings([ring], t.CLOSE_RINGS)
        assert shut[0] == shut[-1] and shut[: len(ring)] == ring
        (turned,) = t.repair_rings([ring], t.NORMALIZE_ORIENTATION)
        assert t.area(turned) > 0 and sorted(turned) == sorted(ring if turned[0] != turned[-1] or ring[0] == turned[0] else [*ring[:-1], turned[0]])
        assert t.repair_rings([ring], t.DROP_DEGENERATE) == [ring] and t.repair_rings([ring[:1] * 4], t.DROP_DEGENERATE) == []
    assert (t.CLOSE_RINGS, t.NORMALIZE_ORIENTATION, t.REMOVE_DUPLICATES, t.DROP_DEGENERATE, t.BASIC) == (2, 4, 8, 16, 30)


def test_texts():
    dirty = '{"type":"MultiPolygon","coordinates":[[[[3,1],[3,8],[7,8],[7,8]]],[[[2,2],[6,6],[2,2]]]]}'
    clean = t.repaired(dirty, t.BASIC)
    assert clean == '{"type":"MultiPolygon","coordinates":[[[[7,8],[3,8],[3,1],[7,8]]]]}'
    assert t.problem(clean) is None and t.problem(dirty)
    assert t.problem('{"type":"Polygon","coordinates":[]}') and t.problem('{"type":"Polygon","coordinates":[7]}')
    assert t.problem(None) is None and t.problem('{"type":"Point","coordinates":[3,1]}') is None
    assert t.repaired("null", t.BASIC) == "null" and t.repaired(dirty, 0) == dirty


def test_columns_agree_with_python(spark):
    rng = random.Random(10)
    rings = [soiled(rng, star(rng, rng.randint(3, 8))) for _ in range(40)] + [[], [[1.0, 2.0]], [[1.0, 2.0]] * 3, [[1.0, 2.0], [4.0, 2.0]], [[1.0, 2.0], [4.0, 2.0], [1.0, 2.0]]]
    df = spark.createDataFrame(list(enumerate(rings)), "i int, r array<array<double>>")
    c = F.col("r")
    got = df.select("i", t.signed_area(c), t.without_duplicates(c), t.closed(c), t.oriented(c, F.lit(True)), t.oriented(c, F.lit(False)), t.degenerate(c)).collect()
    for i, area, thin, shut, left, right, flat in got:
        r = rings[i]
        assert area == pytest.approx(t.area(r))
        assert [thin, shut, left, right] == [t.repair_ring(r, True, t.REMOVE_DUPLICATES), t.repair_ring(r, True, t.CLOSE_RINGS), t.repair_ring(r, True, t.NORMALIZE_ORIENTATION), t.repair_ring(r, False, t.NORMALIZE_ORIENTATION)]
        assert flat == (t.repair_ring(r, False, t.DROP_DEGENERATE) is None)
