"""The document replica: edits, conflicts, waiting edits, deltas, snapshots, epochs; and wire format."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina import errors
from lamina.functions import geojson
from lamina.functions.canon import canonical, float_text, loads, write
from lamina.operators import replica as rp
from lamina.operators.replica import Replica
from lamina.operators.single import GeometryReplica
from lamina.operators.snapshots import violations
from lamina.sources import wire

KITE = '{"type":"Polygon","coordinates":[[[3,1],[8,2],[6,9],[-1,5],[3,1]]]}'
RING = ("part:0", "ring:0:0")


def pair():
    a, b = Replica("doc", "a"), Replica("doc", "b")
    a.insert_feature("f", KITE, {"owner": "Okoro"})
    b.merge(a)
    return a, b


def ring(r, feature="f"):
    return json.loads(r.feature(feature)[0])["coordinates"][0]


def test_concurrent_inserts_newest_first():
    a, b = pair()
    a.edit_geometry("f", rp.insert_vertex(*RING, "init:0:0", [1.0, 0.0]))
    b.edit_geometry("f", rp.insert_vertex(*RING, "init:0:0", [2.0, 0.0]))
    a.merge(b)
    b.merge(a)
    assert a.collection() == b.collection()
    assert ring(a) == [[3, 1], [2, 0], [1, 0], [8, 2], [6, 9], [-1, 5], [3, 1]]  # same ts, site b is newer
    assert a.vertex_at("f", *RING, 1) == "op:b:1"


def test_registers_follow_time_then_site_then_number():
    a, b = pair()
    a.set_property("f", "owner", "A")
    b.set_property("f", "owner", "B")
    b.edit_geometry("f", rp.move_vertex(*RING, "init:0:1", [11.0, 0.0]))
    a.edit_geometry("f", rp.delete_vertex(*RING, "init:0:1"))
    a.merge(b)
    b.merge(a)
    assert a.feature("f")[1]["owner"] == b.feature("f")[1]["owner"] == '"B"'
    assert len(ring(a)) == 4  # a tombstone beats any move


def test_delete_and_reinsert_keeps_old_properties():
    a, _ = pair()
    a.delete_feature("f")
    assert a.feature("f") is None
    with pytest.raises(errors.UnknownFeature):
        a.set_property("f", "x", 1)
    a.insert_feature("f", None, {"use": "meadow"})
    assert a.feature("f") == (None, {"owner": '"Okoro"', "use": '"meadow"'})


def test_edits_wait_for_generation_and_vertex():
    a, b = Replica("doc", "a"), Replica("doc", "b")
    a.insert_feature("f", KITE)
    a.edit_geometry("f", rp.insert_vertex(*RING, "init:0:0", [1.0, 0.0]))
    a.edit_geometry("f", rp.move_vertex(*RING, "op:a:2", [1.0, 1.0]))
    ins, edit, move = a.ops
    t = b.merge_ops("doc", [move])
    assert t.buffered == [("a", 3)] and b.vector_clock() == {}
    t = b.merge_ops("doc", [ins])
    assert t.applied == 1 and t.buffered == [("a", 3)]
    t = b.merge_ops("doc", [edit, edit])
    assert t.applied == 2 and t.duplicates == 1 and b.vector_clock() == {"a": 3}
    assert b.collection() == a.collection()


def test_what_can_never_apply_is_quarantined():
    a, b = Replica("doc", "a"), Replica("doc", "b")
    a.insert_feature("p", '{"type":"Point","coordinates":[1,2]}')
    gen = {"site_id": "a", "seq": 1}
    op = lambda seq, e, **k: dict(a.ops[0], type="edit_geometry", seq=seq, ts=seq, geometry=None, properties=None, gen=gen, geometry_op=e) | k
    ops = [a.ops[0], op(2, rp.delete_vertex(*RING, "init:0:0")), op(3, rp.move_vertex(*RING, "init:0:0", [1.0, 2.0, 3.0])), op(4, rp.add_ring("part:0", [[0.0, 0.0]])), op(5, rp.remove_part("part:0")), op(6, rp.move_vertex(*RING, "init:0:0", [3.0, 4.0]), gen=None), op(7, rp.move_vertex(*RING, "init:0:0", [3.0, 4.0]), feature_id="q")]
    t = b.merge_ops("doc", ops)
    assert t.applied == 1 and [r for r, _ in t.quarantined] == [("a", n) for n in range(2, 8)]


def test_envelopes_refuse_whole_batches():
    a, b = pair()
    good = dict(a.ops[0], seq=2, ts=2)
    for bad in (dict(good, site_id=" "), dict(good, seq=0), dict(good, ts=2**62), dict(good, feature_id=""), dict(good, type="x"), dict(good, geometry="{"), dict(good, type="edit_geometry"), dict(good, type="edit_geometry", geometry_op=rp.edit("insert_vertex", part_id="p", ring_id="r", vertex_id="op:x:9"))):
        with pytest.raises(errors.InvalidOp):
            b.merge_ops("doc", [dict(good, seq=3, ts=3), bad])
    assert len(b.ops) == 1
    with pytest.raises(errors.IdentityCollision):
        b.merge_ops("doc", [dict(a.ops[0], properties={"owner": '"Other"'})])
    assert b.merge_ops("doc", [dict(a.ops[0], properties={"owner": ' "Okoro"'})]).duplicates == 1
    with pytest.raises(errors.InvalidOp):
        b.merge_ops("doc", [dict(good, site_id="b", seq=5)])


def test_deltas_and_guards():
    a, b = pair()
    a.set_property("f", "n", 36028797018963969)
    d = a.delta_since(b.vector_clock())
    assert [o["seq"] for o in d["ops"]] == [2]
    for change, error in ((dict(version=2), errors.UnsupportedVersion), (dict(clock=1), errors.InvalidSyncState), (dict(document_id="x"), errors.DocumentMismatch), (dict(base_hash="x"), errors.BaseMismatch), (dict(vector_clock={"b": 7}), errors.InvalidSyncState), (dict(compacted={"a": 2}, vector_clock={"a": 2}), errors.CompactionGap)):
        with pytest.raises(error):
            b.merge_delta(d | change)
    again = wire.load(wire.dump(d, "delta"), "delta")
    assert b.merge_delta(again).applied == 1
    assert b.feature("f")[1]["n"] == "36028797018963969"
    ops, mark = a.pending_ops()
    assert (len(ops), mark) == (2, 2)
    with pytest.raises(errors.InvalidSyncState):
        a.mark_synced(3)
    a.mark_synced(2)
    assert a.pending_ops() == ([], 2)


def test_snapshot_restore_and_validation():
    a, b = pair()
    b.edit_geometry("f", rp.insert_vertex(*RING, "init:0:3", [0.0, 5.0]))
    b.edit_geometry("f", rp.add_ring("part:0", [[2.0, 2.0], [2.0, 4.0], [4.0, 4.0]]))
    b.delete_property("f", "owner")
    a.merge_ops("doc", [b.ops[3], b.ops[2]])  # 1 is missing: a gap
    snap = wire.load(wire.dump(a.snapshot("s"), "snapshot"), "snapshot")
    assert violations(snap) == []
    assert [o["seq"] for o in snap["retained_ops"]] == [2, 3] and snap["vector_clock"] == {"a": 1}
    r = Replica.restore("a", snap)
    assert r.collection() == a.collection() and r.local_seq == 1
    with pytest.raises(errors.InvalidSyncState):
        Replica.restore("b", snap)
    r.merge(b)
    a.merge(b)
    assert r.collection() == a.collection() == b.collection()
    r.set_property("f", "x", 1)
    assert r.ops[-1]["seq"] == 2
    full = b.snapshot("t")
    assert violations(full) == []
    broken = []
    for path, value in ((("version",), 2), (("applied",), {}), (("features", 0, "create_reg", "ts"), 99), (("features", 0, "geometry", "dims"), 4), (("features", 0, "geometry", "parts", 0, "rings", 0, "exterior"), False), (("features", 0, "geometry", "parts", 0, "rings", 0, "vertices", 0, "id"), "x"), (("outbox_ops",), [])):
        s = wire.load(wire.dump(full, "snapshot"), "snapshot")
        at = s
        for k in path[:-1]:
            at = at[k]
        at[path[-1]] = value
        broken.append(bool(violations(s)))
        with pytest.raises((errors.InvalidSnapshot, errors.UnsupportedVersion)):
            Replica.restore("c", s)
    assert all(broken)
    swapped = wire.load(wire.dump(full, "snapshot"), "snapshot")
    v = swapped["features"][0]["geometry"]["parts"][0]["rings"][0]["vertices"]
    v[3], v[4] = v[4], v[3]
    assert violations(swapped)


def test_single_geometries():
    spaced = KITE.replace(",", " , ").replace("8", "8.0")
    a, b = GeometryReplica("a", KITE), GeometryReplica(" b ", spaced)
    assert a.lineage == b.lineage and b.site_id == "b" and a.layout() == "XY"
    first = a.apply(rp.insert_vertex(*RING, "init:0:0", [4.0, 0.0]))
    second = a.apply(rp.move_vertex(*RING, first["vertex_id"], [4.5, 0.5]))
    assert first["vertex_id"] == "op:a:1" == a.vertex_at(*RING, 1) and (second["seq"], second["ts"]) == (2, 2)
    assert b.merge_ops([second]).buffered == [("a", 2)]  # it waits for its vertex
    assert b.merge_ops([first]).applied == 2 and b.merge(a).duplicates == 2 and b.geometry() == a.geometry()
    b.apply(rp.delete_vertex(*RING, "init:0:2"))
    a.merge(b)
    assert a.geometry() == b.geometry() == '{"type":"Polygon","coordinates":[[[3,1],[4.5,0.5],[8,2],[-1,5],[3,1]]]}'
    assert a.clock == b.clock == 3 and a.merge(a).duplicates == 0 and len(a.info()[0]["rings"][0]["vertices"]) == 4
    ops, mark = a.pending_ops()
    assert [o["seq"] for o in ops] == [1, 2]
    a.mark_synced(mark)
    assert a.pending_ops() == ([], 2)
    with pytest.raises(errors.InvalidSyncState):
        a.mark_synced(3)
    with pytest.raises(errors.InvalidSyncState):
        a.merge_ops([second | {"seq": 9}])  # its own name, but not its own history
    with pytest.raises(errors.IdentityCollision):
        b.merge_ops([second | {"coord": [0.0, 0.0]}])
    with pytest.raises(errors.InvalidCommand):
        a.apply(rp.remove_part("part:0"))
    with pytest.raises(errors.BaseMismatch):
        a.merge(GeometryReplica("c", '{"type":"Point","coordinates":[1,2]}'))
    for text in ("", "null", '{"type":"Point"}'):
        with pytest.raises(errors.InvalidGeometry):
            GeometryReplica("c", text)


def test_rebase():
    a, b = pair()
    for refuse in (lambda: a.rebase("doc", a.vector_clock(), "s"), lambda: a.rebase("new", {}, "s"), lambda: a.rebase("new", a.vector_clock(), "s")):
        with pytest.raises(errors.RebaseUnsafe):
            refuse()
    a.mark_synced(a.pending_ops()[1])
    shown = a.collection()
    receipt = a.rebase("new", {"a": 1}, "s")
    assert a.collection() == shown and a.clock == 0 and a.ops == [] and receipt["previous_document_id"] == "doc"
    c = Replica.restore("c", receipt["snapshot"])
    assert c.collection() == shown
    with pytest.raises(errors.DocumentMismatch):
        b.merge(a)


def test_local_commands_are_strict():
    a, _ = pair()
    for change in (rp.insert_vertex(*RING, "nope", [0.0, 0.0]), rp.move_vertex(*RING, "init:0:0", [0.0]), rp.delete_vertex("part:9", "ring:0:0", "init:0:0"), rp.remove_ring(*RING), rp.remove_part("part:0"), rp.add_part(KITE), rp.add_ring("part:0", [[0.0, 0.0], [1.0, 1.0]])):
        with pytest.raises(errors.InvalidCommand):
            a.edit_geometry("f", change)
    a.edit_geometry("f", rp.delete_vertex(*RING, "init:0:0"))
    with pytest.raises(errors.InvalidCommand):
        a.edit_geometry("f", rp.delete_vertex(*RING, "init:0:1"))  # a ring keeps three vertices
    with pytest.raises(errors.InvalidCommand):
        a.set_property("f", "x", float("nan"))
    assert a.local_seq == 2 and a.layout("f") == "XY"


def test_parts_of_multi_geometries():
    a, b = Replica("doc", "a"), Replica("doc", "b")
    a.insert_feature("m", '{"type":"MultiPoint","coordinates":[[1,2,3],[4,5,6]]}')
    b.merge(a)
    a.edit_geometry("m", rp.add_part('{"type":"Point","coordinates":[7,8,9]}'))
    b.edit_geometry("m", rp.add_part('{"type":"Point","coordinates":[0,0,0]}'))
    b.edit_geometry("m", rp.remove_part("part:0"))
    a.merge(b)
    b.merge(a)
    assert a.collection() == b.collection()
    assert a.feature("m")[0] == '{"type":"MultiPoint","coordinates":[[4,5,6],[7,8,9],[0,0,0]]}'
    assert [p["id"] for p in a.geometry_info("m")] == ["part:1", "part:a:2", "part:b:1"]


@pytest.mark.parametrize("seed", range(12))
def test_replicas_converge_whatever_the_order(seed):
    rng = random.Random(seed)
    base = [("base", KITE, {"k": "1"})]
    docs = [Replica("doc", s, base) for s in "abcd"[: rng.randint(2, 4)]]
    for _ in range(15):
        for r in docs:
            own = rng.choice(["base", "alpha", "beta"])
            try:
                act = rng.randrange(8)
                if act == 0:
                    r.insert_feature(own, rng.choice([KITE, '{"type":"LineString","coordinates":[[0,0],[5,5],[9,9]]}', None]), {"k": rng.random()})
                elif act == 1 and rng.random() < 0.4:
                    r.delete_feature(own)
                elif act == 2:
                    r.set_property(own, rng.choice("kxy"), rng.randint(0, 9))
                elif act == 3 and rng.random() < 0.5:
                    r.set_geometry(own, KITE)
                else:
                    info = r.geometry_info(own) or [None]
                    part = rng.choice(info)
                    held = rng.choice(part["rings"])
                    v = rng.choice(held["vertices"])[0]
                    at = [float(rng.randint(-9, 9)), float(rng.randint(-9, 9))]
                    change = rng.choice([rp.insert_vertex(part["id"], held["id"], v, at), rp.move_vertex(part["id"], held["id"], v, at), rp.delete_vertex(part["id"], held["id"], v), rp.add_ring(part["id"], [[1.0, 1.0], [2.0, 1.0], at])])
                    r.edit_geometry(own, change)
            except (errors.LaminaError, TypeError):
                pass
        if rng.random() < 0.3:
            x, y = rng.sample(docs, 2)
            x.merge(y)
    every = [op for r in docs for op in r.ops]
    for r in docs:
        rng.shuffle(every)
        cut = rng.randint(0, len(every))
        r.merge_ops("doc", every[:cut])
        r.merge_ops("doc", every[cut:])
        r.merge_ops("doc", rng.sample(every, len(every)))
    assert len({r.collection() for r in docs}) == 1
    snap = docs[0].snapshot("s")
    assert violations(snap) == []
    assert Replica.restore("z", snap).collection() == docs[1].collection()


def test_lineage_of_an_empty_document():
    # Fixed value of the wire format: the lineage hash of an empty document of this name.
    assert Replica("protocol-golden", "x").base_hash == "b22e8ba77763eecb370574e9d94dfa602649c93cda66600eeaa568de86b2879a"


def test_collections_in_and_out():
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7.50,"geometry":{"type":"Point","coordinates":[1.0,2e0]},"properties":{"n":73786976294838206465,"s":"<é>"}},{"type":"Feature","geometry":null,"properties":null}]}'
    r = Replica.from_collection("d", "s", text)
    assert r.collection() == '{"type":"FeatureCollection","features":[{"type":"Feature","id":"7.50","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"n":73786976294838206465,"s":"\\u003cé\\u003e"}},{"type":"Feature","id":"feature:1","geometry":null,"properties":{}}]}'
    for bad in ('{"type":"Feature"}', text.replace('"id":7.50', '"id":" "'), text.replace('"id":7.50', '"id":"feature:1"'), "["):
        with pytest.raises(errors.InvalidGeometry):
            geojson.features_of(bad)


@pytest.mark.parametrize("text", ['{"type":"Point","coordinates":[1]}', '{"type":"Point","coordinates":[1,2,3,4]}', '{"type":"LineString","coordinates":[[1,2]]}', '{"type":"LineString","coordinates":[[1,2],[1,2,3]]}', '{"type":"Polygon","coordinates":[]}', '{"type":"Polygon","coordinates":[[[0,0],[1,1],[0,0]]]}', '{"type":"GeometryCollection","geometries":[]}', '{"type":"Point","coordinates":[1e999,0]}', "[]", "{"])
def test_bad_geometries(text):
    with pytest.raises((errors.InvalidGeometry, errors.UnsupportedGeometry)):
        geojson.parse(text)


@settings(max_examples=200, deadline=None)
@given(st.floats(allow_nan=False, allow_infinity=False))
def test_float_text_reads_back(x):
    text = float_text(x)
    assert float(text) == x and not text.endswith(".0") and ("e" in text) == (x != 0 and not 1e-6 <= abs(x) < 1e21)


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda v: st.lists(v, max_size=4) | st.dictionaries(st.text(), v, max_size=4), max_leaves=12))
def test_canonical_text_ignores_spelling(value):
    a, b = json.dumps(value, ensure_ascii=True, indent=1), json.dumps(value, ensure_ascii=False, sort_keys=True)
    assert canonical(a) == canonical(b) == write(loads(a))
    assert canonical("1.50") != canonical("1.5")
