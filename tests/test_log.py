"""The log's operators: against SQL, against the document replica, and on edge cases."""

import json
import random

import pandas as pd
import pytest
from compare import spark_rows, sql_rows, views
from pyspark.sql import functions as F
from test_problems import EDIT, T0, frame, message

from lamina import errors
from lamina.functions import geojson
from lamina.operators import clocks, envelope, export, outcomes, replica, state
from lamina.operators import geometry as geo
from lamina.operators.messages import first_deliveries
from lamina.plans import log, log_sql
from lamina.schemas import ACTIONS, BASE_DDL
from lamina.sources import wire
from lamina.sources.stores import OpStore, SnapshotStore
from lamina.streaming import edits
from lamina.streaming import merge as live


@pytest.fixture(scope="module")
def sf():
    """Large enough for every action on every geometry type to occur."""
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    """Element tables of one folder are the same for every query: their checkpoints are made once."""
    make, kept = log._tables, {}
    log._tables = lambda spark, sf: kept.get(sf) or kept.setdefault(sf, make(spark, sf))
    yield
    log._tables = make


@pytest.mark.parametrize("name", sorted(log_sql.SQL))
def test_sql(spark, sf, name):
    assert spark_rows(getattr(log, name)(spark, sf)) == sql_rows(views(sf), log_sql.SQL[name])


@pytest.fixture(scope="module")
def replicas(spark, sf):
    """Each document's log merged by the replica: (replica, tally)."""
    ops, bases = {}, {}
    for row in first_deliveries(spark.read.parquet(f"{sf}/op_messages.parquet")).collect():
        op = row.asDict(recursive=True)
        ops.setdefault(op.pop("document_id"), []).append(op)
    for row in spark.read.parquet(f"{sf}/base_features.parquet").dropDuplicates(["document_id", "feature_id"]).collect():
        bases.setdefault(row.document_id, []).append((row.feature_id, row.geometry, row.properties))
    out = {}
    for document in {*ops, *bases}:
        r = replica.Replica(document, "reader", bases.get(document, []))
        out[document] = r, r.merge_ops(document, ops.get(document, []))
    return out


def test_tables_agree_with_replicas(spark, sf, replicas):
    got = {r.document_id: r.collection for r in log.export_feature_collection(spark, sf).collect()}
    assert got == {d: r.collection() for d, (r, _) in replicas.items() if r.visible_ids()}


def test_fold_agrees_with_tables(spark, sf):
    assert spark_rows(log.export_geometry(spark, sf)) == spark_rows(log.geometry_from_tables(spark, sf))


SHAPES = {
    "Point": "[3,1]", "LineString": "[[3,1],[8,2],[6,9]]", "Polygon": "[[[0,0],[30,0],[30,30],[0,0]],[[9,5],[20,9],[12,5],[9,5]]]",
    "MultiPoint": "[[3,1],[4,4]]", "MultiLineString": "[[[3,1],[8,2]],[[6,9],[7,7]]]", "MultiPolygon": "[[[[0,0],[30,0],[30,30],[0,0]],[[9,5],[20,9],[12,5],[9,5]]],[[[50,50],[60,50],[60,60],[50,50]]]]",
}


def test_state_advances_in_any_steps(spark, sf, replicas):
    """The state table in three merges of a shuffled log, overlapping, gives what each replica's snapshot holds."""
    ops, base = log._log(spark, sf), log._base(spark, sf)
    third = F.pmod(F.xxhash64("site_id", "seq"), F.lit(3))
    now = state.of_base(base)
    for steps in ([0], [2], [1, 2]):
        now = state.advance(now, ops.where(third.isin(steps)))
    rows = now.where("document_id <> 'shared-base-map'").collect()
    got, waiting = {}, {}
    for r in rows:
        if r.feature is not None:
            got.setdefault(r.document_id, {})[r.feature_id] = r.feature.asDict(recursive=True)
        waiting.setdefault(r.document_id, set()).update((p.site_id, p.seq) for p in r.pending)
    for document in list(got)[::4]:
        snap = replicas[document][0].snapshot("s")
        assert got[document] == {f["id"]: f for f in snap["features"]}, document
        assert {(p["site_id"], p["seq"]) for p in snap["pending_ops"]} <= waiting[document]


def test_refusals(spark):
    good = dict(batch_id=1, version=3, document_id="d", site_id="t", base_hash="h", clock=9, vector_clock={"t": 4}, compacted=None)
    changes = [{}, dict(version=1), dict(document_id="x"), dict(base_hash="y"), dict(batch_id=5), dict(compacted={"t": 3}), dict(compacted={"t": 2})]
    deltas = spark.createDataFrame([good | dict(batch_id=i) | c for i, c in enumerate(changes, 1)], "batch_id bigint, version int, document_id string, site_id string, base_hash string, clock bigint, vector_clock map<string,bigint>, compacted map<string,bigint>")
    rows = frame(spark, [message(3, batch_id=5, site_id="me"), message(2, batch_id=7, site_id="me")])
    heads = spark.createDataFrame([("d", "h")], "document_id string, base_hash string")
    known = spark.createDataFrame([("d", "t", 2, 2), ("d", "me", 2, 2)], "document_id string, site_id string, frontier bigint, highest bigint")
    got = {r.batch_id: r.refused for r in state.refusals(deltas, rows, heads, known, "me").collect()}
    assert got == {1: None, 2: "unsupported version", 3: "DocumentMismatch", 4: "BaseMismatch", 5: "InvalidOp", 6: "CompactionGap", 7: None}


def test_every_action_on_every_type(spark):
    """Fold, tables and replica agree on random edits, fitting or not, of all six types."""
    rng, rows, n = random.Random(12), [], 0
    for kind, coordinates in SHAPES.items():
        for copy in range(4):
            feature, n = f"{kind}{copy}", n + 1
            gen, parts, rings = dict(site_id="s", seq=n), ["part:0", "part:1", "part:9"], ["ring:0:0", "ring:0:1", "ring:1:0"]
            rows.append(message(n, type="insert_feature", feature_id=feature, geometry=f'{{"type":"{kind}","coordinates":{coordinates}}}'))
            vertices = [f"init:{r}:{k}" for r in (0, 1) for k in range(3)]
            for _ in range(40):
                n += 1
                action, part, ring, at = rng.choice(ACTIONS), rng.choice(parts), rng.choice(rings), [float(rng.randint(0, 40)) for _ in range(rng.choice([2, 2, 2, 3]))]
                e = EDIT | dict(action=action, part_id=None if action == "add_part" else part)
                if action in ("insert_vertex", "move_vertex", "delete_vertex", "remove_ring"):
                    e |= dict(ring_id=ring)
                if action == "insert_vertex":
                    e |= dict(after_vertex_id=rng.choice([None, *vertices]), coord=at)
                    vertices.append(f"op:s:{n}")
                elif action in ("move_vertex", "delete_vertex"):
                    e |= dict(vertex_id=rng.choice(vertices), coord=at if action == "move_vertex" else None)
                elif action == "add_ring":
                    e |= dict(ring=rng.choice([[at, [1.0, 2.0], [2.0, 1.0], at], [at, at]]))
                    rings.append(f"ring:s:{n}")
                    vertices.append(f"v:s:{n}:0")
                elif action == "add_part":
                    single = kind.removeprefix("Multi")
                    e |= dict(part=f'{{"type":"{rng.choice([single, "Point"])}","coordinates":{SHAPES[single]}}}')
                    parts.append(f"part:s:{n}")
                    rings.append(f"ring:s:{n}:0")
                    vertices.append(f"v:s:{n}:0:1")
                rows.append(message(n, type="edit_geometry", feature_id=feature, gen=gen, geometry_op=e))
    rng.shuffle(rows)
    frames = first_deliveries(frame(spark, rows)), frame(spark, [], BASE_DDL)
    fold = {r.feature_id: r.geometry for r in export.geometries(*frames).collect()}
    tables = {r.feature_id: r.geometry for r in geo.geometries(geo.Tables(*frames)).collect()}
    r = replica.Replica("d", "reader")
    r.merge_ops("d", rows)
    assert fold == tables == {f: r.feature(f)[0] for f in r.visible_ids()} and len(fold) == 24
    seen = {(x.feature_id, x.part_id, x.ring_id, x.vertex_id) for x in geo.visible_vertices(geo.Tables(*frames)).collect()}
    assert seen == {(f, p["id"], g["id"], v) for f in r.visible_ids() for p in r.geometry_info(f) for g in p["rings"] for v, _ in g["vertices"]}


def test_stream_of_edits_waits_and_releases(spark, tmp_path):
    """Edits arrive before their generation, ring and vertex, in separate micro-batches; each is settled once."""
    gen, kite = dict(site_id="s", seq=1), '{"type":"Polygon","coordinates":[[[3,1],[8,2],[6,9],[-1,5],[3,1]]]}'
    edit = lambda n, action, **f: message(n, type="edit_geometry", gen=gen, geometry_op=EDIT | dict(action=action, part_id="part:0") | f)
    ring = edit(2, "add_ring", ring=[[4.0, 3.0], [4.0, 4.0], [5.0, 4.0]])
    insert = edit(3, "insert_vertex", ring_id="ring:s:2", after_vertex_id="v:s:2:0", coord=[4.0, 3.5])
    move = edit(4, "move_vertex", ring_id="ring:s:2", vertex_id="op:s:3", coord=[4.1, 3.5])
    based = message(5, type="edit_geometry", feature_id="old", geometry_op=EDIT | dict(action="move_vertex", part_id="part:0", ring_id="ring:0:0", vertex_id="init:0:0", coord=[9.0, 9.0]))
    base = frame(spark, [("d", "old", '{"type":"Point","coordinates":[1,2]}', None), ("d", "still", '{"type":"Point","coordinates":[5.0,6]}', None), ("d", "odd", "{", None)], BASE_DDL)
    schema = frame(spark, []).schema
    for i, part in enumerate([[move, insert], [move, ring, based], [message(1, type="insert_feature", geometry=kite)], [insert, ring, based]]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        edits.run_available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), base, str(tmp_path / f"out{i}"), str(tmp_path / "state"))
    changes = spark.read.schema(edits.OUTPUT).parquet(*[str(p) for p in tmp_path.glob("out*/batch=*")])
    got = {}
    for r in changes.where("kind = 'outcome'").orderBy("version").collect():
        got.setdefault(r.seq, []).append(r.outcome)
    assert got == {1: ["applied"], 2: ["buffered", "applied", "duplicate"], 3: ["buffered", "applied", "duplicate"], 4: ["buffered", "applied"], 5: ["applied", "superseded"]}
    assert {r.feature_id: r.geometry for r in edits.settle(changes, base).collect()} == {
        "f": '{"type":"Polygon","coordinates":[[[3,1],[8,2],[6,9],[-1,5],[3,1]],[[4,3],[4.1,3.5],[4,4],[5,4],[4,3]]]}', "old": '{"type":"Point","coordinates":[9,9]}', "still": '{"type":"Point","coordinates":[5,6]}',
    }


def test_edits_of_many_features_take_one_call():
    """Each feature's state is read once and written once, however many features and edits a call has; counters stay exact and rows without a delivery_id come last."""

    class Handle(dict):
        reads, writes = 0, 0

        def getMapState(self, *_):
            return self

        def getValue(self, key):
            self.reads += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.writes += 1
            self[key] = value

    big, held = (1 << 62) - 2, Handle()
    op = lambda own, delivery, seq, **f: ("d", own, json.dumps(dict(delivery_id=delivery, site_id="s", seq=seq, ts=seq) | f))
    made = [op(f"f{k}", k, 1, type="insert_feature", geometry='{"type":"Point","coordinates":[1,2]}') for k in range(50)]
    moves = [op(f"f{k}", d, n, type="edit_geometry", gen=dict(site_id="s", seq=1), geometry_op=dict(action="move_vertex", part_id="part:0", ring_id="ring:0:0", vertex_id="init:0:0", coord=[9.0, x])) for k in range(50) for d, n, x in ((None, big, "Infinity"), (99, big - 1, 4.5))]
    merging = edits.Geometries()
    merging.init(held)
    (out,) = merging.handleInputRows((0,), iter([pd.DataFrame(made[:25] + moves, columns=["document_id", "feature_id", "op"]), pd.DataFrame(made[25:], columns=["document_id", "feature_id", "op"])]), None)
    assert (held.reads, held.writes, len(out)) == (50, 50, 200)
    of = out[out.feature_id == "f49"]
    assert of[["seq", "outcome", "geometry"]].values.tolist() == [[1, "applied", None], [big - 1, "applied", None], [big, "quarantined", None], [None, None, '{"type":"Point","coordinates":[9,4.5]}']]
    assert not list(merging.handleInputRows((0,), iter([]), None))
    buffered = pd.DataFrame([op("g", 1, 7, type="edit_geometry", gen=dict(site_id="x", seq=1), geometry_op=dict(action="remove_part"))] * 2, columns=["document_id", "feature_id", "op"])
    assert [len(list(merging.handleInputRows((0,), iter([buffered]), None))) for _ in range(2)] == [1, 0] and held.writes == 51  # what waits already is left alone


def test_embedded_identity(spark):
    rows = frame(spark, [message(1, type="edit_geometry", geometry_op=EDIT | dict(action="remove_part", part_id="p")), message(2)])
    wide = envelope.inherit_identity(rows)
    assert [(r.geometry_op and (r.geometry_op.action, r.geometry_op.site_id, r.geometry_op.seq, r.geometry_op.ts)) for r in wide.orderBy("seq").collect()] == [("remove_part", "s", 1, 1), None]
    assert spark_rows(envelope.strip_identity(envelope.inherit_identity(wide))) == spark_rows(rows)


def test_delta_metadata(spark):
    good = dict(batch_id=1, version=3, document_id="d", site_id="s", clock=5, vector_clock={"s": 4}, compacted={"s": 4})
    deltas = spark.createDataFrame([good, good | dict(batch_id=2, compacted={"s": 5}), good | dict(batch_id=3, compacted={"t": 1}), good | dict(batch_id=4), good | dict(batch_id=5, compacted=None, vector_clock=None), good | dict(batch_id=6, version=2)], "batch_id bigint, version int, document_id string, site_id string, clock bigint, vector_clock map<string,bigint>, compacted map<string,bigint>")
    rows = frame(spark, [message(1, batch_id=1, ts=5), message(2, batch_id=4, ts=6), message(3, batch_id=4, ts=1)])
    got = {r.batch_id: r.error for r in envelope.judged_deltas(deltas, rows).collect()}
    assert got == {1: None, 2: "compacted exceeds the vector clock", 3: "compacted exceeds the vector clock", 4: "an operation is newer than the clock", 5: None, 6: "unsupported version"}


def test_outcomes_agree_with_replicas(spark, sf, replicas):
    got = {(r.document_id, r.outcome): r.ops for r in outcomes.tally(first_deliveries(spark.read.parquet(f"{sf}/op_messages.parquet")).withColumn("batch_id", F.lit(1)), log._log(spark, sf), log._base(spark, sf)).collect()}
    want = {}
    for d, (_, t) in replicas.items():
        for name, n in (("applied", t.applied), ("duplicate", t.duplicates), ("superseded", len(t.superseded)), ("buffered", len(t.buffered)), ("quarantined", len(t.quarantined))):
            if n:
                want[d, name] = n
    assert got == want


def test_clocks_agree_with_replicas(spark, sf, replicas):
    got = {(r.document_id, r.site_id): (r.frontier, r.highest) for r in log.frontier(spark, sf).collect()}
    for d, (r, _) in replicas.items():
        known, top = r.vector_clock(), r.applied()
        assert {s: (known.get(s, 0), n) for s, n in top.items()} == {s: v for (doc, s), v in got.items() if doc == d}


def test_lineage_agrees_with_replicas(spark, sf, replicas):
    got = {r.document_id: r.base_hash for r in log.lineage_hash(spark, sf).collect()}
    assert got and all(replicas[d][0].base_hash == h for d, h in got.items())


def test_empty_tables(spark):
    op, base = first_deliveries(frame(spark, [])), frame(spark, [], BASE_DDL)
    assert export.features(op, base).count() == 0
    assert outcomes.outcomes(op, base).count() == 0
    assert clocks.frontier_of(op).count() == clocks.staged(op).count() == clocks.gaps(op).count() == 0
    assert geo.base_hashes(base).count() == 0


def test_order_of_a_deep_chain(spark):
    """2,500 insertions, each after the one before."""
    kite = '{"type":"Polygon","coordinates":[[[3,1],[8,2],[6,9],[-1,5],[3,1]]]}'
    rows = [message(1, type="insert_feature", geometry=kite)]
    for n in range(2, 2502):
        rows.append(message(n, type="edit_geometry", gen=dict(site_id="s", seq=1), geometry_op=EDIT | dict(action="insert_vertex", part_id="part:0", ring_id="ring:0:0", after_vertex_id="init:0:0" if n == 2 else f"op:s:{n - 1}", coord=[float(n), 0.0])))
    rows.append(message(3000, type="edit_geometry", gen=dict(site_id="s", seq=1), geometry_op=EDIT | dict(action="insert_vertex", part_id="part:0", ring_id="ring:0:0", after_vertex_id="op:s:9999", coord=[0.0, 0.0])))
    t = geo.Tables(first_deliveries(frame(spark, rows)), frame(spark, [], BASE_DDL))
    got = [r.vertex_id for r in t.ordered().orderBy("ord").collect()]
    assert got == ["init:0:0", *(f"op:s:{n}" for n in range(2, 2502)), "init:0:1", "init:0:2", "init:0:3"]


def test_clock_columns(spark):
    df = spark.createDataFrame([({"a": 1, "b": 5}, {"b": 3, "c": 1}), (None, {"a": 1}), ({}, None), ({"a": 2}, {"a": 2})], "x map<string,bigint>, y map<string,bigint>")
    got = df.select(clocks.merged(F.col("x"), F.col("y")), clocks.covered(F.col("x"), F.col("y")), clocks.covered(F.col("y"), F.col("x"))).collect()
    assert [dict(r[0]) for r in got] == [{"a": 1, "b": 5, "c": 1}, {"a": 1}, {}, {"a": 2}]
    assert [(r[1], r[2]) for r in got] == [(False, False), (True, False), (True, True), (True, True)]


def test_frontier_over_compacted(spark):
    known = spark.createDataFrame([("d", "s", n) for n in (4, 5, 9)] + [("d", "t", 2)], "document_id string, site_id string, seq bigint")
    base = spark.createDataFrame([("d", "s", 3), ("d", "u", 7)], "document_id string, site_id string, seq bigint")
    assert sorted(map(tuple, clocks.frontier_of(known, base).collect())) == [("d", "s", 5, 9), ("d", "t", 0, 2), ("d", "u", 7, 7)]
    assert sorted(map(tuple, clocks.staged(known, base).collect())) == [("d", "s", 9, 9), ("d", "t", 2, 2)]


def test_envelope_agrees_with_replica(spark):
    good = message(1, property_key="k", property_value="1")
    rows = [good, *(good | bad for bad in (
        dict(site_id=" "), dict(seq=0), dict(ts=2**62), dict(feature_id=None), dict(type="x"), dict(type=None), dict(property_key=" "), dict(property_value=""), dict(property_value="{"), dict(type="insert_feature", geometry="{"),
        dict(type="insert_feature", geometry=" null "), dict(type="insert_feature", properties={"a": None}), dict(type="delete_property"), dict(type="edit_geometry"), dict(type="edit_geometry", geometry_op=EDIT),
        *(dict(type="edit_geometry", geometry_op=EDIT | e) for e in (dict(action="insert_vertex", part_id="p"), dict(action="insert_vertex", part_id="p", ring_id="r"), dict(action="insert_vertex", part_id="p", ring_id="r", vertex_id="op:s:2"), dict(action="insert_vertex", part_id="p", ring_id="r", vertex_id="op:s:1"), dict(action="move_vertex", part_id="p", ring_id="r"), dict(action="add_ring", part_id="p", ring=[]), dict(action="add_part"), dict(action="remove_part", part_id="p"))),
    ))]
    got = frame(spark, [r | dict(delivery_id=i) for i, r in enumerate(rows)]).select("delivery_id", envelope.op_error().alias("e")).collect()
    assert [r.e is None for r in sorted(got)] == [replica.wire_error(r) is None for r in rows]
    with pytest.raises(errors.InvalidOp):
        envelope.require_valid(frame(spark, rows[:2]))
    with pytest.raises(errors.IdentityCollision):
        envelope.require_distinct(frame(spark, [good, good | dict(delivery_id=2, property_value="2")]))


def test_stores(spark, tmp_path):
    store, batch = OpStore(spark, str(tmp_path / "ops")), frame(spark, [message(n, property_key="k", property_value="1") for n in (1, 2, 3)])
    clock = spark.createDataFrame([("d", "s", 1)], "document_id string, site_id string, seq bigint")
    assert store.since(clock).count() == 0
    assert store.append(batch) == 3 and store.append(batch) == 0
    assert [r.seq for r in store.since(clock).collect()] == [2, 3]
    with pytest.raises(errors.IdentityCollision):
        store.append(frame(spark, [message(9, property_key="k", property_value="1"), message(3, property_key="k", property_value="2")]))
    assert store.read("d").count() == 3
    snaps = SnapshotStore(spark, str(tmp_path / "snaps"))
    rows = spark.createDataFrame([("d", "a/b", 1)], "document_id string, id string, clock bigint")
    snaps.save(rows)
    snaps.save(rows.withColumn("clock", F.lit(2)))
    assert snaps.load("d", "a/b").collect()[0].clock == 2
    with pytest.raises(errors.InvalidSnapshot):
        snaps.load("d", "none")


def test_written_features_are_sorted(spark, tmp_path):
    rows = frame(spark, [message(n, document_id=f"d{n % 3}", type="insert_feature", feature_id=f"f{n:02d}") for n in range(1, 30)])
    export.write_features(export.features(first_deliveries(rows), frame(spark, [], BASE_DDL)), str(tmp_path / "out"))
    for folder in (tmp_path / "out").glob("document=*"):
        ids = [json.loads(line)["id"] for part in sorted(folder.glob("part-*")) for line in part.read_text().splitlines()]
        assert ids == sorted(ids) and len(ids) in (9, 10)


def test_wire_files(spark, tmp_path):
    a = replica.Replica("doc", "a")
    a.insert_feature("f", '{"type":"Point","coordinates":[1.50,2]}', {"n": 73786976294838206465, "t": "é<"})
    a.edit_geometry("f", replica.move_vertex("part:0", "ring:0:0", "init:0:0", [3.0, 4.0]))
    text = wire.dump(a.delta_since({}), "delta")
    assert json.loads(text)["ops"][0]["geometry"] == {"type": "Point", "coordinates": [1.5, 2]}
    (tmp_path / "one.json").write_text(text)
    rows = wire.read_deltas(spark, str(tmp_path / "one.json"))
    got = [r.asDict(recursive=True) for r in rows.orderBy("seq").collect()]
    b = replica.Replica("doc", "b")
    assert b.merge_ops("doc", got).applied == 2 and b.collection() == a.collection()
    with pytest.raises(errors.InvalidSyncState):
        wire.load('{"version":"3"}', "delta")
    (tmp_path / "snap.json").write_text(wire.dump(a.snapshot("s1"), "snapshot"))
    (row,) = wire.read_snapshots(spark, str(tmp_path / "snap.json")).collect()
    back = row.asDict(recursive=True)
    assert back["features"] == wire.load(wire.dump(a.snapshot("s1"), "snapshot"), "snapshot")["features"] and back["id"] == "s1"
    assert replica.Replica.restore("a", back).collection() == a.collection()
    (tmp_path / "city.geojson").write_text(a.collection())
    base = geojson.read_collections(spark, str(tmp_path / "*.geojson")).collect()
    assert [(r.document_id, r.feature_id, r.geometry) for r in base] == [("city", "f", '{"coordinates":[3,4],"type":"Point"}')]


def test_stream_keeps_the_newest_whatever_the_batches(spark, tmp_path):
    rows = [message(1, type="insert_feature", properties={"a": "1"}, ts=5), message(2, property_key="a", property_value="2", ts=9), message(3, type="delete_feature", ts=4), message(4, type="delete_property", property_key="a", ts=7), message(5, property_key="b", property_value="1", ts=1)]
    for i, part in enumerate([rows[3:], rows[:2], rows[1:4], rows]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        schema = frame(spark, []).schema
        live.run_available(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / f"out{i}"), str(tmp_path / "state"))
    changes = spark.read.schema(live.OUTPUT).parquet(*[str(p) for p in tmp_path.glob("out*/batch=*")])
    got = sorted(map(tuple, live.settle(changes, frame(spark, [], BASE_DDL)).collect()))
    assert got == [("d", "f", "a", "s", 2), ("d", "f", "b", "s", 5)]
    assert changes.count() == changes.distinct().count()  # repeated deliveries emit nothing
    assert T0
