"""Problems 1 … 5: against SQL on whole tables, and brute force and edge cases on small ones."""

import json
import random
from datetime import datetime, timedelta

import pytest
from compare import spark_rows, sql_rows, views
from pyspark.sql import functions as F

from lamina.functions.canon import canonical, canonical_or_raw, loads, quoted
from lamina.operators import dedupe, ledger, nested, orphans, replay, sieve
from lamina.plans import problems
from lamina.plans.problems_sql import SQL
from lamina.schemas import BASE_DDL, OP_FIELDS

MESSAGES = f"delivery_id bigint, batch_id bigint, received_at timestamp_ntz, document_id string, {OP_FIELDS}"
T0 = datetime(2024, 1, 31, 12)
EDIT = dict(action=None, part_id=None, ring_id=None, vertex_id=None, after_vertex_id=None, coord=None, ring=None, part=None)


def message(n, **fields):
    row = dict(delivery_id=n, batch_id=1, received_at=T0 + timedelta(hours=n), document_id="d", type="set_property", site_id="s", seq=n, ts=n, feature_id="f", geometry=None, properties=None, property_key=None, property_value=None, gen=None, geometry_op=None)
    return row | fields


def frame(spark, rows, schema=MESSAGES):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(getattr(problems, name)(spark, sf)) == sql_rows(views(sf), SQL[name])


# --- 1 ---


def brute_surplus(rows):
    seen, out = {}, set()
    for r in sorted(rows, key=lambda r: r["delivery_id"]):
        if any(not (r[c] or "").strip("  \t") for c in ("document_id", "site_id", "type", "feature_id")):
            continue
        if not all(r[c] is not None and 0 < r[c] < 2**62 for c in ("seq", "ts")):
            continue
        e = dict(r["geometry_op"]) if r["geometry_op"] else None
        if e:
            for action, field, prefix in (("insert_vertex", "vertex_id", "op"), ("add_ring", "ring_id", "ring"), ("add_part", "part_id", "part")):
                if e["action"] == action:
                    e[field] = e[field] or f"{prefix}:{r['site_id']}:{r['seq']}"
            e["part"] = canonical_or_raw(e["part"])
        content = [r["type"], r["ts"], r["feature_id"], r["property_key"], canonical_or_raw(r["geometry"]), canonical_or_raw(r["property_value"]), str(r["gen"]), json.dumps(e)]
        content.append(sorted((k, canonical_or_raw(v)) for k, v in (r["properties"] or {}).items()))
        group = seen.setdefault((r["document_id"], r["site_id"], r["seq"]), [])
        if content in group:
            out.add(r["delivery_id"])
        else:
            group.append(content)
    return out


def test_surplus_matches_brute_force(spark):
    rng, rows = random.Random(3), []
    for n in range(1, 400):
        seq = rng.choice([1, 1, 1, rng.randint(1, 60)])  # one number holds most rows
        kind = rng.choice(["set_property", "insert_feature", "edit_geometry"])
        row = message(n, seq=seq, ts=seq, site_id=rng.choice(["s", "S"]), type=kind)
        if kind == "set_property":
            row |= dict(property_key="k", property_value=rng.choice(['{"a":1,"b":"é"}', ' { "b":"\\u00e9", "a":1}', "1.50", "1.5", '"x"', "not json"]))
        elif kind == "insert_feature":
            row |= dict(properties=rng.choice([{"a": "1", "b": "[1, 2]"}, {"b": "[1,2]", "a": " 1"}, {}, None]), geometry=rng.choice([None, '{"type":"Point","coordinates":[1,2]}', '{"coordinates": [1, 2],"type":"Point"}']))
        else:
            row |= dict(geometry_op=EDIT | rng.choice([dict(action="insert_vertex", part_id="p", vertex_id=rng.choice([None, f"op:s:{seq}"]), coord=[0.0, rng.choice([0.0, -0.0])]), dict(action="add_part", part='{"type":"Point","coordinates":[1, 2]}')]))
        rows.append(row | rng.choice([{}] * 9 + [dict(feature_id="  "), dict(seq=None), dict(document_id=None), dict(ts=2**62)]))
    found = {r.delivery_id for r in dedupe.surplus(frame(spark, rows)).collect()}
    assert found == brute_surplus(rows)
    assert found


def test_surplus_edge_cases(spark):
    assert dedupe.surplus(frame(spark, [])).count() == 0
    extra = frame(spark, [message(1, seq=5), message(2, seq=5, ts=3)]).selectExpr("*", "delivery_id AS digest", "1 AS first_delivery", "2 AS copies", "3 AS deliveries")
    assert dedupe.surplus(extra).count() == 0  # different ts: both stay
    again = frame(spark, [message(1, seq=5, ts=1), message(2, seq=5, ts=1, property_value="x" * 200_000), message(3, seq=5, ts=1, property_value="x" * 200_000)])
    assert [r.delivery_id for r in dedupe.surplus(again).collect()] == [3]


def test_ranges_accept_once_and_merge(spark):
    first = frame(spark, [message(n, seq=s) for n, s in enumerate([1, 2, 3, 7, 8, 4096, 4097, 3], 1)])
    seen = dedupe.as_ranges(dedupe.numbers(first))
    assert [(r.lo, r.hi) for r in dedupe.whole_ranges(seen).orderBy("lo").collect()] == [(1, 3), (7, 8), (4096, 4097)]
    then = frame(spark, [message(20 + n, seq=s) for n, s in enumerate([3, 4, 5, 6, 7, 4098, 4098])])
    offered = {r.seq: r.covered for r in dedupe.offer(dedupe.numbers(then), seen).collect()}
    assert offered == {3: True, 4: False, 5: False, 6: False, 7: True, 4098: False}
    grown = dedupe.merge_ranges(seen, dedupe.as_ranges(dedupe.numbers(then)))
    assert [(r.lo, r.hi) for r in dedupe.whole_ranges(grown).orderBy("lo").collect()] == [(1, 8), (4096, 4098)]
    kept = dedupe.deliver_once(then.unionByName(frame(spark, [message(90, seq=None, ts=1), message(91, seq=None, ts=1), message(92, seq=0, ts=1)])), seen, first)
    assert sorted(r.delivery_id for r in kept.collect()) == [20, 21, 22, 23, 24, 25, 26, 90, 92]  # contents differ in ts
    copies = frame(spark, [message(40, seq=3, ts=3), message(41, seq=8, ts=5), message(42, seq=8, ts=5), message(43, seq=8, ts=9), message(44, seq=9, ts=9)])
    assert sorted(r.delivery_id for r in dedupe.deliver_once(copies, seen, first).collect()) == [43, 44]  # the others came in the former run


def test_malformed_rows_are_looked_up_in_former_runs(spark):
    """Rows without a place in a range: what a former run brought doesn't come again, and none is lost."""
    first = frame(spark, [message(1), message(2, seq=None, ts=1), message(3, seq=0, ts=1), message(4, site_id=" ", seq=4, ts=4), message(5, document_id=None, seq=5, ts=5)])
    again = [message(11, seq=None, ts=1), message(12, seq=0, ts=1), message(13, site_id=" ", seq=4, ts=4), message(14, document_id=None, seq=5, ts=5)]
    fresh = [message(21, seq=None, ts=2), message(22, seq=None, ts=2), message(23, seq=None, ts=1, document_id="e"), message(24, delivery_id=None, seq=None, ts=7), message(25, delivery_id=None, seq=None, ts=2)]
    then = frame(spark, [message(10, seq=1, ts=1), *again, *fresh])
    ids = lambda df: sorted(r.delivery_id or 0 for r in df.collect())
    assert ids(dedupe.deliver_once(then, dedupe.as_ranges(dedupe.numbers(first)), first)) == [0, 21, 23]
    assert ids(dedupe.deliver_once(first.unionByName(then))) == [0, 1, 2, 3, 4, 5, 21, 23]  # two runs give what one gives
    assert ids(dedupe.deliver_once(then)) == [0, 10, 11, 12, 13, 14, 21, 23]


def test_whole_ranges_over_stretches(spark):
    """Ranges that span stretches, end at a border, and a producer with a gap after every number."""
    rng, step = random.Random(2), 1 << dedupe.STRETCH_BITS
    spans = [(1, 3 * step + 5), (3 * step + 7, 4 * step - 1), (4 * step, 4 * step), (4 * step + 2, 4 * step + 2), (6 * step, 7 * step - 1), (7 * step, 7 * step)]
    rows = [("d", "s", lo, hi) for lo, hi in spans for lo, hi in ([(lo, hi)] if hi - lo < step else [(max(lo, b * step), min(hi, (b + 1) * step - 1)) for b in range(lo // step, hi // step + 1)])]
    rows += [("d", "gappy", n * step // 2, n * step // 2) for n in range(1, 20)]
    rng.shuffle(rows)
    got = sorted(map(tuple, dedupe.whole_ranges(spark.createDataFrame(rows, "document_id string, site_id string, lo bigint, hi bigint")).collect()))
    want = [("d", "gappy", n * step // 2, n * step // 2) for n in range(1, 20)] + [("d", "s", 1, 3 * step + 5), ("d", "s", 3 * step + 7, 4 * step), ("d", "s", 4 * step + 2, 4 * step + 2), ("d", "s", 6 * step, 7 * step)]
    assert got == want


def test_sieve_loses_nothing(spark):
    keys = spark.range(0, 5000, 7).selectExpr("id AS a", "CAST(id % 3 AS STRING) AS b")
    rows = spark.range(5000).selectExpr("id AS a", "CAST(id % 3 AS STRING) AS b", "'x' AS word")
    for bits in (12, 25):
        kept = sieve.sifted(rows, sieve.sieve(keys, ("a", "b"), bits), ("a", "b"), True, bits)
        out = sieve.sifted(rows, sieve.sieve(keys, ("a", "b"), bits), ("a", "b"), False, bits)
        assert kept.join(keys, ["a", "b"], "left_semi").count() == keys.count() and kept.count() + out.count() == 5000
        assert kept.columns == rows.columns and kept.count() < 2000
    assert sieve.sifted(rows, sieve.sieve(keys.where("false"), ("a", "b")), ("a", "b")).count() == 0


# --- 2 ---

RUNS = "run_id bigint, attempt int, document_id string, site_id string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, through_seq bigint, staged_seqs array<bigint>"


def run(status, hour, through, staged=None, site="s"):
    return (1, 1, "d", site, status, T0, None if hour is None else T0 + timedelta(hours=hour), through, staged)


def left(spark, runs):
    rows = frame(spark, [message(n, seq=n) for n in range(1, 9)] + [message(20, seq=3)])
    return sorted(r.seq for r in ledger.remaining(rows, frame(spark, runs, RUNS)).collect())


def test_remaining(spark):
    everything = list(range(1, 9))
    assert left(spark, []) == everything
    assert left(spark, [run("failed", 5, 8), run("running", None, 8), run("Succeeded", 1, None, None)]) == everything
    assert left(spark, [run("SUCCEEDED", 1, 2, [5, 6]), run("rolled_back", 9, 8)]) == [3, 4, 7, 8]
    assert left(spark, [run("succeeded", 1, 6), run("succeeded", 2, 2, []), run("succeeded", 3, 8, site="S")]) == [3, 4, 5, 6, 7, 8]
    assert left(spark, [run("succeeded", 2, 3, [None, 8])] * 2) == [4, 5, 6, 7]


def test_leases_of_the_log_expire(spark):
    rows = frame(spark, [message(n, seq=n) for n in range(1, 5)])
    runs = frame(spark, [run("succeeded", 1, 1), (1, 1, "d", "s", "running", T0 + timedelta(hours=2), None, 9, None)], RUNS)
    at = lambda hours: F.lit(T0 + timedelta(hours=hours)).cast("timestamp_ntz")
    seqs = lambda **k: sorted(r.seq for r in ledger.remaining(rows, runs, **k).collect())
    assert seqs(now=at(2.5)) == [] and [r.state for r in ledger.items(rows, runs, at(2.5)).collect()] == ["leased"]
    assert seqs(now=at(3.5)) == seqs() == [2, 3, 4]  # the lease of an hour is over
    assert seqs(now=at(3.5), lease=timedelta(hours=9)) == []
    late = runs.unionByName(frame(spark, [run("succeeded", 4, 4)], RUNS))
    assert seqs(now=at(2.5)) == [] and ledger.remaining(rows, late, at(2.5)).count() == 0


def outcome(book):
    return {r.item_id: (r.state, r.fence, r.worker) for r in book.table().collect()}


def test_work_ledger(spark):
    now = [100.0]
    book = ledger.WorkLedger(spark, "t", clock=lambda: now[0])
    named = lambda *ids: spark.createDataFrame([(i,) for i in ids], "item_id string")
    assert outcome(book) == {}
    book.add(named("x", "y"))
    book.add(named("y", "z"))
    first = book.claim("a", 10, named("x", "y"))
    assert outcome(book) == {"x": ("leased", 1, "a"), "y": ("leased", 1, "a"), "z": ("pending", 0, "")}
    assert [r.item_id for r in book.claim("b", 10).items.collect()] == ["z"]  # what is leased isn't leased again
    now[0] = 111  # the leases expire, another worker takes x over with a higher token
    second = book.claim("b", 10, named("x"))
    assert [(r.item_id, r.fence) for r in second.items.collect()] == [("x", 2)]
    assert first.items.where("item_id = 'x'").first().path != second.items.first().path
    with pytest.raises(ledger.StaleWriter):
        book.complete(first)  # all or none: y isn't done either
    assert outcome(book)["y"][0] == "pending"
    book.complete(second)
    book.complete(second)
    assert outcome(book)["x"] == ("done", 2, "b") and book.table().where("item_id = 'x'").first().path.endswith("/item_id=x/fence=2")
    third = book.claim("c", 10)
    assert sorted((r.item_id, r.fence) for r in third.items.collect()) == [("y", 2), ("z", 2)]
    book.release(third)
    assert {s for s, _, _ in outcome(book).values()} == {"done", "pending"}


def test_takeover_between_check_and_publication_is_seen(spark):
    """A worker reads the state, another takes over and only then the first publishes; and two claims race."""
    now = [0.0]
    book, rival = ledger.WorkLedger(spark, "race", clock=lambda: now[0]), ledger.WorkLedger(spark, "race", clock=lambda: now[0])
    book.add(spark.createDataFrame([("x",)], "item_id string"))
    lease = book.claim("a", 10)
    now[0], publish, taken = 20.0, book.log.publish, []

    def slow(*args):
        if not taken:
            taken.append(rival.claim("b", 10))
        return publish(*args)

    book.log.publish = slow
    with pytest.raises(ledger.StaleWriter):
        book.complete(lease)
    now[0], first = 40.0, taken.pop()
    late = book.claim("c", 10)  # rival claims in between and wins
    assert late.items.count() == 0 and [(r.item_id, r.fence) for r in taken[0].items.collect()] == [("x", 3)]
    with pytest.raises(ledger.StaleWriter):
        rival.complete(first)
    rival.complete(taken[0])
    assert outcome(rival) == {"x": ("done", 3, "b")}


def test_crash_between_output_and_publication(spark):
    """The output of a worker that died before it published is never read; the retry's is, once."""
    now = [0.0]
    book = ledger.WorkLedger(spark, "crash", clock=lambda: now[0])
    book.add(spark.createDataFrame([("x",)], "item_id string"))
    for worker in ("dies", "lives"):
        lease = book.claim(worker, 10)
        spark.createDataFrame([(worker,)], "who string").write.mode("overwrite").parquet(lease.items.first().path)
        now[0] += 20
    book.complete(lease)
    done = [r.path for r in book.table().where("state = 'done'").collect()]
    assert [r.who for r in spark.read.parquet(*done).collect()] == ["lives"]


# --- 3 ---


def brute_items(snapshots):
    out, done = set(), set()
    for s in snapshots:
        if s["id"] in done:
            continue
        done.add(s["id"])
        for name in nested.OP_LISTS:
            for no, op in enumerate(s[name] or ()):
                at = (s["id"], name, no)
                try:
                    g = json.loads(op["geometry"] or "null")
                except ValueError:
                    g = None
                if isinstance(g, dict) and "coordinates" in g and "type" in g:
                    c = g["coordinates"]
                    depth = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[g["type"]]
                    paths = [((), c)]
                    for _ in range(depth):
                        paths = [(p + (i,), v) for p, x in paths for i, v in enumerate(x)]
                    for p, v in paths:
                        if not v:
                            continue
                        where = {"Point": (0, 0, 0), "LineString": (0, 0, *p), "MultiPoint": (*p, 0, 0), "Polygon": (0, *p), "MultiLineString": (p[0] if p else 0, 0, *p[1:]), "MultiPolygon": p}[g["type"]]
                        out.add((*at, "geometry", *where))
                e = op["geometry_op"]
                for i, _ in enumerate((e["ring"] if e else None) or ()):
                    out.add((*at, "ring", 0, 0, i))
                try:
                    owner = json.loads((dict(op["properties"] or {})).get("owner") or "null")
                except ValueError:
                    owner = None
                for i, o in enumerate(owner if isinstance(owner, list) else [] if owner is None else [owner]):
                    out.add((*at, "owner", i, 0, 0))
                    if isinstance(o, dict) and isinstance(o.get("shares"), list):
                        out |= {(*at, "owner_share", i, 0, k) for k in range(len(o["shares"]))}
    return out


def test_items_match_brute_force(spark, sf):
    rows = views("/root/testdata/sf0.01").execute("SELECT id, outbox_ops, retained_ops, pending_ops FROM replica_snapshots").fetchall()
    snapshots = [dict(zip(("id", *nested.OP_LISTS), r, strict=True)) for r in rows]
    got = nested.items(spark.read.parquet("/root/testdata/sf0.01/replica_snapshots.parquet")).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_items(snapshots)


def test_items_edge_cases(spark):
    op = dict(type="x", site_id="s", seq=1, ts=1, feature_id="f", geometry=None, properties=None, property_key=None, property_value=None, gen=None, geometry_op=None)
    lists = dict(outbox_ops=None, retained_ops=[], pending_ops=[op | dict(geometry=g, properties={"owner": o}) for g, o in [
        ('{"type":"Point","coordinates":[]}', "null"), ('{"type":"Polygon","coordinates":[[[0,0],[1,1', "[null, 5]"), ("[]", '{"shares":{}}'), ('{"type":"Circle","coordinates":[1,2]}', '{"shares":[[],1]}'), ("null", "[]"), ('{"type":"MultiPoint","coordinates":[[1,2],[1,2]]}', ""),
    ]])
    schema = f"id string, root string, outbox_ops array<struct<{OP_FIELDS.replace(' ', ':', 0)}>>".split("outbox_ops")[0]
    op_type = "struct<" + ", ".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in OP_FIELDS.split(", ")) + ">"
    schema += ", ".join(f"{n} array<{op_type}>" for n in nested.OP_LISTS)
    df = spark.createDataFrame([dict(id="a", root="clash") | lists, dict(id="a", root="clash") | lists, dict(id=None, root=None, outbox_ops=None, retained_ops=None, pending_ops=None)], schema)
    got = sorted((r.op_no, r.field, r.part_no, r.item_no) for r in nested.items(df).collect())
    assert got == [(1, "owner", 0, 0), (1, "owner", 1, 0), (2, "owner", 0, 0), (3, "owner", 0, 0), (3, "owner_share", 0, 0), (3, "owner_share", 0, 1), (5, "geometry", 0, 0), (5, "geometry", 1, 0)]
    assert nested.items(df.where("false")).count() == 0


def snapshot_rows(spark, rows):
    """Snapshots (id, clock, texts of properties.owner of the pending ops)."""
    op = dict(type="x", site_id="s", seq=1, ts=1, feature_id="f", geometry=None, properties=None, property_key=None, property_value=None, gen=None, geometry_op=None)
    op_type = "struct<" + ", ".join(f"{c.split(' ', 1)[0]}:{c.split(' ', 1)[1]}" for c in OP_FIELDS.split(", ")) + ">"
    schema = "id string, clock bigint, " + ", ".join(f"{n} array<{op_type}>" for n in nested.OP_LISTS)
    return spark.createDataFrame([(i, c, None, [], [op | dict(properties={"owner": o}) for o in owners]) for i, c, owners in rows], schema)


def test_equal_objects_are_stored_once(spark):
    a, b = nested.tree(loads('{"x": [[1], [1]], "y": {"z": []}}'), False), nested.tree(loads('{"y": {"z": []}, "x": [[1], [1]]}'), False)
    assert a[0] == b[0]
    assert sorted((kind, len(children)) for kind, children in a[3].values()) == [("array", 0), ("array", 1), ("array", 2), ("object", 1), ("object", 2)]
    parsed = nested.parse(snapshot_rows(spark, [("a", 1, ['{"n": [1, {"k": 2}]}', '[{"k":2}]', "{", "7"]), ("b", 1, ['[ {"k":2}]'])]))
    got = sorted((r.kind, r.members, r.as_root, r.as_child) for r in nested.objects(parsed).collect())
    assert got == [("array", 1, 2, 0), ("array", 2, 0, 1), ("object", 1, 0, 2), ("object", 1, 1, 0)]
    assert [(r.error is None, r.value) for r in parsed.where("root IS NULL OR value IS NOT NULL").orderBy("op_no").collect()] == [(False, None), (True, "7")]


def test_copies_and_nameless_snapshots(spark):
    rows = snapshot_rows(spark, [("a", 1, ["1"]), ("a", 2, ["[1,2]"]), ("a", 2, ["[1,2]"]), (None, 1, ["1"]), (None, 1, ["2"])])
    got = sorted((r.snapshot_id or "", r.part_no) for r in nested.items(rows).collect())
    assert got == [("", 0), ("", 0), ("a", 0), ("a", 1)]  # the newest copy counts; each nameless one is a record of its own


def rebuilt(root, kind, value, below):
    """The canonical text of a tree from its bridge rows, without recursion."""
    out, todo = [], [(root, kind, value)]
    while todo:
        own, kind, text = todo.pop()
        if text is not None:
            out.append(text)
            continue
        first, last = "{}" if kind == "object" else "[]"
        parts = [(None, None, first)]
        for i, (name, child, child_kind, scalar) in enumerate(below.get(own, ())):
            parts += [(None, None, ("," if i else "") + (f"{quoted(name)}:" if kind == "object" else "")), (child, child_kind, scalar)]
        todo += reversed([*parts, (None, None, last)])
    return "".join(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_tables_give_every_text_again(spark, sf):
    deep = '{"shares":[{"a":' * 5000 + '"bottom"' + "}]}" * 5000  # 10,000 levels
    snapshots = spark.read.parquet(f"{sf}/replica_snapshots.parquet")
    extra = snapshot_rows(spark, [("deep", 1, [deep, '{"é":{"":[1.50,null,[],{}]},"a":true}'])])
    for table in (snapshots, extra):
        parsed = nested.parse(table)
        below = {}
        for r in nested.bridges(parsed).orderBy("parent", "ordinal").collect():
            below.setdefault(bytes(r.parent), []).append((r.name, r.child and bytes(r.child), r.child_kind, r.value))
        texts = {(r.snapshot_id, r.op_list, r.op_no, r.field): r.body for r in nested.occurrences(table).collect()}
        rows = parsed.drop("nodes").collect()
        assert len(rows) == len(texts) and any(r.root for r in rows)
        for r in rows:
            body = texts[r.snapshot_id, r.op_list, r.op_no, r.field]
            if r.root is not None:
                assert rebuilt(bytes(r.root), r.kind, r.value, below) == canonical(body)
            else:
                assert r.error
    assert nested.items(extra).where("field = 'owner_share'").count() == 1


# --- 4 ---

ELEMENTS = "document_id string, feature_id string, gen struct<site_id:string,seq:bigint>, kind string, part_id string, ring_id string, vertex_id string, created_at timestamp_ntz, deleted_at timestamp_ntz"


def test_orphans(spark):
    gen = dict(site_id="s", seq=1)
    edit = lambda n, action, g=gen, **f: message(n, type="edit_geometry", gen=g, geometry_op=EDIT | dict(action=action) | f)
    rows = [
        message(1, type="insert_feature"),
        edit(2, "move_vertex", part_id="p", ring_id="r", vertex_id="v"),
        edit(3, "move_vertex", part_id="p", ring_id="r", vertex_id="gone"),
        edit(4, "delete_vertex", part_id="p", ring_id="r", vertex_id="later"),
        edit(5, "remove_ring", part_id="p", ring_id="none"),
        edit(6, "insert_vertex", part_id="p", ring_id="r"),
        edit(7, "insert_vertex", part_id="p", ring_id="r", after_vertex_id="none"),
        edit(8, "add_part", g=None),
        edit(9, "add_part", g=dict(site_id="s", seq=99)),
        edit(10, "remove_part", g=dict(site_id="s", seq=20), part_id="p"),
        message(20, type="set_geometry"),
        edit(3, "move_vertex", part_id="p", ring_id="r", vertex_id="gone") | dict(delivery_id=30, received_at=T0 + timedelta(days=40)),
        edit(12, "move_vertex", part_id="x", ring_id="r", vertex_id=None),
    ]
    at = lambda h: T0 + timedelta(hours=h)
    element = lambda kind, vertex=None, since=0, until=None: ("d", "f", ("s", 1), kind, "p", None if kind == "part" else "r", vertex, at(since), until)
    register = frame(spark, [element("part"), element("ring"), element("vertex", "v"), element("vertex", "gone", 0, at(1)), element("vertex", "later", 9)] * 2, ELEMENTS)
    base = frame(spark, [("d", "other", None, None)], BASE_DDL)
    got = sorted((r.seq, r.ref_field, r.reason, r.period) for r in orphans.orphans(frame(spark, rows), base, register).collect())
    assert got == [(3, "vertex_id", "deleted", "2024-01"), (4, "vertex_id", "late", "2024-01"), (5, "ring_id", "missing", "2024-01"), (7, "after_vertex_id", "missing", "2024-01"), (8, "gen", "missing", "2024-01"), (9, "gen", "missing", "2024-01"), (10, "gen", "late", "2024-01"), (12, "part_id", "missing", "2024-02")]
    assert orphans.orphans(frame(spark, []), base, register).count() == 0


# --- 5 ---


def test_replay(spark):
    rows = [
        message(1, type="insert_feature", properties={"a": "1", "b": "2"}, ts=5),
        message(2, property_key="a", property_value="3", ts=9),
        message(3, type="delete_feature", ts=6),
        message(4, type="insert_feature", ts=7, properties={"c": None}),
        message(5, type="delete_property", property_key="b", ts=8),
        message(6, property_key="x", ts=9, feature_id="ghost"),
        message(7, type="delete_feature", ts=3, feature_id="old"),
        message(8, property_key=" ", ts=9),
        message(10, property_key="late", ts=10),
    ]
    base = frame(spark, [("d", "old", None, {"k": "1"}), ("d", "kept", None, {"k": "1"}), ("d", "kept", None, {"k": "1"}), ("d", "f", None, {"z": "0"})], BASE_DDL)
    random.Random(1).shuffle(rows)
    df = frame(spark, rows + rows[:4])
    got = sorted((r.feature_id, r.property_key, r.site_id, r.seq) for r in replay.current(df, base).collect())
    assert got == [("f", "a", "s", 2), ("f", "c", "s", 4), ("f", "late", "s", 10), ("f", "z", "", 0), ("kept", "k", "", 0)]
    held = sorted((r.feature_id, r.property_key, r.seq) for r in replay.current(df, base, flush=False).collect())
    assert held == [("f", "a", 2), ("f", "c", 4), ("f", "z", 0), ("kept", "k", 0)]  # 10 waits for 9
    # Another site's newer change may come after the missing 9, so it waits; the older one can't.
    other = frame(spark, [message(20, site_id="t", seq=1, ts=2, property_key="early", feature_id="kept"), message(21, site_id="t", seq=2, ts=30, property_key="new", feature_id="kept"), message(22, document_id="e", seq=1, ts=90, type="insert_feature", properties={"k": "1"})])
    held = sorted((r.document_id, r.feature_id, r.property_key, r.seq) for r in replay.current(df.unionByName(other), base, flush=False).collect())
    assert held == [("d", "f", "a", 2), ("d", "f", "c", 4), ("d", "f", "z", 0), ("d", "kept", "early", 1), ("d", "kept", "k", 0), ("e", "f", "k", 1)]
    assert sorted(r.feature_id for r in replay.current(frame(spark, []), base).collect()) == ["f", "kept", "old"]


def test_clashing_columns(spark):
    """Columns named as the operators' own ones don't disturb them, and nulls in any column don't either."""
    names = ("frontier", "salt", "block", "covered", "digest", "t", "kind", "rank", "reason", "since", "until", "there", "created", "deleted", "visible", "w", "state", "known", "count", "first")
    extra = lambda df: df.selectExpr("*", *(f"'x' AS {n}" for n in names if n not in df.columns))
    rows = [message(1, type="insert_feature", properties={"a": "1"}), message(2, seq=1, ts=1, type="insert_feature", properties={"a": " 1"}), message(3, type=None), message(4, property_key="a", property_value=None), *(message(9, seq=4, ts=4) | {c: None} for c in ("batch_id", "received_at", "document_id", "site_id", "seq", "ts", "feature_id"))]
    df = extra(frame(spark, rows))
    base = extra(frame(spark, [("d", "g", None, None), (None, None, None, None)], BASE_DDL))
    runs = extra(frame(spark, [run("succeeded", 1, 1), (None,) * 9, run(None, None, None)], RUNS))
    register = extra(frame(spark, [(None,) * 9], ELEMENTS))
    assert [r.delivery_id for r in dedupe.surplus(df).collect()] == [2]
    assert sorted(r.seq for r in ledger.remaining(df, runs).collect()) == [4]
    assert orphans.orphans(df, base, register).count() == 0
    assert [r.property_key for r in replay.current(df, base).collect()] == ["a"]
    assert replay.current(df, base, flush=False).count() == 1
    assert dedupe.deliver_once(df).count() > 0 and dedupe.seen_ranges(df).count() == 2
