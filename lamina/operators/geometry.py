"""Geometry state as tables: generations, parts, rings and vertices of the winning generation.

Everything that many writers can disagree about is an aggregate: the newest generation of a
feature, the newest move of a vertex, tombstones. Creations, moves and deletions of one element
kind are unioned and aggregated by its key in one shuffle, rather than joined. Only the order
of vertices in rings with insertions needs a walk, done per ring in Arrow batches; other rings
are in the order of their positions.
"""

from __future__ import annotations


import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.canon import json_text, object_text
from lamina.functions.geojson import geometry_error, geometry_text, normal_geometry, shape
from lamina.operators import replay
from lamina.operators.messages import stamp
from lamina.session import cut

FEATURE = ("document_id", "feature_id")
PART = (*FEATURE, "part_id")
RING = (*PART, "ring_id")
VERTEX = (*RING, "vertex_id")
MAKERS = ("insert_feature", "set_geometry")


def usable(op: DataFrame) -> DataFrame:
    """Operations without inserts and set_geometries whose geometry can't be parsed; those have no effect at all.

    Only rows with a geometry pass through Python, in one narrow map.
    """
    has = F.col("type").isin(*MAKERS) & F.col("geometry").isNotNull()
    bad = F.when(has, geometry_error(F.when(has, F.col("geometry"))))
    return op.withColumn("geometry_error", bad).where("geometry_error IS NULL").drop("geometry_error")


def generations(op: DataFrame, base: DataFrame) -> DataFrame:
    """All geometry generations: (document_id, feature_id, gen_site, gen_seq, ts, geometry). The base is ('', 0) at 0."""
    made = op.where(F.col("type").isin(*MAKERS)).select(*FEATURE, F.col("site_id").alias("gen_site"), F.col("seq").alias("gen_seq"), "ts", "geometry")
    zero = F.lit(0).cast("bigint")
    return made.unionByName(base.dropDuplicates(list(FEATURE)).select(*FEATURE, F.lit("").alias("gen_site"), zero.alias("gen_seq"), zero.alias("ts"), "geometry"))


def winners(op: DataFrame, base: DataFrame) -> DataFrame:
    """The newest generation of each feature, with its geometry."""
    order = stamp("ts", "gen_site", "gen_seq")
    won = generations(op, base).groupBy(*FEATURE).agg(F.max_by(F.struct("gen_site", "gen_seq", "ts", "geometry"), order).alias("g"))
    return won.select(*FEATURE, "g.gen_site", "g.gen_seq", F.col("g.ts").alias("gen_ts"), "g.geometry")


def edits(op: DataFrame) -> DataFrame:
    """edit_geometry operations with the generation they address; created ids are derived where left out."""
    e = F.col("geometry_op")
    own = lambda prefix: F.concat(F.lit(prefix), F.col("site_id"), F.lit(":"), F.col("seq"))
    given = lambda field: F.when(e[field] != "", e[field])
    return op.where("type = 'edit_geometry'").select(
        *FEATURE, "site_id", "seq", "ts",
        F.coalesce("gen.site_id", F.lit("")).alias("gen_site"), F.coalesce("gen.seq", F.lit(0)).alias("gen_seq"), e.action.alias("action"),
        F.when(e.action == "add_part", own("part:")).otherwise(e.part_id).alias("part_id"),
        F.when(e.action == "add_ring", own("ring:")).otherwise(e.ring_id).alias("ring_id"),
        F.when(e.action == "insert_vertex", own("op:")).otherwise(e.vertex_id).alias("vertex_id"),
        given("after_vertex_id").alias("after_id"), e.coord.alias("coord"), e.ring.alias("ring"), e.part.alias("part"),
    )


def edit_status(op: DataFrame, base: DataFrame) -> DataFrame:
    """What becomes of each edit as far as generations go: (document_id, site_id, seq, status).

    current: it addresses the winner. superseded: an older generation of the feature. buffered: its
    generation's operation isn't there. quarantined: that operation is there but defines no geometry
    of the feature, or the base has no such feature.
    """
    every = generations(usable(op), base).select(*FEATURE, "gen_site", "gen_seq", F.lit(True).alias("known"))
    best = winners(usable(op), base).select(*FEATURE, F.col("gen_site").alias("w_site"), F.col("gen_seq").alias("w_seq"))
    refs = op.select("document_id", F.col("site_id").alias("gen_site"), F.col("seq").alias("gen_seq"), F.lit(True).alias("received"))
    e = edits(op).select(*FEATURE, "site_id", "seq", "gen_site", "gen_seq")
    seen = e.join(every, [*FEATURE, "gen_site", "gen_seq"], "left").join(best, list(FEATURE), "left").join(refs, ["document_id", "gen_site", "gen_seq"], "left")
    current = (F.col("gen_site") == F.col("w_site")) & (F.col("gen_seq") == F.col("w_seq"))
    lost = (F.col("gen_seq") == 0) | F.col("received").isNotNull()
    status = F.when(F.col("known") & current, "current").when(F.col("known"), "superseded").when(lost, "quarantined").otherwise("buffered")
    return seen.select("document_id", "site_id", "seq", status.alias("status"))


class Tables:
    """Parts, rings and vertices of the winning generations of a log over its base features."""

    def __init__(self, op: DataFrame, base: DataFrame) -> None:
        op = usable(op)
        self.winners = winners(op, base)
        parsed = self.winners.where("geometry IS NOT NULL").withColumn("s", shape("geometry")).where("s IS NOT NULL AND s.error IS NULL")
        # Both are used by every table below and come out of Python and a shuffle of the log: written once.
        self.shapes = cut(parsed.select(*FEATURE, "gen_site", "gen_seq", "s.type", "s.dims", "s.vertices"))
        kinds = self.shapes.select(*FEATURE, "gen_site", "gen_seq", F.col("type").alias("g_type"), "dims")
        self.edits = cut(edits(op).join(kinds, [*FEATURE, "gen_site", "gen_seq"]))
        multi, p_type = F.col("g_type").startswith("Multi"), F.regexp_replace("g_type", "^Multi", "")
        added = self.edits.where((F.col("action") == "add_part") & multi).withColumn("s", shape("part"))
        fits = added.where("s.error IS NULL").where((F.col("s.type") == p_type) & (F.col("s.dims") == F.col("dims")))
        self.new_parts = fits.select(*PART, "site_id", "seq", "ts", p_type.alias("part_type"), "dims", "s.vertices")
        self.parts = self._parts(multi)
        self.rings = self._rings()
        self.vertices = self._vertices()

    def _parts(self, multi: Column) -> DataFrame:
        """PART, part_type, dims, pos (null if added), ts, site_id, seq, deleted."""
        none = F.lit(None)
        first = self.shapes.select(*FEATURE, F.regexp_replace("type", "^Multi", "").alias("part_type"), "dims", F.explode(F.array_distinct(F.transform("vertices", lambda v: v.part))).alias("pos"))
        initial = first.select(*FEATURE, F.concat(F.lit("part:"), "pos").alias("part_id"), F.struct("part_type", "dims", "pos", none.cast("bigint").alias("ts"), none.cast("string").alias("site_id"), none.cast("bigint").alias("seq")).alias("made"), F.lit(False).alias("gone"))
        fresh = self.new_parts.select(*PART, F.struct("part_type", "dims", none.cast("int").alias("pos"), "ts", "site_id", "seq").alias("made"), F.lit(False).alias("gone"))
        removed = self.edits.where((F.col("action") == "remove_part") & multi).select(*PART, none.cast("struct<part_type:string,dims:int,pos:int,ts:bigint,site_id:string,seq:bigint>").alias("made"), F.lit(True).alias("gone"))
        every = initial.unionByName(fresh).unionByName(removed).groupBy(*PART).agg(F.max("made").alias("made"), F.max("gone").alias("deleted"))
        return every.where("made IS NOT NULL").select(*PART, "made.*", "deleted")

    def _rings(self) -> DataFrame:
        """RING, pos (null if added), ts, site_id, seq, exterior, part_type, dims, deleted."""
        none = F.lit(None)
        null_stamp = [none.cast("bigint").alias("ts"), none.cast("string").alias("site_id"), none.cast("bigint").alias("seq")]
        distinct = lambda kind: F.explode(F.array_distinct(F.transform("vertices", lambda v: F.struct(v.part.alias("p"), v.ring.alias("r"))))).alias(kind)
        ext = (F.col("k.r") == 0) & (F.col("part_type") == "Polygon")
        first = self.shapes.select(*FEATURE, F.regexp_replace("type", "^Multi", "").alias("part_type"), "dims", distinct("k"))
        made = lambda pos, when, exterior: F.struct(pos.alias("pos"), *when, exterior.alias("exterior"), F.col("part_type"), F.col("dims")).alias("made")
        initial = first.select(*FEATURE, F.concat(F.lit("part:"), "k.p").alias("part_id"), F.concat(F.lit("ring:"), "k.p", F.lit(":"), "k.r").alias("ring_id"), made(F.col("k.r"), null_stamp, ext), F.lit(False).alias("gone"))
        of_parts = self.new_parts.select(*PART, "site_id", "seq", "part_type", "dims", distinct("k")).select(
            *PART, F.concat(F.lit("ring:"), "site_id", F.lit(":"), "seq", F.lit(":"), "k.r").alias("ring_id"), made(F.col("k.r"), null_stamp, ext), F.lit(False).alias("gone")
        )
        opened = F.when((F.size("ring") >= 2) & (F.get("ring", F.lit(0)) == F.get("ring", F.size("ring") - 1)), F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
        good = F.forall("ring", lambda p: (F.size(p) == F.col("dims")) & F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        wide = F.size(F.array_distinct(F.transform("open", lambda p: F.struct((p[0] + 0.0).alias("x"), (p[1] + 0.0).alias("y"))))) >= 3
        holders = self.parts.where("part_type = 'Polygon'").select(*PART, "part_type")
        cuts = self.edits.where("action = 'add_ring' AND ring IS NOT NULL").where(F.coalesce(good, F.lit(False))).withColumn("open", opened).where(wide).join(holders, list(PART))
        self.new_rings = cuts.select(*RING, "ts", "site_id", "seq", "open", "part_type", "dims")
        fresh = self.new_rings.select(*RING, made(none.cast("int"), [F.col("ts"), F.col("site_id"), F.col("seq")], F.lit(False)), F.lit(False).alias("gone"))
        kind = "struct<pos:int,ts:bigint,site_id:string,seq:bigint,exterior:boolean,part_type:string,dims:int>"
        removed = self.edits.where("action = 'remove_ring'").select(*RING, none.cast(kind).alias("made"), F.lit(True).alias("gone"))
        every = initial.unionByName(of_parts).unionByName(fresh).unionByName(removed).groupBy(*RING).agg(F.max("made").alias("made"), F.max("gone").alias("gone"))
        return every.where("made IS NOT NULL").select(*RING, "made.*", (F.col("gone") & ~F.col("made.exterior")).alias("deleted"))

    def _vertices(self) -> DataFrame:
        """VERTEX, pos (null if inserted), after_id, ts, site_id, seq, coord, deleted, move (stamp or null), part_type.

        Rows of vertices that were created; one may still hang on a predecessor that wasn't, which ordered() leaves out.
        """
        none = F.lit(None)
        null_stamp = [none.cast("string").alias("after_id"), none.cast("bigint").alias("ts"), none.cast("string").alias("site_id"), none.cast("bigint").alias("seq")]
        v = F.col("v")
        made = lambda pos, when, coord: F.struct(pos.alias("pos"), *when, coord.alias("coord")).alias("made")
        no_move, alive = none.cast("struct<ts:bigint,site_id:string,seq:bigint,coord:array<double>>").alias("moved"), F.lit(False).alias("gone")
        initial = self.shapes.select(*FEATURE, F.explode("vertices").alias("v")).select(
            *FEATURE, F.concat(F.lit("part:"), v.part).alias("part_id"), F.concat(F.lit("ring:"), v.part, F.lit(":"), v.ring).alias("ring_id"),
            F.concat(F.lit("init:"), v.ring, F.lit(":"), v.pos).alias("vertex_id"), made(v.pos, null_stamp, v.coord), no_move, alive,
        )
        tag = [F.col("site_id"), F.lit(":"), F.col("seq"), F.lit(":")]
        of_parts = self.new_parts.select(*PART, "site_id", "seq", F.explode("vertices").alias("v")).select(
            *PART, F.concat(F.lit("ring:"), *tag, v.ring).alias("ring_id"), F.concat(F.lit("v:"), *tag, v.ring, F.lit(":"), v.pos).alias("vertex_id"), made(v.pos, null_stamp, v.coord), no_move, alive
        )
        of_rings = self.new_rings.select(*RING, "site_id", "seq", F.posexplode("open").alias("pos", "coord")).select(*RING, F.concat(F.lit("v:"), *tag, "pos").alias("vertex_id"), made(F.col("pos"), null_stamp, F.col("coord")), no_move, alive)
        sound = (F.size("coord") == F.col("dims")) & F.forall("coord", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        touched = self.edits.where(F.col("action").isin("insert_vertex", "move_vertex", "delete_vertex")).where((F.col("action") == "delete_vertex") | F.coalesce(sound, F.lit(False)))
        inserted = made(none.cast("int"), [F.col("after_id"), F.col("ts"), F.col("site_id"), F.col("seq")], F.col("coord"))
        kind = "struct<pos:int,after_id:string,ts:bigint,site_id:string,seq:bigint,coord:array<double>>"
        own = touched.select(
            *VERTEX, F.when(F.col("action") == "insert_vertex", inserted).otherwise(none.cast(kind)).alias("made"),
            F.when(F.col("action") == "move_vertex", F.struct("ts", "site_id", "seq", "coord")).alias("moved"), (F.col("action") == "delete_vertex").alias("gone"),
        )
        every = initial.unionByName(of_parts).unionByName(of_rings).unionByName(own)
        state = every.groupBy(*VERTEX).agg(F.max("made").alias("made"), F.max("moved").alias("moved"), F.max("gone").alias("gone")).where("made IS NOT NULL")
        home = self.rings.select(*RING, "part_type")
        placed = state.join(home, list(RING))
        return placed.where("made.pos IS NOT NULL OR part_type <> 'Point'").select(
            *VERTEX, "made.pos", "made.after_id", "made.ts", "made.site_id", "made.seq", F.coalesce("moved.coord", "made.coord").alias("coord"),
            (F.col("gone") & (F.col("part_type") != "Point")).alias("deleted"), F.when(F.col("moved").isNotNull(), F.struct("moved.ts", "moved.site_id", "moved.seq")).alias("move"), "part_type",
        )

    def ordered(self) -> DataFrame:
        """Vertices with their place in the ring (ord, from 0, tombstones included).

        Rings without insertions are ordered by position. The others are walked, each in its own group;
        vertices that hang on one that doesn't exist are left out.
        """
        w = Window.partitionBy(*RING)
        marked = self.vertices.withColumn("inserts", F.max(F.col("pos").isNull()).over(w))
        plain = marked.where("NOT inserts").drop("inserts").withColumn("ord", F.col("pos").cast("bigint"))
        grown = marked.where("inserts").drop("inserts")
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grown.schema.fields) + ", ord bigint"
        return plain.unionByName(grown.groupBy(*RING).applyInArrow(walk, schema))


def document_order(ids: list, parents: list, positions: list, stamps: list) -> list[int]:
    """Row numbers in document order: depth first, below each vertex first the inserted ones, newest first, then the initial one.

    An initial vertex follows the one before it, so initial vertices form a chain. Rows whose chain of
    predecessors doesn't reach the start of the ring are left out.
    """
    below: dict = {}
    chain: dict = {}
    for row, (pos, parent) in enumerate(zip(positions, parents, strict=True)):
        if pos is None:
            below.setdefault(parent, []).append(row)
        else:
            chain[pos] = row
    for rows in below.values():
        rows.sort(key=stamps.__getitem__)
    out, stack, steps = [], [(None, -1)], iter(sorted(chain))
    # The initial successor of a vertex comes after all that is inserted below it: it's pushed first.
    after = {}
    previous = None
    for pos in steps:
        after[previous] = chain[pos]
        previous = ids[chain[pos]]
    while stack:
        own, row = stack.pop()
        if row >= 0:
            out.append(row)
        if own in after:
            nxt = after[own]
            stack.append((ids[nxt], nxt))
        for child in below.get(own, ()):
            stack.append((ids[child], child))
    return out


def walk(group: pa.Table) -> pa.Table:
    """One ring in document order, with ord."""
    stamps = list(zip(group["ts"].to_pylist(), [None if s is None else s.encode() for s in group["site_id"].to_pylist()], group["seq"].to_pylist(), strict=True))
    rows = document_order(group["vertex_id"].to_pylist(), group["after_id"].to_pylist(), group["pos"].to_pylist(), stamps)
    return group.take(pa.array(rows, pa.int64())).append_column("ord", pa.array(range(len(rows)), pa.int64()))


def visible_vertices(t: Tables) -> DataFrame:
    """The structure view: VERTEX, index (among visible vertices of the ring), coord; of parts and rings that aren't deleted.

    Parts and rings come first by position, then the added ones, oldest first: part_no and ring_no.
    """
    rank = lambda: [F.col("pos").isNull(), F.col("pos"), F.col("ts"), F.col("site_id"), F.col("seq")]
    parts = t.parts.where("NOT deleted").withColumn("part_no", F.row_number().over(Window.partitionBy(*FEATURE).orderBy(*rank())) - 1).select(*PART, "part_no")
    rings = t.rings.where("NOT deleted").join(parts, list(PART)).withColumn("ring_no", F.row_number().over(Window.partitionBy(*PART).orderBy(*rank())) - 1).select(*RING, "part_no", "ring_no", "exterior")
    alive = t.ordered().where("NOT deleted").join(rings, list(RING))
    index = F.row_number().over(Window.partitionBy(*RING).orderBy("ord")) - 1
    return alive.select(*VERTEX, "part_no", "ring_no", "exterior", index.alias("index"), "coord")


def ring_sizes(t: Tables) -> DataFrame:
    """RING, visible, total: vertices of each ring that aren't deleted, and all, tombstones included. Deleted rings have their row too.

    Insertions that still wait for their predecessor don't count. Counts are combined map-side.
    """
    counts = t.ordered().groupBy(*RING).agg(F.count(F.when(~F.col("deleted"), 1)).alias("visible"), F.count(F.lit(1)).alias("total"))
    zero = F.lit(0).cast("bigint")
    return t.rings.select(*RING).join(counts, list(RING), "left").select(*RING, F.coalesce("visible", zero).alias("visible"), F.coalesce("total", zero).alias("total"))


def geometries(t: Tables) -> DataFrame:
    """(document_id, feature_id, type, dims, geometry): exported GeoJSON of each feature whose winner has a geometry.

    Deleted parts and polygon rings are skipped, a ring without vertices is an empty array; rings are closed.
    Points and lines are exported whether or not their ring was removed.
    """
    rank = [F.col("pos").isNull().alias("added"), "pos", "ts", "site_id", "seq"]
    coords = t.ordered().where("NOT deleted").groupBy(*RING).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "coord"))), lambda x: x.coord).alias("coords"))
    empty = F.array().cast("array<array<double>>")
    rings = t.rings.where("NOT deleted OR part_type <> 'Polygon'").select(*RING, *rank).join(coords, list(RING), "left").withColumn("coords", F.coalesce("coords", empty))
    by_part = rings.groupBy(*PART).agg(F.transform(F.array_sort(F.collect_list(F.struct("added", "pos", "ts", "site_id", "seq", "coords"))), lambda x: x.coords).alias("rings"))
    no_rings = F.array().cast("array<array<array<double>>>")
    parts = t.parts.where("NOT deleted").select(*PART, *rank).join(by_part, list(PART), "left").withColumn("rings", F.coalesce("rings", no_rings))
    by_feature = parts.groupBy(*FEATURE).agg(F.transform(F.array_sort(F.collect_list(F.struct("added", "pos", "ts", "site_id", "seq", "rings"))), lambda x: x.rings).alias("parts"))
    none = F.array().cast("array<array<array<array<double>>>>")
    whole = t.shapes.select(*FEATURE, "type", "dims").join(by_feature, list(FEATURE), "left").withColumn("parts", F.coalesce("parts", none))
    return whole.select(*FEATURE, "type", "dims", geometry_text("type", "parts").alias("geometry"))


def property_values(op: DataFrame, base: DataFrame) -> DataFrame:
    """Current raw values: (document_id, feature_id, property_key, value) of visible features."""
    op = usable(op)
    won = replay.writes(op, base).groupBy(*FEATURE, "property_key").agg(F.max(F.struct("ts", "site_id", "seq", "gone", "value")).alias("w"))
    alive = replay.liveness(op, base).where("visible").select(*FEATURE)
    return won.where("NOT w.gone").select(*FEATURE, "property_key", F.col("w.value").alias("value")).join(alive, list(FEATURE), "left_semi")


def base_hashes(base: DataFrame) -> DataFrame:
    """(document_id, base_hash): SHA-256 over the namespace and the base features by id, as canonical JSON.

    One row per document; a document's base is one text, as the hash is defined on it.
    """
    once = base.dropDuplicates(list(FEATURE))
    text = F.concat(F.lit('{"id":'), json_text("feature_id"), F.lit(',"geometry":'), F.coalesce(normal_geometry("geometry"), F.lit("null")), F.lit(',"properties":'), object_text("properties"), F.lit("}"))
    rows = once.select("document_id", F.struct("feature_id", text.alias("text")).alias("f"))
    joined = rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x.text), ",").alias("body"))
    whole = F.concat(F.lit('{"document_id":'), json_text("document_id"), F.lit(',"features":['), "body", F.lit("]}"))
    return joined.select("document_id", F.sha2(whole, 256).alias("base_hash"))
