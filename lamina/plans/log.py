"""Queries of the operation log's own operators: clocks, registers, geometry, exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import topology as topo
from lamina.functions.geojson import normal_geometry, shape
from lamina.operators import clocks, envelope, export, outcomes, replay, single, snapshots, state
from lamina.operators import geometry as geo
from lamina.operators.messages import first_deliveries, messages
from lamina.session import shared_dir, table
from lamina.sources import wire
from lamina.sources.stores import OpStore
from lamina.streaming import edits
from lamina.streaming import merge as live


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return first_deliveries(table(spark, sf, "op_messages"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "base_features")


def _tables(spark: SparkSession, sf: str) -> geo.Tables:
    return geo.Tables(_log(spark, sf), _base(spark, sf))


def generation_winner(spark: SparkSession, sf: str) -> DataFrame:
    """The winning geometry generation of each feature."""
    return geo.winners(geo.usable(_log(spark, sf)), _base(spark, sf)).select("document_id", "feature_id", "gen_site", "gen_seq", "gen_ts")


def edit_generation_status(spark: SparkSession, sf: str) -> DataFrame:
    """current, superseded, buffered or quarantined, by generation, of each edit."""
    return geo.edit_status(_log(spark, sf), _base(spark, sf))


def geometry_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the winning generations."""
    return _tables(spark, sf).parts.select("document_id", "feature_id", "part_id", "part_type", "deleted")


def ring_order(spark: SparkSession, sf: str) -> DataFrame:
    """Rings of the winning generations with their key."""
    return _tables(spark, sf).rings.select("document_id", "feature_id", "part_id", "ring_id", "pos", "ts", "exterior", "deleted")


def vertex_state(spark: SparkSession, sf: str) -> DataFrame:
    """Vertices with the position of their newest move and their tombstone."""
    return _tables(spark, sf).vertices.select("document_id", "feature_id", "part_id", "ring_id", "vertex_id", F.col("coord")[0].alias("x"), F.col("coord")[1].alias("y"), "deleted")


def rga_order(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each vertex in its ring, tombstones included."""
    return _tables(spark, sf).ordered().select("document_id", "feature_id", "part_id", "ring_id", "vertex_id", "ord")


def structure_view(spark: SparkSession, sf: str) -> DataFrame:
    """Visible vertices with their index."""
    return geo.visible_vertices(_tables(spark, sf)).select("document_id", "feature_id", "part_id", "ring_id", "vertex_id", "part_no", "ring_no", "index")


def export_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON geometry of each feature."""
    return export.geometries(_log(spark, sf), _base(spark, sf))


def geometry_from_tables(spark: SparkSession, sf: str) -> DataFrame:
    """GeoJSON geometry of each feature, put together from the element tables."""
    return geo.geometries(_tables(spark, sf))


def ring_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Visible and all vertices of each ring."""
    return geo.ring_sizes(_tables(spark, sf))


# --- validity ---


def envelope_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered rows by the first reason for which they are invalid."""
    return table(spark, sf, "op_messages").withColumn("error", envelope.op_error()).groupBy("error").agg(F.count(F.lit(1)).alias("deliveries"))


def identity_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Identities claimed by different contents."""
    return envelope.collisions(table(spark, sf, "op_messages"))


def delta_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Delta envelopes by the first reason for which they are invalid."""
    judged = envelope.judged_deltas(table(spark, sf, "delta_batches"), messages(table(spark, sf, "op_messages")))
    return judged.groupBy("error").agg(F.count(F.lit(1)).alias("batches"))


# --- clocks ---


def op_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The log's operations per document and type."""
    return _log(spark, sf).groupBy("document_id", "type").agg(F.count(F.lit(1)).alias("ops"))


def frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Contiguous frontier and highest number of each stream."""
    return clocks.frontier_of(messages(table(spark, sf, "op_messages")))


def staged_ops(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges received beyond a gap."""
    return clocks.staged(messages(table(spark, sf, "op_messages")))


def sequence_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of missing numbers."""
    return clocks.gaps(messages(table(spark, sf, "op_messages")))


def applied_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Highest number of each stream, gaps or not."""
    return clocks.applied(messages(table(spark, sf, "op_messages")))


def lamport_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Largest ts of each document."""
    return clocks.lamport(messages(table(spark, sf, "op_messages")))


def _peer(spark: SparkSession, sf: str) -> DataFrame:
    """What each document's last snapshot had synced: clock rows."""
    return clocks.as_rows(table(spark, sf, "delta_batches"), "vector_clock").groupBy("document_id", "site_id").agg(F.min("seq").alias("seq"))


def delta_since(spark: SparkSession, sf: str) -> DataFrame:
    """Operations that a peer lacks whose clock is the least that any delta of the document was sent with."""
    return clocks.beyond(_log(spark, sf), _peer(spark, sf)).select("document_id", "site_id", "seq", "type")


def clock_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Pointwise maximum of all clocks sent for a document."""
    return clocks.as_rows(table(spark, sf, "delta_batches"), "vector_clock").groupBy("document_id", "site_id").agg(F.max("seq").alias("seq"))


def clock_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Clock and compacted clock of each delta merged as maps, and whether the first covers the second."""
    d = table(spark, sf, "delta_batches").where("compacted IS NOT NULL").dropDuplicates(["batch_id"])
    both = clocks.merged(F.col("vector_clock"), F.col("compacted"))
    total = F.aggregate(F.map_values(both), F.lit(0).cast("bigint"), lambda a, v: a + v)
    return d.select("batch_id", total.alias("merged_total"), clocks.covered(F.col("compacted"), F.col("vector_clock")).alias("covered"))


def compaction_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas whose sender compacted more than the receiver of all messages knows contiguously."""
    d = table(spark, sf, "delta_batches").where("compacted IS NOT NULL").select("batch_id", "document_id", F.explode("compacted").alias("site_id", "needed")).distinct()
    known = frontier(spark, sf).select("document_id", "site_id", "frontier")
    beyond = d.join(known, ["document_id", "site_id"], "left").where("needed > coalesce(frontier, 0)")
    return beyond.groupBy("batch_id").agg(F.count(F.lit(1)).alias("sites"))


def outbox_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Own operations of snapshots beyond what was synced: count and watermark per snapshot."""
    s = table(spark, sf, "replica_snapshots").dropDuplicates(["id"])
    pending = F.filter(F.coalesce("outbox_ops", F.array().cast(s.schema["outbox_ops"].dataType)), lambda o: (o.site_id == F.col("site_id")) & (o.seq > F.col("synced_through")))
    last = F.array_max(F.transform(pending, lambda o: o.seq))
    return s.select("id", F.size(pending).cast("bigint").alias("pending"), F.greatest("synced_through", last).alias("watermark"))


# --- registers and reads ---


def feature_liveness(spark: SparkSession, sf: str) -> DataFrame:
    """Liveness registers of each feature."""
    return replay.liveness(geo.usable(_log(spark, sf)), _base(spark, sf)).select(
        "document_id", "feature_id", "is_base", F.col("created.ts").alias("created_ts"), F.col("deleted.ts").alias("deleted_ts"), "visible"
    )


def property_lww(spark: SparkSession, sf: str) -> DataFrame:
    """The winning write of each property register."""
    return replay.properties(geo.usable(_log(spark, sf)), _base(spark, sf))


def property_tombstones(spark: SparkSession, sf: str) -> DataFrame:
    """Deleted property registers."""
    return property_lww(spark, sf).where("gone").drop("gone")


def property_values(spark: SparkSession, sf: str) -> DataFrame:
    """Raw values of the current properties of visible features."""
    return geo.property_values(_log(spark, sf), _base(spark, sf))


def visible_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features that exist now."""
    return feature_liveness(spark, sf).where("visible").select("document_id", "feature_id")


def geometry_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinate layout of visible features with a geometry."""
    shapes = _tables(spark, sf).shapes.select("document_id", "feature_id", F.when(F.col("dims") == 3, "XYZ").otherwise("XY").alias("layout"))
    return shapes.join(visible_features(spark, sf), ["document_id", "feature_id"], "left_semi")


def vertex_at_index(spark: SparkSession, sf: str) -> DataFrame:
    """The vertex at index 2 of each ring."""
    return structure_view(spark, sf).where("index = 2").select("document_id", "feature_id", "part_id", "ring_id", "vertex_id")


def export_features(spark: SparkSession, sf: str) -> DataFrame:
    """Visible features as GeoJSON texts."""
    return export.features(_log(spark, sf), _base(spark, sf))


def export_feature_collection(spark: SparkSession, sf: str) -> DataFrame:
    """One FeatureCollection text per document, features by id."""
    rows = export_features(spark, sf)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "feature"))), lambda x: x.feature)
    body = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(texts, ","), F.lit("]}"))
    return rows.groupBy("document_id").agg(body.alias("collection"))


def single_geometries(spark: SparkSession, sf: str) -> DataFrame:
    """Base geometries as single ones, each with its lineage and what the edits of its base generation make of it."""
    own = F.concat_ws("/", "document_id", "feature_id").alias("geometry_id")
    bases = _base(spark, sf).where("geometry IS NOT NULL").dropDuplicates(["document_id", "feature_id"]).select(own, "geometry")
    changes = _log(spark, sf).where("type = 'edit_geometry' AND gen IS NULL").select(own, "site_id", "seq", "ts", "geometry_op")
    return single.geometries(changes, bases).join(single.lineages(bases), "geometry_id").select("geometry_id", "type", "geometry", "lineage")


def lineage_hash(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of each document's base."""
    return geo.base_hashes(_base(spark, sf))


# --- polygons ---


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    """Polygon rings as they were sent: of add_ring messages, of the geometries and parts in messages, and of base features.

    (origin, part_no, ring_no, ring): the origin names the delivery or the base feature. Broken geometries have none.
    """
    op = messages(table(spark, sf, "op_messages"))
    zero = F.lit(0)
    added = op.where("geometry_op.action = 'add_ring' AND geometry_op.ring IS NOT NULL").select(F.concat(F.lit("ring:"), "delivery_id").alias("origin"), zero.alias("part_no"), zero.alias("ring_no"), F.col("geometry_op.ring").alias("ring"))
    texts = op.where(F.col("type").isin(*geo.MAKERS)).select(F.concat(F.lit("geometry:"), "delivery_id").alias("origin"), "geometry")
    texts = texts.unionByName(op.where("geometry_op.action = 'add_part'").select(F.concat(F.lit("part:"), "delivery_id").alias("origin"), F.col("geometry_op.part").alias("geometry")))
    base = _base(spark, sf).dropDuplicates(["document_id", "feature_id"]).select(F.concat(F.lit("base:"), "document_id", F.lit("/"), "feature_id").alias("origin"), "geometry")
    shapes = texts.unionByName(base).where("geometry IS NOT NULL").withColumn("s", shape("geometry")).where("s.error IS NULL AND s.type LIKE '%Polygon'")
    vertices = shapes.select("origin", F.explode("s.vertices").alias("v")).groupBy("origin", F.col("v.part").alias("part_no"), F.col("v.ring").alias("ring_no"))
    opened = vertices.agg(F.transform(F.array_sort(F.collect_list(F.struct("v.pos", "v.coord"))), lambda x: x.coord).alias("ring"))
    return added.unionByName(opened)


def signed_area(spark: SparkSession, sf: str) -> DataFrame:
    """Shoelace area of rings."""
    return _rings(spark, sf).select("origin", "part_no", "ring_no", F.round(topo.signed_area(F.col("ring")), 6).alias("area"))


def dedup_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of rings, with their closing, once consecutive repeats are gone."""
    doubled = F.concat("ring", F.slice("ring", -1, 1))
    return _rings(spark, sf).select("origin", "part_no", "ring_no", F.size(topo.without_duplicates(doubled)).alias("positions"))


def close_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Rings closed: how many positions, and the last one."""
    c = topo.closed(F.col("ring"))
    return _rings(spark, sf).select("origin", "part_no", "ring_no", F.size(c).alias("positions"), F.get(c, F.size(c) - 1)[0].alias("last_x"))


def orient_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Closed rings turned both ways, as holes and as exteriors are: their second positions."""
    hole, outer = (topo.oriented(topo.closed(F.col("ring")), F.lit(way)) for way in (False, True))
    second = lambda ring, k: F.get(ring, F.lit(1))[k]
    return _rings(spark, sf).select("origin", "part_no", "ring_no", second(hole, 0).alias("x"), second(hole, 1).alias("y"), second(outer, 0).alias("outer_x"), second(outer, 1).alias("outer_y"))


def degenerate_ring(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the first two positions of rings alone, and all of them, are degenerate."""
    return _rings(spark, sf).select("origin", "part_no", "ring_no", topo.degenerate(F.slice("ring", 1, 2)).alias("cut"), topo.degenerate(F.col("ring")).alias("whole"))


def polygon_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Exported polygons that are not valid, and why."""
    rows = export_geometry(spark, sf).withColumn("problem", topo.polygon_problem("geometry")).where("problem IS NOT NULL")
    return rows.select("document_id", "feature_id", "problem")


def polygon_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Exported geometries with all basic repairs."""
    return export_geometry(spark, sf).select("document_id", "feature_id", topo.polygon_repair(F.col("geometry")).alias("geometry"))


def normalized_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Base geometries parsed and exported again."""
    return _base(spark, sf).dropDuplicates(["document_id", "feature_id"]).select("document_id", "feature_id", normal_geometry("geometry").alias("geometry"))


# --- merges, stores, snapshots, streams ---


def merge_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What one merge of the log does with each operation."""
    return outcomes.outcomes(_log(spark, sf), _base(spark, sf))


def merge_tally(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes per document, repeated deliveries as duplicates."""
    return outcomes.tally(table(spark, sf, "op_messages"), _log(spark, sf), _base(spark, sf))


def snapshot_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Structural rules that snapshots break."""
    return snapshots.judged(table(spark, sf, "replica_snapshots"))


def snapshot_state(spark: SparkSession, sf: str) -> DataFrame:
    """Features held by snapshots: registers flattened, one row per snapshot and feature."""
    s = table(spark, sf, "replica_snapshots").groupBy("id").agg(F.first("features").alias("features"))
    f = s.select(F.col("id").alias("snapshot_id"), F.explode("features").alias("f"))
    vertices = F.aggregate(
        F.flatten(F.transform(F.coalesce("f.geometry.parts", F.array().cast(dict(f.select("f.geometry.parts").dtypes)["parts"])), lambda p: p.rings)),
        F.lit(0).cast("bigint"), lambda n, r: n + F.size(r.vertices),
    )
    return f.select("snapshot_id", F.col("f.id").alias("feature_id"), F.col("f.base").alias("base"), F.col("f.create_reg.ts").alias("created_ts"), F.col("f.delete_reg.ts").alias("deleted_ts"), F.col("f.geometry.type").alias("type"), vertices.alias("vertices"))


def state_table(spark: SparkSession, sf: str) -> DataFrame:
    """Features of all documents after two merges, one of the even and one of the odd numbers: registers and trees, summed up."""
    log = _log(spark, sf)
    half = state.advance(state.of_base(_base(spark, sf)), log.where("seq % 2 = 0"))
    return state.summary(state.advance(half, log.where("seq % 2 = 1")))


def delta_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas by the reason for which a receiver of the whole log, named "reader", refuses them."""
    rows = messages(table(spark, sf, "op_messages"))
    heads = table(spark, sf, "replica_snapshots").groupBy("document_id").agg(F.min("base_hash").alias("base_hash"))
    found = state.refusals(table(spark, sf, "delta_batches"), rows, heads, clocks.frontier_of(rows), "reader")
    return found.groupBy("refused").agg(F.count(F.lit(1)).alias("batches"))


def op_store(spark: SparkSession, sf: str) -> DataFrame:
    """The log appended to a store twice and scanned beyond the least clock sent."""
    store = OpStore(spark, f"{shared_dir(spark)}/op_store-{uuid.uuid4().hex}")
    log = _log(spark, sf)
    store.append(log)
    store.append(log)
    return store.since(_peer(spark, sf)).select("document_id", "site_id", "seq", "type")


def delta_wire(spark: SparkSession, sf: str) -> DataFrame:
    """Deltas of what each document's peer lacks, as wire texts."""
    log = _log(spark, sf)
    heads = table(spark, sf, "delta_batches").groupBy("document_id").agg(F.max(F.struct("version", "site_id", "base_hash")).alias("h"))
    clock = clocks.as_map(clocks.frontier_of(log), "frontier")
    envelopes = heads.join(clocks.lamport(log), "document_id").join(clock, "document_id").select("h.version", "document_id", "h.site_id", "h.base_hash", "clock", "vector_clock", F.lit(None).cast("map<string,bigint>").alias("compacted"))
    return wire.delta_rows(clocks.beyond(log, _peer(spark, sf)), envelopes)


def rebase_base(spark: SparkSession, sf: str) -> DataFrame:
    """The base of each document's next epoch: its visible features with geometry and current properties (name=value, by name)."""
    next_ = export.next_base(_log(spark, sf), _base(spark, sf))
    named = F.transform(F.array_sort(F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))), lambda e: F.concat(e.key, F.lit("="), F.coalesce(e.value, F.lit(""))))
    return next_.select("document_id", "feature_id", "geometry", F.array_join(named, "\n").alias("properties"))


def rebase_unsafe(spark: SparkSession, sf: str) -> DataFrame:
    """Why documents can't be cut yet: delivery gaps, edits that still wait."""
    gaps = staged_ops(spark, sf).groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select("document_id", F.lit("delivery gaps").alias("reason"), "n")
    waiting = merge_outcomes(spark, sf).where("outcome = 'buffered'").groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).select("document_id", F.lit("waiting edits").alias("reason"), "n")
    return gaps.unionByName(waiting)


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """op_messages as a stream of files."""
    batch = table(spark, sf, "op_messages")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/op_messages.parquet")
    alone = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()  # a stream reads folders, so a single file is picked from its own
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "op_messages.parquet" if alone else "*.parquet").option("maxFilesPerTrigger", 4).parquet(sf if alone else str(path))


def stream_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Current properties after the messages came in as a stream."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    live.run_available(_stream(spark, sf), f"{at}/out", f"{at}/checkpoint")
    return live.settle(spark.read.schema(live.OUTPUT).parquet(f"{at}/out/*"), _base(spark, sf))


def stream_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Geometries after the messages came in as a stream."""
    at = f"{shared_dir(spark)}/edits-{uuid.uuid4().hex}"
    edits.run_available(_stream(spark, sf), _base(spark, sf), f"{at}/out", f"{at}/checkpoint")
    return edits.settle(spark.read.schema(edits.OUTPUT).parquet(f"{at}/out/*"), _base(spark, sf))
