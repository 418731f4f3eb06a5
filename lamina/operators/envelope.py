"""Context-free validity of wire rows: operations, vector clocks, delta envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.errors import IdentityCollision, InvalidOp
from lamina.functions.canon import CREATED, is_json
from lamina.operators.clocks import covered
from lamina.operators.dedupe import contested, digests
from lamina.operators.messages import IDENTITY, not_blank, well_numbered
from lamina.schemas import ACTIONS, COUNTER_BOUND, OP_TYPES, WIRE_VERSION


def null_geometry(geometry: Column) -> Column:
    """No geometry: null, empty, or JSON null with white space around it; white space alone isn't."""
    return geometry.isNull() | (geometry == "") | geometry.rlike(r"^[ \t\r\n]*null[ \t\r\n]*$")


def shape_error() -> Column:
    """What a geometry edit lacks for its action; null if nothing."""
    e = F.col("geometry_op")
    lacks = lambda field: F.coalesce(e[field], F.lit("")) == ""
    a = F.coalesce(e.action, F.lit(""))
    checks = [
        (~a.isin(*ACTIONS), "unknown geometry action"),
        ((a != "add_part") & lacks("part_id"), "part_id is required"),
        (a.isin("insert_vertex", "move_vertex", "delete_vertex", "remove_ring") & lacks("ring_id"), "ring_id is required"),
        (a.isin("move_vertex", "delete_vertex") & lacks("vertex_id"), "vertex_id is required"),
        ((a == "add_ring") & (F.coalesce(F.size(e.ring), F.lit(0)) <= 0), "ring coordinates are required"),
        ((a == "add_part") & lacks("part"), "a part geometry is required"),
    ]
    return F.coalesce(*[F.when(bad, message) for bad, message in checks])


def created_id_error() -> Column:
    """Whether a creating edit names its element other than derived from its identity."""
    e = F.col("geometry_op")
    out = []
    for action, (field, prefix) in CREATED.items():
        derived = F.concat(F.lit(f"{prefix}:"), F.col("site_id"), F.lit(":"), F.col("seq").cast("string"))
        out.append(F.when((e.action == action) & (F.coalesce(e[field], F.lit("")) != "") & (e[field] != derived), f"{field} must be derived from the operation"))
    return F.coalesce(*out)


def op_error(check_json: bool = True) -> Column:
    """The first reason for which an operation row is invalid; null for a valid one.

    Order: created ids, identity, feature, payload by type. With ``check_json`` raw JSON values are
    parsed in Python (only where they exist); without, only their presence is checked.
    """
    t = F.coalesce(F.col("type"), F.lit(""))
    valid = lambda c: is_json(c) if check_json else F.lit(True)
    has_geometry = t.isin("insert_feature", "set_geometry") & ~null_geometry(F.col("geometry"))
    values = F.map_values("properties")
    checks = [
        created_id_error(),
        F.when(~not_blank(F.col("site_id")), "site_id is required"),
        F.when(~well_numbered(F.col("seq")), "seq is out of range"),
        F.when(~well_numbered(F.col("ts")), "ts is out of range"),
        F.when(~not_blank(F.col("feature_id")), "feature_id is required"),
        F.when(~t.isin(*OP_TYPES), "unknown operation type"),
        F.when(has_geometry & ~F.coalesce(valid(F.when(has_geometry, F.col("geometry"))), F.lit(True)), "geometry must be JSON"),
        F.when((t == "insert_feature") & F.exists(values, lambda v: F.coalesce(v, F.lit("")) == ""), "property values must be JSON"),
        F.when(t.isin("set_property", "delete_property") & ~not_blank(F.col("property_key")), "property_key is required"),
        F.when((t == "set_property") & ((F.coalesce("property_value", F.lit("")) == "") | ~F.coalesce(valid(F.when(t == "set_property", F.col("property_value"))), F.lit(True))), "property_value must be JSON"),
        F.when((t == "edit_geometry") & F.col("geometry_op").isNull(), "geometry_op is required"),
        F.when(t == "edit_geometry", shape_error()),
    ]
    return F.coalesce(*checks)


def require_valid(batch: DataFrame) -> DataFrame:
    """The batch, or InvalidOp with one offending row: a batch is taken whole or not at all."""
    bad = batch.withColumn("error", op_error()).where("error IS NOT NULL").select("document_id", "site_id", "seq", "error").limit(1).collect()
    if bad:
        raise InvalidOp(f"{bad[0]['document_id']}/{bad[0]['site_id']}:{bad[0]['seq']}: {bad[0]['error']}")
    return batch


def collisions(rows: DataFrame) -> DataFrame:
    """Identities under which different contents were delivered: (document_id, site_id, seq, contents).

    Identities that came once can't collide; only the others, as dedupe.contested finds them, are digested.
    """
    variants = digests(contested(rows)).select(*IDENTITY, "digest").distinct()
    return variants.groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("contents")).where("contents > 1")


def require_distinct(rows: DataFrame) -> DataFrame:
    """The rows, or IdentityCollision with one offending identity."""
    bad = collisions(rows).limit(1).collect()
    if bad:
        raise IdentityCollision(f"{bad[0]['document_id']}/{bad[0]['site_id']}:{bad[0]['seq']}")
    return rows


def clock_error(clock: Column) -> Column:
    """Whether a clock map has a blank site or a number out of 0 … 2^62−1; null for a valid or null clock."""
    bad = F.exists(F.map_entries(clock), lambda e: ~not_blank(e.key) | e.value.isNull() | (e.value < 0) | (e.value >= COUNTER_BOUND))
    return F.when(bad, "invalid vector clock")


def delta_error(newest: Column | None = None) -> Column:
    """The first reason for which a delta envelope is invalid: version, names, clock, maps, and how they fit; null for a valid one.

    What was compacted must lie within the vector clock; ``newest``, the largest ts of the delta's operations, within its clock.
    """
    fits = [F.when(~covered(F.col("compacted"), F.col("vector_clock")), "compacted exceeds the vector clock")]
    if newest is not None:
        fits.append(F.when(newest > F.col("clock"), "an operation is newer than the clock"))
    return F.coalesce(
        F.when(F.coalesce(F.col("version"), F.lit(0)) != WIRE_VERSION, "unsupported version"),
        F.when(~not_blank(F.col("document_id")), "document_id is required"),
        F.when(~not_blank(F.col("site_id")), "site_id is required"),
        F.when(F.col("clock").isNull() | (F.col("clock") < 0) | (F.col("clock") >= COUNTER_BOUND), "clock is out of range"),
        clock_error(F.col("vector_clock")),
        clock_error(F.col("compacted")),
        *fits,
    )


def judged_deltas(deltas: DataFrame, rows: DataFrame) -> DataFrame:
    """Delta envelopes with ``error``, their operations (rows with the same batch_id) considered.

    Only the largest ts per batch is joined, combined map-side.
    """
    newest = rows.where("ts IS NOT NULL AND batch_id IS NOT NULL").groupBy(F.col("batch_id").alias("n_batch")).agg(F.max("ts").alias("n_ts"))
    met = deltas.join(newest, F.col("batch_id") == F.col("n_batch"), "left")
    return met.withColumn("error", delta_error(F.col("n_ts"))).drop("n_batch", "n_ts")


#: Members by which a wire edit may repeat its operation's identity.
EMBEDDED = ("site_id", "seq", "ts")


def inherit_identity(rows: DataFrame) -> DataFrame:
    """Operations whose edit carries the identity of its envelope; whatever it said of its own is replaced. Null edits stay null."""
    e = F.col("geometry_op")
    plain = [f for f in rows.schema["geometry_op"].dataType.names if f not in EMBEDDED]
    own = F.struct(*[e[f].alias(f) for f in plain], *[F.col(f).alias(f) for f in EMBEDDED])
    return rows.withColumn("geometry_op", F.when(e.isNotNull(), own))


def strip_identity(rows: DataFrame) -> DataFrame:
    """Operations as they are kept and sent: edits without an identity of their own, which the envelope gives."""
    e = F.col("geometry_op")
    plain = [f for f in rows.schema["geometry_op"].dataType.names if f not in EMBEDDED]
    return rows.withColumn("geometry_op", F.when(e.isNotNull(), F.struct(*[e[f].alias(f) for f in plain])))
