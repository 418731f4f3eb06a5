"""Applying a change feed: commit-ordered replay of feature and property changes.

A message is a transaction: an insert writes the feature and all properties it lists at
once. Transactions commit in the total order (ts, site_id, seq). A stream's transactions are complete only
up to its first missing number; what lies beyond is held. The missing transaction could belong anywhere after
the last one before the gap, so a document shows its state only up to the least such time among
its streams with a gap: the contiguous committed watermark. Keys don't conflict with each other, so each
(document, feature, key) replays on its own: the newest commit of a key is its state, whatever order commits arrived in.
At the end of a finite feed nothing more can arrive and held transactions are released.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators.clocks import frontier_of
from lamina.operators.messages import messages, not_blank, stamp
from lamina.schemas import OP_COLUMNS

CHANGES = ("insert_feature", "delete_feature", "set_property", "delete_property")
FEATURE = ("document_id", "feature_id")
STREAM = ("document_id", "site_id")


def watermarks(op: DataFrame) -> DataFrame:
    """Per stream how far it may be shown: (document_id, site_id, frontier, until).

    ``frontier`` is the number before the stream's first gap, ``until`` the ts up to which every transaction of the
    document is known, null where no stream of it has a gap. ts rises within a stream, so what is missing is
    newer than the last transaction before its gap.
    """
    mark = frontier_of(op.select(*STREAM, "seq")).select(*STREAM, "frontier", (F.col("highest") > F.col("frontier")).alias("gap"))
    edge = op.select(*STREAM, "seq", "ts").join(mark.where("gap").select(*STREAM, F.col("frontier").alias("seq")), [*STREAM, "seq"], "left_semi").groupBy(*STREAM).agg(F.max("ts").alias("edge"))
    gaps = mark.where("gap").join(edge, list(STREAM), "left").groupBy("document_id").agg(F.min(F.coalesce("edge", F.lit(0))).alias("until"))
    return mark.drop("gap").join(gaps, "document_id", "left")


def staged(rows: DataFrame) -> DataFrame:
    """Changes of messages with ``held``: whether the committed watermark keeps the transaction back.

    The join with watermarks, one row per stream, is salted by number so that a hot stream spreads.
    """
    op = messages(rows)
    marks = watermarks(op).select(*STREAM, "frontier", "until", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<bigint>")).alias("salt"))
    changes = op.where(F.col("type").isin(*CHANGES)).select("document_id", *OP_COLUMNS).withColumn("salt", F.pmod(F.col("seq"), F.lit(16)))
    met = changes.join(marks, [*STREAM, "salt"], "left")
    held = (F.col("seq") > F.col("frontier")) | (F.col("ts") > F.col("until"))
    return met.select("document_id", *OP_COLUMNS, F.coalesce(held, F.lit(False)).alias("held"))


def replayed(rows: DataFrame, ended: bool) -> DataFrame:
    """Transactions that the replay applies: those below the committed watermark and, the feed having ``ended``, those held."""
    each = staged(rows)
    return (each if ended else each.where("NOT held")).drop("held")


def writes(op: DataFrame, base: DataFrame) -> DataFrame:
    """Single-key writes: (document_id, feature_id, property_key, ts, site_id, seq, gone, value).

    The base writes with stamp (0, '', 0), older than any message. Writes without a key (null or
    blank) are no writes.
    """
    key, none = F.col("property_key"), F.lit(None).cast("string")
    single = op.where(F.col("type").isin("set_property", "delete_property") & not_blank(key)).select(
        *FEATURE, "property_key", "ts", "site_id", "seq", (F.col("type") == "delete_property").alias("gone"), "property_value"
    )
    listed = op.where("type = 'insert_feature'").select(*FEATURE, "ts", "site_id", "seq", F.explode("properties").alias("property_key", "property_value"))
    old = base.select(*FEATURE, F.explode("properties").alias("property_key", "property_value"))
    return (
        single.unionByName(listed.withColumn("gone", F.lit(False)))
        .unionByName(old.select(*FEATURE, "property_key", "property_value", F.lit(0).cast("bigint").alias("ts"), F.lit("").alias("site_id"), F.lit(0).cast("bigint").alias("seq"), F.lit(False).alias("gone")))
        .withColumnRenamed("property_value", "value")
        .withColumn("value", F.coalesce("value", none))
    )


def liveness(op: DataFrame, base: DataFrame) -> DataFrame:
    """Per feature: created and deleted, its newest insert and delete stamps, is_base, visible."""
    kept = op.where(F.col("type").isin("insert_feature", "delete_feature"))
    made = kept.select(*FEATURE, F.when(F.col("type") == "insert_feature", stamp()).alias("created"), F.when(F.col("type") == "delete_feature", stamp()).alias("deleted"), F.lit(False).alias("is_base"))
    none = F.lit(None).cast("struct<ts:bigint,site_id:string,seq:bigint>")
    both = made.unionByName(base.select(*FEATURE, none.alias("created"), none.alias("deleted"), F.lit(True).alias("is_base")))
    state = both.groupBy(*FEATURE).agg(F.max("created").alias("created"), F.max("deleted").alias("deleted"), F.max("is_base").alias("is_base"))
    alive = F.when(F.col("deleted").isNull(), F.col("is_base") | F.col("created").isNotNull()).otherwise(F.coalesce(F.col("created") > F.col("deleted"), F.lit(False)))
    return state.withColumn("visible", alive)


def properties(op: DataFrame, base: DataFrame) -> DataFrame:
    """The winning write of each (document, feature, key), tombstones included.

    One partial and one final aggregate; a hot feature or key reaches the shuffle as one row per
    map task. Repeated deliveries don't matter, as they carry the same stamp.
    """
    won = writes(op, base).groupBy(*FEATURE, "property_key").agg(F.max(F.struct("ts", "site_id", "seq", "gone")).alias("w"))
    return won.select(*FEATURE, "property_key", "w.*")


def current(rows: DataFrame, base: DataFrame, flush: bool = True) -> DataFrame:
    """Current properties of visible features: (document_id, feature_id, property_key, site_id, seq).

    The identity is that of the message that set the property; '' and 0 for the base. A property
    outlives deletion and re-insertion of its feature. With ``flush`` the feed has ended: the state is that of the
    committed transactions, overtaken per key by released ones that are newer. Without, only what lies
    below the contiguous committed watermark is shown. Rows written twice, late and out-of-order messages
    make no difference.
    """
    op = replayed(rows, flush)
    seen = liveness(op, base).where("visible").select(*FEATURE)
    alive = properties(op, base).where(~F.col("gone"))
    return alive.join(seen, list(FEATURE), "left_semi").select(*FEATURE, "property_key", "site_id", "seq")
