"""Queries of the general data problems (p1 … p5) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import dedupe, ledger, nested, orphans, replay
from lamina.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Surplus deliveries."""
    return dedupe.surplus(table(spark, sf, "op_messages"))


def p1_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint seen ranges of each producer."""
    return dedupe.seen_ranges(table(spark, sf, "op_messages"))


def p1_accepted(spark: SparkSession, sf: str) -> DataFrame:
    """The accepted delivery of each identity and how often it came."""
    return dedupe.numbers(table(spark, sf, "op_messages"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Identities that the next run of each stream has to process."""
    return ledger.remaining(table(spark, sf, "op_messages"), table(spark, sf, "sync_runs"))


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """The pending work as items of the ledger."""
    return ledger.work_items(ledger.items(table(spark, sf, "op_messages"), table(spark, sf, "sync_runs")))


def p2_marks(spark: SparkSession, sf: str) -> DataFrame:
    """The marks of each stream's last succeeded run."""
    return ledger.marks(table(spark, sf, "sync_runs")).select("document_id", "site_id", "through_seq", F.coalesce(F.array_size("staged_seqs"), F.lit(0)).alias("staged"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Positions, owners and shares of the ops in snapshots, one row each."""
    return nested.items(table(spark, sf, "replica_snapshots"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return nested.parse(table(spark, sf, "replica_snapshots"))


def p3_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    """Every nested text with the root of its tree, or why it has none; counted per snapshot list and field."""
    rows = _parsed(spark, sf).groupBy("snapshot_id", "op_list", "field").agg(F.count("root").alias("trees"), F.countDistinct("root").alias("distinct_trees"), F.count("error").alias("broken"))
    return rows


def p3_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Each distinct nested object and array once, with its occurrences as a root and below distinct parents."""
    return nested.objects(_parsed(spark, sf))


def p3_bridges(spark: SparkSession, sf: str) -> DataFrame:
    """Parent–child rows between distinct objects, scalars included."""
    return nested.bridges(_parsed(spark, sf))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.orphans(table(spark, sf, "op_messages"), table(spark, sf, "base_features"), table(spark, sf, "geometry_elements"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Edits with an orphan reference: the field, the reason, the month."""
    return _orphans(spark, sf)


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans per document, field, reason and month."""
    return orphans.orphan_counts(_orphans(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Current properties of visible features, the feed having ended."""
    return replay.current(table(spark, sf, "op_messages"), table(spark, sf, "base_features"))


def p5_committed(spark: SparkSession, sf: str) -> DataFrame:
    """Current properties as far as the contiguous committed watermark shows them."""
    return replay.current(table(spark, sf, "op_messages"), table(spark, sf, "base_features"), flush=False)
