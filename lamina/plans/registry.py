"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamina.plans import log, log_sql, problems, problems_sql

Query = Callable[[SparkSession, str], DataFrame]
PROBLEMS = (
    "p1_found", "p1_ranges", "p1_accepted", "p2_found", "p2_items", "p2_marks", "p3_found", "p3_occurrences", "p3_objects", "p3_bridges",
    "p4_found", "p4_counts", "p5_found", "p5_committed",
)
LOG = (
    "generation_winner", "edit_generation_status", "geometry_parts", "ring_order", "vertex_state", "rga_order", "structure_view", "ring_sizes", "export_geometry", "geometry_from_tables",
    "envelope_errors", "identity_collisions", "delta_errors", "op_dedup", "frontier", "staged_ops", "sequence_gaps", "applied_clock", "lamport_clock",
    "delta_since", "clock_merge", "clock_pairs", "compaction_gap", "outbox_pending", "feature_liveness", "property_lww", "property_tombstones",
    "property_values", "visible_features", "geometry_layout", "vertex_at_index", "export_features", "export_feature_collection", "lineage_hash", "single_geometries",
    "signed_area", "dedup_positions", "close_ring", "orient_ring", "degenerate_ring", "polygon_validity", "polygon_repair", "normalized_geometry",
    "merge_outcomes", "merge_tally", "snapshot_violations", "snapshot_state", "state_table", "delta_refusals", "op_store", "delta_wire", "rebase_base", "rebase_unsafe", "stream_merge", "stream_edits",
)


def queries() -> dict[str, Query]:
    return {name: getattr(problems, name) for name in PROBLEMS} | {name: getattr(log, name) for name in LOG}


def oracle_sql() -> dict[str, str]:
    return problems_sql.SQL | log_sql.SQL
