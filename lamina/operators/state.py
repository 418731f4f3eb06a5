"""State of many documents as a table, one row per feature: snapshots, restores and merges without a driver.

A row holds a feature's registers and tombstones, the element tree of its newest generation and the edits that wait,
in the layout of snapshots. ``advance`` merges operations into it, so a snapshot is the advanced base, a restore is
reading the table, and merging a delta after a restore is advancing again. Features don't depend on one another, so each is a
group of its own, whose size is that of the feature and its new operations.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lamina import errors
from lamina.operators.clocks import as_map
from lamina.operators.engine import BUFFERED, stamp_of
from lamina.operators.envelope import judged_deltas
from lamina.operators.replica import Replica, _feature_in, _feature_out, _holds, ref_of
from lamina.operators.snapshots import _plain
from lamina.schemas import FEATURE as FEATURE_DDL
from lamina.schemas import OP_COLUMNS, OP_STRUCT
from lamina.sources.wire import packed

FEATURE = ("document_id", "feature_id")
STATE_DDL = f"document_id string, feature_id string, feature {FEATURE_DDL}, pending array<{OP_STRUCT}>"


def of_base(base: DataFrame) -> DataFrame:
    """The state that base features are in before any operation; of repeated rows one. Broken geometries fail, as a base must be good."""
    kind = base.sparkSession.createDataFrame([], STATE_DDL).schema
    arrow = to_arrow_schema(kind)

    def rows(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = Replica("d", "state", [(row["feature_id"], row["geometry"], dict(row["properties"] or ()))]).features[row["feature_id"]]
                out.append(packed({"document_id": row["document_id"], "feature_id": row["feature_id"], "feature": _feature_out(row["feature_id"], own), "pending": []}, kind))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    once = base.where("document_id IS NOT NULL AND feature_id IS NOT NULL").dropDuplicates(list(FEATURE))
    return once.select(*FEATURE, "geometry", "properties").mapInArrow(rows, kind)


def advance(state: DataFrame, op: DataFrame) -> DataFrame:
    """The state after merging operations (one row per identity; repeats of merged ones change nothing), as STATE_DDL.

    Operations come in any number of batches and any order: the result is the same. Waiting edits travel with their
    feature and apply as soon as what they name is there. Features that hold nothing have no row.
    """
    kind = state.sparkSession.createDataFrame([], STATE_DDL).schema
    arrow = to_arrow_schema(kind)

    def fold(old: pa.Table, new: pa.Table) -> pa.Table:
        rows, ops = old.to_pylist(), [_plain(r) for r in new.to_pylist()]
        document, name = (rows or ops)[0]["document_id"], (rows or ops)[0]["feature_id"]
        replica, waiting = Replica("d", "state"), {}
        if rows and rows[0]["feature"] is not None:
            replica.features[name] = _feature_in(_plain(rows[0]["feature"]))
        held = [_plain(p) for p in (rows[0]["pending"] or ())] if rows else []
        for each in (held, ops):
            for op in sorted(each, key=stamp_of):
                if ref_of(op) in waiting:
                    continue
                op = {c: op[c] for c in OP_COLUMNS} | {"properties": op["properties"] or None}
                for own, result in replica._apply(op):
                    if result.outcome == BUFFERED:
                        waiting[ref_of(own)] = own
                    else:
                        waiting.pop(ref_of(own), None)
        own = replica.features.get(name)
        out = {"document_id": document, "feature_id": name, "feature": _feature_out(name, own) if own and _holds(own) else None, "pending": sorted(waiting.values(), key=stamp_of)}
        keep = [packed(out, kind)] if out["feature"] or out["pending"] else []
        return pa.Table.from_pylist(keep, schema=arrow)

    new = op.select("document_id", *OP_COLUMNS)
    return state.groupBy(*FEATURE).cogroup(new.groupBy(*FEATURE)).applyInArrow(fold, kind)


def refusals(deltas: DataFrame, rows: DataFrame, heads: DataFrame, known: DataFrame, site_id: str) -> DataFrame:
    """Delta envelopes with ``refused``: why a receiver of many documents mustn't merge them; null where it may.

    In this order: version and metadata (envelope), a document that isn't here, another base, operations of the receiver's own
    site beyond its history (its name is used elsewhere), history compacted away that the receiver lacks.

    ``heads``: (document_id, base_hash); ``known``: (document_id, site_id, frontier, highest) as clocks.frontier_of gives;
    ``rows``: the deltas' operations with their batch_id. A clock has one entry per site of a document.
    """
    judged = judged_deltas(deltas, rows)
    here = heads.select(F.col("document_id").alias("h_document"), F.col("base_hash").alias("h_base"))
    clock = as_map(known, "frontier").select(F.col("document_id").alias("k_document"), F.col("vector_clock").alias("k_clock"))
    mine = known.where(F.col("site_id") == site_id).select(F.col("document_id").alias("m_document"), F.col("highest").alias("m_highest"))
    claimed = rows.where(F.col("site_id") == site_id).groupBy(F.col("batch_id").alias("c_batch")).agg(F.max("seq").alias("c_seq"))
    met = judged.join(here, F.col("document_id") == F.col("h_document"), "left").join(clock, F.col("document_id") == F.col("k_document"), "left")
    met = met.join(mine, F.col("document_id") == F.col("m_document"), "left").join(claimed, F.col("batch_id") == F.col("c_batch"), "left")
    empty = F.create_map().cast("map<string,bigint>")
    have = F.coalesce("k_clock", empty)
    gap = F.exists(F.map_entries(F.coalesce("compacted", empty)), lambda e: e.value > F.coalesce(have[e.key], F.lit(0)))
    refused = F.coalesce(
        F.col("error"),
        F.when(F.col("h_document").isNull(), errors.DocumentMismatch.__name__),
        F.when(~F.col("base_hash").eqNullSafe(F.col("h_base")), errors.BaseMismatch.__name__),
        F.when(F.col("c_seq") > F.coalesce("m_highest", F.lit(0)), errors.InvalidOp.__name__),
        F.when(gap, errors.CompactionGap.__name__),
    )
    return met.select(*deltas.columns, refused.alias("refused"))


def summary(state: DataFrame) -> DataFrame:
    """(document_id, feature_id, base, created_ts, deleted_ts, type, vertices) of each feature of a state table."""
    rings: Column = F.flatten(F.transform("feature.geometry.parts", lambda p: p.rings))
    vertices = F.aggregate(rings, F.lit(0).cast("bigint"), lambda n, r: n + F.size(r.vertices))
    return state.where("feature IS NOT NULL").select(
        *FEATURE, F.col("feature.base").alias("base"), F.col("feature.create_reg.ts").alias("created_ts"), F.col("feature.delete_reg.ts").alias("deleted_ts"),
        F.col("feature.geometry.type").alias("type"), F.coalesce(vertices, F.lit(0)).alias("vertices"),
    )
