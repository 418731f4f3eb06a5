"""What one merge of a whole log does with each operation.

A batch is applied in stamp order, so registers only ever move forward: feature and property
operations all apply. Edits depend on their generation and on the elements they name. Facts
about operations of other features are joined beforehand, so that each feature can be
replayed alone, in parallel.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions.geojson import geometry_error
from lamina.operators import engine as en
from lamina.operators.geometry import FEATURE, MAKERS
from lamina.operators.messages import IDENTITY, messages
from lamina.operators.replica import Replica, ref_of

RESULT = "document_id string, site_id string, seq bigint, outcome string, reason string"


def _replay(group: pa.Table) -> pa.Table:
    """One feature's generations and edits in stamp order; a row of type ``base`` is its base feature."""
    rows = group.to_pylist()
    base = [r for r in rows if r["type"] == "base"]
    ops = sorted((r for r in rows if r["type"] != "base"), key=en.stamp_of)
    document = rows[0]["document_id"]
    replica = Replica("d", "fold", [(b["feature_id"], b["geometry"], None) for b in base[:1]])
    last: dict = {}
    for op in ops:
        op["properties"] = None
        for own, result in replica._apply(op):
            last[ref_of(own)] = result
        replica.seen[ref_of(op)] = b""
    out = [(document, site, seq, r.outcome, r.reason or None) for (site, seq), r in last.items()]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], ["document_id", "site_id", "seq", "outcome", "reason"])


def outcomes(op: DataFrame, base: DataFrame) -> DataFrame:
    """(document_id, site_id, seq, outcome, reason) of each operation of a log (one row per identity).

    applied, superseded, buffered (still waiting at the end), quarantined; an edit that repeats what is
    so already (a second deletion) is a duplicate. A feature with very many edits is one group: its
    outcome is by definition sequential.
    """
    plain = op.where(~F.col("type").isin(*MAKERS, "edit_geometry")).select(*IDENTITY, F.lit(en.APPLIED).alias("outcome"), F.lit(None).cast("string").alias("reason"))
    stamped = F.struct("ts", "site_id", "seq")
    facts = op.select(
        "document_id", F.col("site_id").alias("gen_site"), F.col("seq").alias("gen_seq"), F.col("feature_id").alias("gen_feature"), F.col("type").alias("gen_type"),
        stamped.alias("gen_stamp"), "geometry",
    )
    made = F.col("gen_type").isin(*MAKERS)
    facts = facts.withColumn("gen_good", made & F.when(made & F.col("geometry").isNotNull(), geometry_error(F.when(made, F.col("geometry"))).isNull()).otherwise(True)).drop("geometry")
    edits = op.where("type = 'edit_geometry' AND geometry_op IS NOT NULL").withColumn("gen_site", F.col("gen.site_id")).withColumn("gen_seq", F.col("gen.seq"))
    placed = edits.join(facts, ["document_id", "gen_site", "gen_seq"], "left")
    own = (F.col("gen_feature") == F.col("feature_id")) & F.col("gen_good")
    foreign = placed.where(F.col("gen").isNotNull() & ~F.coalesce(own, F.lit(False)))
    received = F.coalesce(F.col("gen_stamp") < stamped, F.lit(False))
    adopted = F.coalesce(F.col("gen_good"), F.lit(False))
    foreign = foreign.select(*IDENTITY, F.when(received | adopted, en.QUARANTINED).otherwise(en.BUFFERED).alias("outcome"), F.when(received | adopted, "the operation defines no generation of the feature").alias("reason"))
    columns = [*FEATURE, "type", "site_id", "seq", "ts", "geometry", "gen", "geometry_op"]
    inside = placed.where(F.col("gen").isNull() | own).select(*columns).unionByName(op.where(F.col("type").isin(*MAKERS)).select(*columns))
    zero = F.lit(0).cast("bigint")
    kinds = dict(inside.dtypes)
    bases = base.dropDuplicates(list(FEATURE)).select(*FEATURE, F.lit("base").alias("type"), F.lit("").alias("site_id"), zero.alias("seq"), zero.alias("ts"), "geometry", F.lit(None).cast(kinds["gen"]).alias("gen"), F.lit(None).cast(kinds["geometry_op"]).alias("geometry_op"))
    folded = inside.unionByName(bases).groupBy(*FEATURE).applyInArrow(_replay, RESULT)
    return plain.unionByName(foreign).unionByName(folded)


def tally(rows: DataFrame, op: DataFrame, base: DataFrame) -> DataFrame:
    """(document_id, outcome, ops): outcomes counted per document; further deliveries of an identity count as duplicates."""
    counted = outcomes(op, base).groupBy("document_id", "outcome").agg(F.count(F.lit(1)).alias("ops"))
    again = messages(rows).groupBy(*IDENTITY).agg((F.count(F.lit(1)) - 1).alias("more")).groupBy("document_id").agg(F.sum("more").alias("ops"))
    both = counted.unionByName(again.where("ops > 0").select("document_id", F.lit(en.DUPLICATE).alias("outcome"), "ops"))
    return both.groupBy("document_id", "outcome").agg(F.sum("ops").alias("ops"))
