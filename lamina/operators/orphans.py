"""References to records that do not exist: orphan references of edits, per field and month.

Every reference of an edit is a foreign key into one of two parents: the messages and base
features that define a geometry generation, and the register of parts, rings and vertices.
The distinct keys meet their parents once; only the suspicious ones are joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.messages import IDENTITY, messages
from lamina.operators.sieve import sieve, sifted
from lamina.session import cut

#: Reference fields in the order in which they count.
FIELDS = ("gen", "part_id", "ring_id", "vertex_id", "after_vertex_id")
#: A foreign key: what it names and all that holds it.
KEY = ("kind", "document_id", "feature_id", "gen_site", "gen_seq", "part", "ring", "vertex")
NEEDS_RING = ("insert_vertex", "move_vertex", "delete_vertex", "remove_ring")
NEEDS_VERTEX = ("move_vertex", "delete_vertex")


def _key(kind: str, part: Column | None = None, ring: Column | None = None, vertex: Column | None = None) -> list[Column]:
    none = F.lit("")
    return [F.lit(kind).alias("kind"), (none if part is None else part).alias("part"), (none if ring is None else ring).alias("ring"), (none if vertex is None else vertex).alias("vertex")]


def edits(rows: DataFrame) -> DataFrame:
    """One row per identity of type edit_geometry: t, its first received_at, and its references.

    A null gen is the base generation, written as site '' and number 0. References that are null
    or empty where one is required aren't references to anything and are left out.
    """
    op = messages(rows).where("type = 'edit_geometry'")
    ref = F.struct(
        F.col("received_at").alias("t"), "feature_id",
        F.coalesce("gen.site_id", F.lit("")).alias("gen_site"), F.coalesce("gen.seq", F.lit(0)).alias("gen_seq"),
        F.col("geometry_op.action").alias("action"), F.col("geometry_op.part_id").alias("part_id"), F.col("geometry_op.ring_id").alias("ring_id"),
        F.col("geometry_op.vertex_id").alias("vertex_id"), F.col("geometry_op.after_vertex_id").alias("after_id"),
    )
    return op.groupBy(*IDENTITY).agg(F.min(ref).alias("r")).select(*IDENTITY, "r.*")


def references(edit: DataFrame) -> DataFrame:
    """The foreign keys of edits(), each with its field's rank: at most four rows an edit."""
    c = F.col

    def entry(rank: int, when: Column, kind: str, *path: Column) -> Column:
        return F.when(when, F.struct(F.lit(rank).alias("rank"), *_key(kind, *path)))

    given = lambda name: c(name).isNotNull() & (c(name) != "")
    has_ring = c("action").isin(*NEEDS_RING) & given("ring_id")
    entries = F.array(
        entry(0, F.lit(True), "gen"),
        entry(1, (F.coalesce(c("action"), F.lit("")) != "add_part") & given("part_id"), "part", c("part_id")),
        entry(2, has_ring, "ring", c("part_id"), c("ring_id")),
        entry(3, c("action").isin(*NEEDS_VERTEX) & given("vertex_id"), "vertex", c("part_id"), c("ring_id"), c("vertex_id")),
        entry(4, (c("action") == "insert_vertex") & given("after_id"), "vertex", c("part_id"), c("ring_id"), c("after_id")),
    )
    each = edit.select(*IDENTITY, "t", "feature_id", "gen_site", "gen_seq", F.explode(F.array_compact(entries)).alias("e"))
    return each.select(*IDENTITY, "t", "feature_id", "gen_site", "gen_seq", "e.*")


def parents(rows: DataFrame, base: DataFrame, elements: DataFrame) -> DataFrame:
    """Everything that can be referred to, once: KEY, since (null: always there), until (null: still there).

    Rows written twice melt; of differing times the earliest counts.
    """
    makers = messages(rows).where(F.col("type").isin("insert_feature", "set_geometry"))
    no_time = F.lit(None).cast("timestamp_ntz")
    generations = makers.select("document_id", "feature_id", F.col("site_id").alias("gen_site"), F.col("seq").alias("gen_seq"), *_key("gen"), F.col("received_at").alias("since"), no_time.alias("until"))
    bases = base.select("document_id", "feature_id", F.lit("").alias("gen_site"), F.lit(0).cast("bigint").alias("gen_seq"), *_key("gen"), no_time.alias("since"), no_time.alias("until"))
    kind, none = F.col("kind"), F.lit("")
    parts = elements.select(
        "document_id", "feature_id",
        F.coalesce("gen.site_id", none).alias("gen_site"), F.coalesce("gen.seq", F.lit(0)).alias("gen_seq"),
        "kind", F.coalesce("part_id", none).alias("part"),
        F.when(kind == "part", none).otherwise(F.coalesce("ring_id", none)).alias("ring"),
        F.when(kind == "vertex", F.coalesce("vertex_id", none)).otherwise(none).alias("vertex"),
        F.col("created_at").alias("since"), F.col("deleted_at").alias("until"),
    )
    every = generations.unionByName(bases).unionByName(parts)
    return every.groupBy(*KEY).agg(F.min("since").alias("since"), F.min("until").alias("until"), F.lit(True).alias("there"))


def reason(t: Column) -> Column:
    """Why a reference is an orphan at t; null where it isn't."""
    return F.when(F.col("there").isNull(), "missing").when(F.col("since") > t, "late").when(F.col("until") < t, "deleted")


def orphans(rows: DataFrame, base: DataFrame, elements: DataFrame) -> DataFrame:
    """Edits with an orphan reference: (document_id, site_id, seq, ref_field, reason, period).

    Only the first orphan field of an edit counts. Distinct keys (combined before the shuffle, with
    the span of times at which they're used) are joined with their parents once; keys that are in
    order over their whole span drop out there. A fixed-size filter of the others lets few references
    through to the join back. Keys are compared as they are written, nowhere by hash.
    """
    refs = references(edits(rows))
    used = refs.groupBy(*KEY).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    checked = used.join(parents(rows, base, elements), list(KEY), "left")
    # Few and light rows, used twice below: written once, or both uses would shuffle all keys.
    suspects = cut(checked.where(reason(F.col("first_t")).isNotNull() | reason(F.col("last_t")).isNotNull()).drop("first_t", "last_t"))
    near = sifted(refs, sieve(suspects, KEY), KEY)
    bad = near.join(suspects, list(KEY)).withColumn("reason", reason(F.col("t"))).where("reason IS NOT NULL")
    first = bad.groupBy(*IDENTITY).agg(F.min(F.struct("rank", "reason", "t")).alias("o"))
    names = F.array(*[F.lit(f) for f in FIELDS])
    return first.select(*IDENTITY, F.element_at(names, F.col("o.rank") + 1).alias("ref_field"), F.col("o.reason").alias("reason"), F.date_format("o.t", "yyyy-MM").alias("period"))


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per document, field, reason and month."""
    return found.groupBy("document_id", "ref_field", "reason", "period").agg(F.count(F.lit(1)).alias("orphans"))
