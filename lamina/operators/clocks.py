"""Vector clocks: contiguous frontiers, staged numbers, coverage, merges.

Internally a clock is rows (document_id, site_id, seq); at the edges a MAP<STRING,BIGINT>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import dedupe

STREAM = ("document_id", "site_id")


def _ranges(known: DataFrame, compacted: DataFrame | None) -> DataFrame:
    """Whole disjoint ranges of known numbers per stream, what was compacted away included."""
    spans = dedupe.whole_ranges(dedupe.as_ranges(known))
    if compacted is None:
        return spans
    base = compacted.where("seq > 0").groupBy(*STREAM).agg(F.max("seq").alias("base"))
    joined = spans.join(base, list(STREAM), "full").withColumn("base", F.coalesce("base", F.lit(0)))
    return joined.select(*STREAM, "lo", "hi", "base")


def frontier_of(known: DataFrame, compacted: DataFrame | None = None) -> DataFrame:
    """Per stream: frontier, the number up to which everything is known, and highest, the largest known.

    ``known``: (document_id, site_id, seq), repeats allowed. ``compacted``: numbers folded into a
    snapshot per stream; the frontier starts there. A stream whose number 1 is missing has frontier 0
    (or its compacted number). Numbers are condensed to ranges within blocks before any stream is
    looked at as a whole, so a hot stream costs its gaps, not its messages.
    """
    spans = _ranges(known, compacted)
    if compacted is None:
        first = F.max(F.when(F.col("lo") == 1, F.col("hi")))
        return spans.groupBy(*STREAM).agg(F.coalesce(first, F.lit(0).cast("bigint")).alias("frontier"), F.max("hi").alias("highest"))
    reach = F.max(F.when(F.col("lo") <= F.col("base") + 1, F.greatest("hi", "base")))
    return spans.groupBy(*STREAM).agg(F.coalesce(reach, F.max("base")).alias("frontier"), F.greatest(F.max("hi"), F.max("base")).alias("highest"))


def staged(known: DataFrame, compacted: DataFrame | None = None) -> DataFrame:
    """Ranges received beyond a gap: (document_id, site_id, lo, hi)."""
    spans = _ranges(known, compacted)
    lower = F.lit(1) if compacted is None else F.col("base") + 1
    return spans.where(F.col("lo") > lower).select(*STREAM, "lo", "hi")


def gaps(known: DataFrame) -> DataFrame:
    """Ranges of numbers that are missing below a known one: (document_id, site_id, lo, hi).

    The end of the range before is found within a stretch of numbers; a stretch's first range takes it from the stretch's
    summary, so that a stream of many gaps isn't gathered.
    """
    spans = _ranges(known, None).withColumn("stretch", F.shiftright("lo", dedupe.STRETCH_BITS))
    inside, over = Window.partitionBy(*STREAM, "stretch").orderBy("lo"), Window.partitionBy(*STREAM).orderBy("stretch")
    ends = spans.groupBy(*STREAM, "stretch").agg(F.max("hi").alias("last")).select(*STREAM, "stretch", F.lag("last").over(over).alias("earlier"))
    before = F.coalesce(F.lag("hi").over(inside), "earlier", F.lit(0))
    between = spans.join(ends, [*STREAM, "stretch"]).select(*STREAM, (before + 1).alias("from"), (F.col("lo") - 1).alias("to"))
    return between.where("from <= to").select(*STREAM, F.col("from").alias("lo"), F.col("to").alias("hi"))


def applied(known: DataFrame, compacted: DataFrame | None = None) -> DataFrame:
    """Per stream the highest number seen, also beyond gaps, or compacted."""
    both = known.select(*STREAM, "seq") if compacted is None else known.select(*STREAM, "seq").unionByName(compacted.select(*STREAM, "seq"))
    return both.groupBy(*STREAM).agg(F.max("seq").alias("applied"))


def lamport(op: DataFrame) -> DataFrame:
    """Per document the Lamport clock: the largest ts."""
    return op.groupBy("document_id").agg(F.max("ts").alias("clock"))


def merged(a: Column, b: Column) -> Column:
    """Pointwise maximum of two clock maps; a null map is an empty clock."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def covered(a: Column, b: Column) -> Column:
    """Whether clock map ``b`` has at least every entry of ``a``; null maps are empty clocks."""
    empty = F.create_map().cast("map<string,bigint>")
    have = F.coalesce(b, empty)
    return F.forall(F.map_entries(F.coalesce(a, empty)), lambda e: e.value <= F.coalesce(have[e.key], F.lit(0)))


def as_map(clock: DataFrame, value: str = "seq") -> DataFrame:
    """Clock rows as one map per document, in site order. A document's clock has a row per site."""
    pairs = F.array_sort(F.collect_list(F.struct("site_id", F.col(value).alias("seq"))))
    return clock.groupBy("document_id").agg(F.map_from_entries(pairs).alias("vector_clock"))


def as_rows(maps: DataFrame, column: str) -> DataFrame:
    """A clock map column as rows; null maps give none."""
    return maps.select("document_id", F.explode(column).alias("site_id", "seq"))


def beyond(op: DataFrame, clock: DataFrame) -> DataFrame:
    """Operations that a peer with ``clock`` (document_id, site_id, seq) lacks. Sites it doesn't know count from 0.

    One equi join on the stream; adaptive execution broadcasts the clock while it's small and splits hot streams else.
    """
    known = clock.groupBy(*STREAM).agg(F.max("seq").alias("_known"))
    return op.join(known, list(STREAM), "left").where(F.col("seq") > F.coalesce("_known", F.lit(0))).drop("_known")
