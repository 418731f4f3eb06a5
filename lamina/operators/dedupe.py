"""Messages delivered more than once: seen ranges per producer, exact lookup for the rest.

A producer is a (document_id, site_id) that numbers its messages 1, 2, 3 …  What has
been seen of it is a set of disjoint ranges, cut at multiples of BLOCK so that one
producer spreads over many tasks however much it sent. A number outside the ranges is
accepted once and joins them; a delivery that finds its number covered is rejected, and only
those few are compared by content, through an exact keyed lookup. Rows whose number is malformed
have no place in a range and are resolved by the lookup alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.canon import op_digest
from lamina.operators.messages import IDENTITY, is_message, messages
from lamina.operators.sieve import sieve, sifted
from lamina.schemas import OP_COLUMNS
from lamina.session import cut

#: Numbers per block: 2**BLOCK_BITS. Bounds the rows of one window partition and the ranges of one block.
BLOCK_BITS = 10
#: Numbers per stretch when whole ranges are put together: 2**STRETCH_BITS.
STRETCH_BITS = 22
PRODUCER = ("document_id", "site_id")
RANGES_DDL = "document_id string, site_id string, block bigint, lo bigint, hi bigint"


def block_of(seq: Column) -> Column:
    return F.shiftright(seq, BLOCK_BITS)


def numbers(rows: DataFrame) -> DataFrame:
    """Each number that arrived: its first delivery and how often it came.

    Only the identity columns are read; the counts are combined before the shuffle,
    so a message delivered by a third of all rows is one row per map task.
    """
    return messages(rows).groupBy(*IDENTITY).agg(F.min("delivery_id").alias("first_delivery"), F.count(F.lit(1)).alias("deliveries"))


def offer(arrived: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """numbers() with ``covered``: whether the number already lies in a seen range.

    ``seen`` has RANGES_DDL, disjoint and cut at blocks, so the join is an equi join on the
    block. The (few) ranges of a block travel as one sorted array.
    """
    if seen is None:
        return arrived.withColumn("covered", F.lit(False))
    by_block = seen.groupBy(*PRODUCER, "block").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = arrived.withColumn("block", block_of(F.col("seq"))).join(by_block, [*PRODUCER, "block"], "left")
    inside = F.exists(F.col("spans"), lambda s: (F.col("seq") >= s.lo) & (F.col("seq") <= s.hi))
    return joined.withColumn("covered", F.coalesce(inside, F.lit(False))).drop("block", "spans")


def merge_ranges(*parts: DataFrame) -> DataFrame:
    """Union of range sets as disjoint, maximal ranges within their blocks.

    Overlapping, touching and repeated ranges melt together. Windows are per block:
    at most 2**BLOCK_BITS rows each once the input is distinct.
    """
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    w = Window.partitionBy(*PRODUCER, "block").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = both.distinct().withColumn("starts", F.when(F.col("lo") <= reach + 1, 0).otherwise(1))
    island = marked.withColumn("island", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*PRODUCER, "block", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def as_ranges(known: DataFrame) -> DataFrame:
    """Seen ranges of numbers (document_id, site_id, seq), repeats allowed, cut at blocks.

    A block's numbers are one array of at most 2**BLOCK_BITS, built map-side, so that what is shuffled are blocks.
    """
    held = known.select(*PRODUCER, "seq", block_of(F.col("seq")).alias("block")).groupBy(*PRODUCER, "block").agg(F.array_sort(F.collect_set("seq")).alias("n"))
    n, last = F.col("n"), F.size("n") - 1
    lows = F.filter(n, lambda x, i: (i == 0) | (F.get(n, i - 1) != x - 1))
    highs = F.filter(n, lambda x, i: (i == last) | (F.get(n, i + 1) != x + 1))
    return held.select(*PRODUCER, "block", F.explode(F.arrays_zip(lows.alias("lo"), highs.alias("hi"))).alias("r")).select(*PRODUCER, "block", "r.lo", "r.hi")


def whole_ranges(ranges: DataFrame) -> DataFrame:
    """Block-cut ranges joined over block borders: (document_id, site_id, lo, hi).

    A producer with very many gaps has very many ranges, so they are never gathered by producer. They
    are numbered within stretches of 2**STRETCH_BITS numbers; one summary row per stretch is then passed
    over to learn where the stretch before ends and how many islands begin before it.
    """
    inside = Window.partitionBy(*PRODUCER, "stretch").orderBy("lo")
    marked = ranges.select(*PRODUCER, "lo", "hi", F.shiftright("lo", STRETCH_BITS).alias("stretch")).withColumn("before", F.lag("hi").over(inside))
    starts = F.when(F.col("before").isNull() | (F.col("lo") > F.col("before") + 1), 1).otherwise(0)
    local = marked.withColumn("starts", starts).withColumn("island", F.sum("starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    merged = local.groupBy(*PRODUCER, "stretch", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    over = Window.partitionBy(*PRODUCER).orderBy("stretch")
    sums = merged.groupBy(*PRODUCER, "stretch").agg(F.min("lo").alias("first_lo"), F.max("hi").alias("last_hi"), F.count(F.lit(1)).alias("islands"))
    sums = sums.withColumn("joins", F.coalesce(F.col("first_lo") == F.lag("last_hi").over(over) + 1, F.lit(False)).cast("bigint"))
    earlier = F.sum(F.col("islands") - F.col("joins")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*PRODUCER, "stretch", (F.coalesce(earlier, F.lit(0)) - F.col("joins")).alias("offset"))
    placed = merged.join(offsets, [*PRODUCER, "stretch"]).withColumn("island", F.col("island") + F.col("offset"))
    return placed.groupBy(*PRODUCER, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def seen_ranges(rows: DataFrame) -> DataFrame:
    """The disjoint ranges of numbers seen per producer."""
    return whole_ranges(as_ranges(messages(rows)))


def digests(rows: DataFrame) -> DataFrame:
    """(identity, delivery_id, digest) of messages; the digest is of the op as data."""
    return rows.select(*IDENTITY, "delivery_id", op_digest(F.struct(*OP_COLUMNS)).alias("digest"))


def taken(arrived: DataFrame) -> DataFrame:
    """Seen ranges that know who took each number: (document_id, site_id, block, lo, hi, firsts, again).

    ``firsts`` has the accepted delivery of each number of the range, ``again`` whether it was offered
    again. A range lies in one block, so both arrays are bounded by its numbers.
    """
    w = Window.partitionBy(*PRODUCER, "block").orderBy("seq")
    placed = arrived.withColumn("block", F.coalesce(block_of(F.col("seq")), F.lit(0))).withColumn("island", F.col("seq") - F.row_number().over(w))
    held = F.array_sort(F.collect_list(F.struct("seq", "first_delivery", (F.col("deliveries") > 1).alias("again"))))
    ranges = placed.groupBy(*PRODUCER, "block", "island").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), held.alias("held"))
    return ranges.select(*PRODUCER, "block", "lo", "hi", F.col("held.first_delivery").alias("firsts"), F.col("held.again").alias("again"))


def contested(rows: DataFrame) -> DataFrame:
    """Messages whose number is offered more than once, with ``rejected``: another delivery took the number before.

    Every message meets the seen range that holds its number; of a number that came once nothing more is
    needed. A fixed-size filter of the numbers that came again keeps most others out of the shuffle before.
    A hot number is split by adaptive execution, as its deliveries meet one small range row.
    """
    arrived = numbers(rows)
    ranges = taken(arrived).select(*[F.col(c).alias(f"r_{c}") for c in (*PRODUCER, "block", "lo", "hi", "firsts", "again")])
    needed = list(dict.fromkeys([*IDENTITY, "delivery_id", *OP_COLUMNS]))
    offers = sifted(messages(rows).select(*needed), sieve(arrived.where("deliveries > 1 AND first_delivery IS NOT NULL"), IDENTITY), IDENTITY).withColumn("block", block_of(F.col("seq")))
    same = [F.col(c) == F.col(f"r_{c}") for c in (*PRODUCER, "block")]
    met = offers.join(ranges, [*same, F.col("seq").between(F.col("r_lo"), F.col("r_hi"))])
    at = (F.col("seq") - F.col("r_lo")).cast("int")
    return met.where(F.get("r_again", at)).select(*needed, (F.col("delivery_id") > F.get("r_firsts", at)).alias("rejected"))


def surplus(rows: DataFrame, seen: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """delivery_id of every message that an earlier delivery (smaller delivery_id) already brought
    with the same identity and content.

    An uncovered number is accepted once and joins its producer's ranges; a delivery that finds its number
    covered is rejected and looked up exactly, by the digest of its content: it is surplus if that content came
    before. Different contents under one identity both stay. Damaged rows are never in the result. Equal delivery_ids:
    neither is surplus.

    ``seen`` are ranges of former runs (RANGES_DDL) and ``earlier`` the messages behind them, in columns as ``rows``:
    those of covered numbers are looked up there, so that copies of a former run's messages are surplus too.

    Shuffles: the identity columns (combined first), narrow ranges, the content of the numbers that came again, and
    their digests (combined first).
    """
    repeated = contested(rows).select(*IDENTITY, "delivery_id", "rejected", op_digest(F.struct(*OP_COLUMNS)).alias("digest"))
    if seen is not None:
        covered = offer(numbers(rows), seen).where("covered").select(*IDENTITY)
        known = sieve(covered, IDENTITY)
        needed = list(dict.fromkeys([*IDENTITY, "delivery_id", *OP_COLUMNS]))
        again = digests(sifted(messages(rows).select(*needed), known, IDENTITY).join(covered, list(IDENTITY), "left_semi")).withColumn("rejected", F.lit(True))
        repeated = repeated.unionByName(again.select(*repeated.columns))
        if earlier is not None:
            former = digests(sifted(messages(earlier).select(*needed), known, IDENTITY).join(covered, list(IDENTITY), "left_semi"))
            repeated = repeated.unionByName(former.withColumn("rejected", F.lit(False)).withColumn("delivery_id", F.lit(None).cast("bigint")).select(*repeated.columns))
    repeated = cut(repeated)  # a few light rows, used twice; the digests are made in Python
    older = F.min(F.coalesce("delivery_id", F.lit(-(1 << 63))))
    first = repeated.groupBy(*IDENTITY, "digest").agg(older.alias("first_delivery"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    hit = repeated.where("rejected").join(first.drop("copies"), [*IDENTITY, "digest"]).where("delivery_id > first_delivery")
    return hit.select("delivery_id") if seen is None else hit.select("delivery_id").distinct()


def deliver_once(rows: DataFrame, seen: DataFrame | None = None, earlier: DataFrame | None = None) -> DataFrame:
    """Rows without surplus deliveries, with all their columns: one delivery of each message.

    Messages by the rule of surplus(): different contents under one identity both stay, also where a former run
    (``seen``, ``earlier``) brought the other. A row whose number is malformed (null or out of range) or whose
    names are blank has no place in a range; it goes to looked_up() alone.
    """
    accepted = messages(rows).join(surplus(rows, seen, earlier), "delivery_id", "left_anti").select(*rows.columns)
    return accepted.unionByName(looked_up(rows, earlier))


def looked_up(rows: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Of the rows that are no messages, the first delivery of each exact content and document, whole.

    Contents that a former run (``earlier``) brought don't come again. A null delivery_id comes after all
    others. Copies are combined map-side, so a row that comes very often is one row per map task.
    """
    key = ("document_id", "digest")

    def keyed(some: DataFrame) -> DataFrame:
        return some.where(~is_message()).select(F.struct(*some.columns).alias("row"), "delivery_id", "document_id", op_digest(F.struct(*OP_COLUMNS)).alias("digest"))

    last = F.coalesce("delivery_id", F.lit((1 << 63) - 1))
    kept = keyed(rows).groupBy(*key).agg(F.min_by("row", last).alias("row"))
    if earlier is not None:
        former = keyed(earlier).select(*[F.col(c).alias(f"f_{c}") for c in key])
        kept = kept.join(former, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in key], "left_anti")
    return kept.select("row.*")
