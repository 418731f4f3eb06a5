"""What counts as a message of the op log, and the log of first deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.sieve import sieve, sifted
from lamina.schemas import COUNTER_BOUND, OP_COLUMNS

#: A character that isn't white space in the Unicode sense (property White_Space); the same text serves SQL engines with RE2.
NOT_SPACE = r"[^\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What identifies a message.
IDENTITY = ("document_id", "site_id", "seq")


def not_blank(column: Column) -> Column:
    """True where a text has a character that isn't white space; false for null."""
    return F.coalesce(column.rlike(NOT_SPACE), F.lit(False))


def well_numbered(column: Column) -> Column:
    """True where a counter lies in 1 … 2^62−1; false for null."""
    return F.coalesce(column.between(1, COUNTER_BOUND - 1), F.lit(False))


def is_message() -> Column:
    """The row condition of a message: names that aren't blank, counters in range.

    That the identity isn't null follows from the rest. It is said all the same, as joins would add it to one use of a
    table and not to another, and equal shuffles would then be made twice.
    """
    counted = well_numbered(F.col("seq")) & well_numbered(F.col("ts"))
    known = F.col("document_id").isNotNull() & F.col("site_id").isNotNull() & F.col("seq").isNotNull()
    return known & counted & not_blank(F.col("document_id")) & not_blank(F.col("site_id")) & not_blank(F.col("type")) & not_blank(F.col("feature_id"))


def messages(rows: DataFrame) -> DataFrame:
    """Rows that are messages. Damaged rows (null or blank names, counters out of range) are left out:
    by the definition of the tables they belong to no query; dedupe.looked_up finds the copies among them.

    An empty table gives an empty one; further columns pass through.
    """
    return rows.where(is_message())


def first_deliveries(rows: DataFrame) -> DataFrame:
    """The op log: of each identity the delivery with the smallest delivery_id, whole.

    Which identities came again is a count over the identity columns, combined map-side. A fixed-size
    filter of them splits the rows: those of identities that came once, most of them, go on without a
    shuffle; only the others meet their first delivery. Both branches read just the columns
    that are used later. delivery_ids are unique; null ones come after all others.
    """
    op = messages(rows).select("delivery_id", "received_at", "document_id", *OP_COLUMNS)
    firsts = op.groupBy(*IDENTITY).agg(F.min("delivery_id").alias("first_delivery"), F.count(F.lit(1)).alias("deliveries")).where("deliveries > 1")
    # The condition always holds; it keeps the aggregate as the join below needs it, so that one shuffle serves both.
    again = sieve(firsts.where("first_delivery IS NOT NULL OR deliveries > 0"), IDENTITY)
    taken = firsts.select(*[F.col(c).alias(f"f_{c}") for c in IDENTITY], "first_delivery")
    met = sifted(op, again, IDENTITY).join(taken, [F.col(c) == F.col(f"f_{c}") for c in IDENTITY], "left")
    chosen = met.where(F.col("f_seq").isNull() | F.col("delivery_id").eqNullSafe(F.col("first_delivery"))).select(*op.columns)
    return sifted(op, again, IDENTITY, keep=False).unionByName(chosen)


def stamp(ts: str = "ts", site: str = "site_id", seq: str = "seq") -> Column:
    """The total order of operations as a struct; structs compare field by field, strings bytewise."""
    return F.struct(F.col(ts).alias("ts"), F.col(site).alias("site_id"), F.col(seq).alias("seq"))
