"""A filter of fixed size that keeps most rows without a partner out of a shuffle.

Keys are hashed to one bit of 2**BITS; the bits travel as words in buckets. The table can't grow
beyond 2**BITS bits (4 MiB) whatever the number of keys, so it may be broadcast. A row whose bit is unset
surely has no partner; one whose bit is set may have one, and the exact join that follows decides.
More keys than bits only let more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter has 2**BITS bits.
BITS = 25
#: A bucket has 2**6 words of 2**6 bits.
_BUCKET_BITS = 12


def _place(columns: tuple[str, ...], bits: int) -> tuple[Column, Column, Column]:
    """Bucket, word and bit of a key. Null parts of a key are hashed as such."""
    h = F.xxhash64(F.lit("sieve"), *columns).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftright(h, _BUCKET_BITS).cast("int"), F.shiftright(h, 6).bitwiseAND(F.lit(63)).cast("int"), h.bitwiseAND(F.lit(63)).cast("int")


def sieve(keys: DataFrame, columns: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """The filter of the keys in ``columns``: (sv_bucket, sv_words). Bits are set map-side before the shuffle.

    Every bucket is there, so the table has the same size for few keys and for many.
    """
    bucket, word, bit = _place(columns, bits)
    one = F.expr("shiftleft(1L, sv_bit)")
    set_ = keys.select(bucket.alias("sv_bucket"), word.alias("sv_word"), bit.alias("sv_bit")).groupBy("sv_bucket", "sv_word").agg(F.bit_or(one).alias("sv_bits"))
    unset = keys.sparkSession.range(0, 1 << (bits - _BUCKET_BITS), 1, 1).select(F.col("id").cast("int").alias("sv_bucket"), F.lit(-1).alias("sv_word"), F.lit(0).cast("bigint").alias("sv_bits"))
    words = set_.unionByName(unset)
    held = words.groupBy("sv_bucket").agg(F.map_from_entries(F.collect_list(F.struct("sv_word", "sv_bits"))).alias("sv_map"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("sv_map")[i], F.lit(0).cast("bigint")))
    return held.select("sv_bucket", dense.alias("sv_words"))


def sifted(rows: DataFrame, filter_: DataFrame, columns: tuple[str, ...], keep: bool = True, bits: int = BITS) -> DataFrame:
    """Rows whose key may be in the filter, or with ``keep`` false those whose key surely isn't. Nothing is shuffled."""
    bucket, word, bit = _place(columns, bits)
    placed = rows.select("*", bucket.alias("sv_bucket"), word.alias("sv_word"), bit.alias("sv_bit"))
    met = placed.join(F.broadcast(filter_), "sv_bucket", "left")
    hit = F.coalesce(F.getbit(F.get("sv_words", F.col("sv_word")), F.col("sv_bit")) == 1, F.lit(False))
    return met.where(hit if keep else ~hit).drop("sv_bucket", "sv_word", "sv_bit", "sv_words")
