"""Queries of the text problems (p6 … p8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import mixing, spam, tokens
from lamina.session import table


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of each document."""
    return tokens.corpus_ids(table(spark, sf, "documents"))


def p6_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """Each text decoded from its ids, which gives the text again."""
    ids = tokens.corpus_ids(table(spark, sf, "documents"))
    return ids.select("doc_id", tokens.decode(F.col("ids")).alias("text"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.mix(mixing.sources_of(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen documents of each mix with the number of their uses."""
    return _mix(spark, sf).chosen


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual shares of each mix and source."""
    return _mix(spark, sf).shares


def p7_even(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of mixes made small enough for every source to reach its own."""
    sized = mixing.sources_of(table(spark, sf, "documents"))
    return mixing.mix(sized, table(spark, sf, "mix_targets"), keep_shares=True).shares


def p7_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of mixes of distinct texts, each of which belongs to all sources that have a copy of it."""
    return mixing.mix(mixing.sources_by_copies(table(spark, sf, "documents")), table(spark, sf, "mix_targets")).shares


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of search words, links or product tags."""
    return spam.found(table(spark, sf, "documents"), table(spark, sf, "page_labels"))


def p8_figures(spark: SparkSession, sf: str) -> DataFrame:
    """The figures of each page."""
    return spam.explained(table(spark, sf, "documents"), table(spark, sf, "page_labels"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_even": p7_even, "p7_overlap": p7_overlap, "p8_found": p8_found, "p8_figures": p8_figures}
SQL = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
