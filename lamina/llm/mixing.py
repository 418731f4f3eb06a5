"""Mixing sources to target weights, by a minimum-cost flow over membership patterns.

A document may belong to several sources; documents with the same set of sources form a
pattern. Only the patterns' token totals reach the driver (one row each, however many
documents there are). There the flow routes tokens from patterns to source quotas; the r-th
use of a document costs r - 1, so nothing is repeated while something unused would do. Then
each pattern's documents, in a seeded order, stand on a line as long as their tokens, and
each source takes a stretch of the line, wound around as often as its flow asks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.llm import tokens
from lamina.llm.flow import Network
from lamina.session import BROADCAST_LIMIT, cut

#: Documents per bucket of the seeded order; a window partition holds one bucket of one pattern.
PER_BUCKET = 20_000


@dataclass(frozen=True)
class Target:
    """What a mix asks of one source."""

    mix: str
    source: str
    weight: float
    max_repeats: int
    corpus_fraction: float


def sources_of(documents: DataFrame) -> DataFrame:
    """(doc_id, pattern, n_tokens): the pattern is the one source, trimmed and in lower case; null and blank sources give none."""
    name = F.lower(F.trim(F.col("source")))
    pattern = F.when(F.coalesce(name, F.lit("")) != "", F.array(name)).otherwise(F.array().cast("array<string>"))
    return documents.select("doc_id", pattern.alias("pattern"), tokens.count(F.col("text")).alias("n_tokens"))


def sources_by_copies(documents: DataFrame) -> DataFrame:
    """(doc_id, pattern, n_tokens) of distinct texts: exact copies are one record that belongs to all their sources.

    The copy with the smallest doc_id stands for them. Texts are told apart by their SHA-256, so that only hashes and
    sources are shuffled, combined map-side: a text copied a million times is one row per map task. Null and empty texts,
    which have no tokens, are left out.
    """
    name = F.lower(F.trim(F.col("source")))
    named = documents.where(F.coalesce("text", F.lit("")) != "").select("doc_id", F.when(name != "", name).alias("name"), F.sha2("text", 256).alias("digest"))
    merged = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_set("name")).alias("pattern"))
    sizes = documents.select("doc_id", tokens.count(F.col("text")).alias("n_tokens"))
    return merged.select("doc_id", "pattern").join(sizes, "doc_id")


def read_targets(targets: DataFrame) -> list[Target]:
    """Target rows, sources trimmed and in lower case; a source named twice in a mix adds its weights and keeps the larger limit.

    Null or negative weights count as 0, null or negative limits as 0. The table is small by nature: a row per mix and source.
    """
    name = F.lower(F.trim(F.col("source")))
    rows = (
        targets.where(F.col("mix_name").isNotNull() & (F.coalesce(name, F.lit("")) != ""))
        .groupBy("mix_name", name.alias("source"))
        .agg(F.sum(F.greatest("weight", F.lit(0.0))).alias("w"), F.max("max_repeats").alias("r"), F.max("corpus_fraction").alias("f"))
        .orderBy("mix_name", "source")
        .collect()
    )
    return [Target(r["mix_name"], r["source"], float(r["w"] or 0.0), max(0, int(r["r"] or 0)), float(r["f"] or 0.0)) for r in rows]


def quotas(targets: list[Target], corpus_tokens: int, reachable: dict[str, int] | None = None) -> dict[str, int]:
    """Whole-token quotas of one mix: its size shared by weight, remainders to the largest fractions.

    With ``reachable``, the tokens that each source can give, the size is lowered until every source that has
    documents reaches its share.
    """
    total = sum(t.weight for t in targets)
    if not total:
        return {t.source: 0 for t in targets}
    size = round(corpus_tokens * targets[0].corpus_fraction)
    if reachable is not None:
        size = min([size, *(math.floor(reachable[t.source] * total / t.weight) for t in targets if t.weight and reachable.get(t.source))])
    exact = {t.source: size * t.weight / total for t in targets}
    out = {s: math.floor(x) for s, x in exact.items()}
    short = size - sum(out.values())
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[:short]:
        out[s] += 1
    return out


def route(patterns: list[tuple[tuple[str, ...], int]], targets: list[Target], quota: dict[str, int]) -> dict[tuple[int, str], int]:
    """Tokens that each pattern (by place) gives to each source. patterns: (sources, tokens of one use of all documents)."""
    net, limits = Network(), {t.source: t.max_repeats for t in targets}
    places = {t.source: 2 + len(patterns) + i for i, t in enumerate(targets)}
    arcs = {}
    for i, (sources, size) in enumerate(patterns):
        able = [s for s in sources if limits.get(s, 0) and quota.get(s, 0)]
        for use in range(max((limits[s] for s in able), default=0)):
            net.arc(0, 2 + i, size, use)
        for s in able:
            arcs[i, s] = net.arc(2 + i, places[s], size * limits[s])
    for s, at in places.items():
        net.arc(at, 1, quota.get(s, 0))
    net.run(0, 1)
    return {key: net.used(arc) for key, arc in arcs.items() if net.used(arc)}


@dataclass(frozen=True)
class Mix:
    """The result: chosen (mix_name, source, doc_id, uses, n_tokens) and shares per mix and source."""

    chosen: DataFrame
    shares: DataFrame


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, keep_shares: bool = False) -> Mix:
    """Combine documents (doc_id, pattern, n_tokens) so that each source reaches its share of tokens.

    A mix's size is corpus_fraction of all tokens, unlisted sources included. A source with too few
    tokens gives all it may (each document max_repeats times) and falls short; the others keep to
    their quotas, or, with ``keep_shares``, the mix is made smaller until every source that has documents
    reaches its share. Every share is met within one document's tokens per stretch of the line. Documents
    without tokens are never chosen. Sources without documents, with weight 0 or limit 0 get nothing
    and still have their row in ``shares``.

    Only light columns move: one shuffle by pattern and bucket. Buckets hold about PER_BUCKET
    documents, so a source with a third of all documents spreads over many tasks; offsets of
    buckets come from their sums.
    """
    spark: SparkSession = sized.sparkSession
    wanted = read_targets(targets)
    listed = F.array(*[F.lit(s) for s in sorted({t.source for t in wanted})]) if wanted else F.array().cast("array<string>")
    light = cut(sized.select("doc_id", F.array_sort(F.array_intersect("pattern", listed)).alias("pattern"), F.col("n_tokens").cast("bigint").alias("n_tokens")))
    sums = light.groupBy("pattern").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    corpus = sum(r["tokens"] or 0 for r in sums)
    usable = sorted((tuple(r["pattern"]), int(r["tokens"])) for r in sums if r["pattern"] and r["tokens"])
    width = max(1, math.ceil(max((r["docs"] for r in sums), default=0) / PER_BUCKET))

    stretches, quota_rows = [], []
    for name in sorted({t.mix for t in wanted}):
        own = [t for t in wanted if t.mix == name]
        quota = quotas(own, corpus, {t.source: t.max_repeats * sum(s for p, s in usable if t.source in p) for t in own} if keep_shares else None)
        flow = route(usable, own, quota)
        weights = sum(t.weight for t in own)
        for i, (pattern, size) in enumerate(usable):
            at = 0
            for t in own:
                if got := flow.get((i, t.source)):
                    stretches.append((name, t.source, list(pattern), size, at, at + got))
                    at += got
        quota_rows += [(name, t.source, t.weight / weights if weights else 0.0, quota[t.source], sum(s for p, s in usable if t.source in p), t.max_repeats) for t in own]

    order = F.xxhash64("doc_id", F.lit(seed))
    placed = light.where("n_tokens > 0 AND size(pattern) > 0").withColumn("place", order).withColumn("bucket", F.pmod(F.shiftright("place", 8), F.lit(width)))
    inside = Window.partitionBy("pattern", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("pattern", "bucket").agg(F.sum("n_tokens").alias("held")).withColumn("offset", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    line = placed.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["pattern", "bucket"]).withColumn("start", F.col("start") + F.col("offset"))
    plan = spark.createDataFrame(stretches, "mix_name string, source string, pattern array<string>, length bigint, a bigint, b bigint")
    # A copy k of a document starts at start + k * length; it belongs to the stretch that holds its start.
    turns = lambda x: F.expr(f"CAST(CASE WHEN {x} > start THEN ({x} - start + length - 1) DIV length ELSE 0 END AS BIGINT)")
    # As many rows as patterns that occur times their sources; broadcast by hint only while that is small.
    small = sum(64 + sum(map(len, row[2])) for row in stretches) < BROADCAST_LIMIT
    hit = line.join(F.broadcast(plan) if small else plan, "pattern").withColumn("uses", turns("b") - turns("a")).where("uses > 0")
    chosen = hit.select("mix_name", "source", "doc_id", F.col("uses"), "n_tokens")

    goals = spark.createDataFrame(quota_rows, "mix_name string, source string, target_share double, quota_tokens bigint, available_tokens bigint, max_repeats int")
    got = chosen.groupBy("mix_name", "source").agg(F.sum(F.col("uses") * F.col("n_tokens")).alias("actual_tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    zero = F.lit(0).cast("bigint")
    table = goals.join(got, ["mix_name", "source"], "left").select(*goals.columns, *[F.coalesce(c, zero).alias(c) for c in ("actual_tokens", "documents", "most_uses")])
    whole = F.sum("actual_tokens").over(Window.partitionBy("mix_name"))
    shares = table.withColumn("actual_share", F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0)).withColumn("short", F.col("quota_tokens") > F.col("available_tokens") * F.col("max_repeats"))
    return Mix(chosen, shares)
