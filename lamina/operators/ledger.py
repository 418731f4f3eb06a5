"""Processing only new or changed records: a ledger of work items.

A stream (document_id, site_id) is read by attempts that are logged. Work items are blocks of
a stream's numbers. An attempt holds a lease on its stream; when it succeeds, its marks say what is
done: every number up to ``through_seq`` and the staged numbers beyond. Its fencing token is its place
among the stream's successes, and only the newest token's marks count: an older writer is stale whatever it wrote.
Attempts that run, fail, are rolled back or never end hold a lease at most; when that expires their
items are pending again.

``items`` and ``remaining`` read such a log. ``WorkLedger`` is the writing side: leases with fencing
tokens over deterministic work items, kept as a log of Parquet folders published one after another.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import LaminaError
from lamina.operators.messages import messages
from lamina.session import shared_dir
from lamina.sources.folders import FolderLog

STREAM = ("document_id", "site_id")
ITEM = (*STREAM, "block")
#: Copies of the marks table in the join with items; a stream's items spread over as many tasks.
SALTS = 16
#: Numbers per work item: 2**ITEM_BITS.
ITEM_BITS = 10
#: How long an attempt without an end holds its stream.
LEASE = timedelta(hours=1)


class StaleWriter(LaminaError):
    """A worker wrote with a fencing token that is no longer the item's newest."""


def states(runs: DataFrame, now: Column | None = None, lease: timedelta = LEASE) -> DataFrame:
    """The log with the state of each attempt: done, leased or pending.

    done: status is ``succeeded`` in any case. leased: it is marked as running, has no end and its lease,
    which began with started_at, hasn't expired at ``now``. pending: everything else (failed, rolled back,
    expired, unknown); its marks count for nothing. Without ``now`` the next run is about to start,
    so every lease has expired.
    """
    status = F.lower(F.col("status"))
    runs_on = F.col("finished_at").isNull() & status.isin("running", "started")
    held = F.lit(False) if now is None else runs_on & (F.col("started_at") + F.lit(lease) > now)
    state = F.when(status == "succeeded", "done").when(F.coalesce(held, F.lit(False)), "leased").otherwise("pending")
    return runs.withColumn("state", state)


def marks(runs: DataFrame, now: Column | None = None, lease: timedelta = LEASE) -> DataFrame:
    """Of each stream the marks of its newest fencing token, and whether a lease is held: (…, through_seq, staged_seqs, leased).

    The token is (finished_at, through_seq, number of staged): the last success wins, an older one is stale even if
    it got further. Null marks cover nothing. A succeeded attempt without an end comes before all that have one.
    A lease counts only if it began after that success. One row per stream, combined map-side.
    """
    known = states(runs, now, lease)
    done, held = F.col("state") == "done", F.col("state") == "leased"
    token = F.struct(F.col("finished_at"), F.coalesce("through_seq", F.lit(0)).alias("through"), F.coalesce(F.array_size("staged_seqs"), F.lit(0)).alias("staged"))
    last = known.where(done | held).groupBy(*STREAM).agg(
        F.max_by(F.struct("finished_at", "through_seq", "staged_seqs"), F.when(done, token)).alias("last"), F.max(F.when(held, F.col("started_at"))).alias("since")
    )
    leased = F.col("since").isNotNull() & (F.col("last.finished_at").isNull() | (F.col("since") > F.col("last.finished_at")))
    return last.select(*STREAM, F.coalesce("last.through_seq", F.lit(0)).alias("through_seq"), F.col("last.staged_seqs").alias("staged_seqs"), leased.alias("leased"))


def items(rows: DataFrame, runs: DataFrame, now: Column | None = None, lease: timedelta = LEASE) -> DataFrame:
    """Work items of the messages with their state: (document_id, site_id, block, numbers, open, state).

    ``numbers`` are the item's, each once, ``open`` those that the newest token's marks don't cover. done: none
    is open. leased: an unexpired lease holds the stream. pending: the next run has to process the open ones.
    Nulls and empty staged lists mean none; a stream without a success is open as a whole; empty tables give none.

    The numbers of an item are one array of at most 2**ITEM_BITS, built map-side, so a hot stream or number
    reaches the shuffle as its items; staged numbers are cut into items likewise and met on the same keys.
    The join with marks is salted by item.
    """
    block = lambda seq: F.shiftright(seq, ITEM_BITS)
    held = messages(rows).select(*STREAM, "seq", block(F.col("seq")).alias("block")).groupBy(*ITEM).agg(F.collect_set("seq").alias("numbers"))
    ledger = marks(runs, now, lease)
    staged = ledger.select(*STREAM, F.explode("staged_seqs").alias("staged")).where("staged IS NOT NULL")
    staged = staged.withColumn("block", block(F.col("staged"))).groupBy(*ITEM).agg(F.collect_set("staged").alias("staged"))
    met = held.join(staged, list(ITEM), "left").withColumn("salt", F.pmod(F.col("block"), F.lit(SALTS)))
    through = ledger.select(*STREAM, "through_seq", "leased", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")).alias("salt"))
    known = met.join(through, [*STREAM, "salt"], "left")
    beyond = F.filter("numbers", lambda n: n > F.coalesce("through_seq", F.lit(0)))
    left = F.array_except(beyond, F.coalesce("staged", F.array().cast("array<bigint>")))
    state = F.when(F.size("open") == 0, "done").when(F.coalesce("leased", F.lit(False)), "leased").otherwise("pending")
    return known.withColumn("open", left).select(*ITEM, "numbers", "open", state.alias("state"))


def remaining(rows: DataFrame, runs: DataFrame, now: Column | None = None, lease: timedelta = LEASE) -> DataFrame:
    """Identities of messages that the next run of each stream has to process: (document_id, site_id, seq), each once.

    The open numbers of pending items. Items under an unexpired lease at ``now`` aren't offered twice; without
    ``now`` all leases have expired.
    """
    return items(rows, runs, now, lease).where("state = 'pending'").select(*STREAM, F.explode("open").alias("seq"))


def item_id() -> Column:
    """The id of an item depends on its place only, so a retry names the same item and path."""
    return F.sha2(F.to_json(F.array("document_id", "site_id", F.col("block").cast("string"))), 256)


def work_items(found: DataFrame) -> DataFrame:
    """Pending items: (document_id, site_id, block, records, lo, hi, item_id), from items()."""
    pending = found.where("state = 'pending'")
    return pending.select(*ITEM, F.size("open").cast("bigint").alias("records"), F.array_min("open").alias("lo"), F.array_max("open").alias("hi"), item_id().alias("item_id"))


@dataclass(frozen=True)
class Lease:
    """What a worker holds, until when: its items with their fencing tokens (item_id, fence, path)."""

    worker: str
    until: float
    items: DataFrame


EVENTS = "item_id string, event string, fence bigint, worker string, until double"


class WorkLedger:
    """States of work items as a log of Parquet folders in the shared folder; any Hadoop file system will do.

    A change of state (items added, claimed, released, done) is a folder of event rows, published as the next version
    of a FolderLog only if no other came between, so no takeover goes unseen. An item's state is an aggregate
    over its events: the table may hold as many items as any other.

    Every token has an output folder of its own, and readers take the folder of the token that was published as
    done, so a late worker can write only where nobody looks. A retry under one token overwrites its own folder.
    """

    def __init__(self, spark: SparkSession, name: str, clock=time.time) -> None:
        self.root, self.clock = f"{shared_dir(spark)}/ledger/{name}", clock
        self.log = FolderLog(spark, self.root, EVENTS)

    def _at(self, rows: DataFrame) -> DataFrame:
        """State of each item after the given events: (item_id, state, fence, worker, until, path)."""
        rank = F.when(F.col("event") == "done", 2).when(F.col("event") == "release", 1).otherwise(0)
        last = rows.groupBy("item_id").agg(F.max(F.struct("fence", rank.alias("rank"), "worker", "until")).alias("e"), F.max(F.when(F.col("event") == "done", F.struct("fence", "worker"))).alias("d"))
        now = F.lit(float(self.clock()))
        state = F.when(F.col("d").isNotNull(), "done").when((F.col("e.rank") == 0) & (F.col("e.fence") > 0) & (F.col("e.until") > now), "leased").otherwise("pending")
        fence = F.coalesce("d.fence", "e.fence")
        return last.select("item_id", state.alias("state"), fence.alias("fence"), F.coalesce("d.worker", "e.worker").alias("worker"), F.col("e.until").alias("until"), self.path(fence).alias("path"))

    def path(self, fence: Column) -> Column:
        """Where the output of an item under a token goes."""
        return F.concat(F.lit(f"{self.root}/out/item_id="), F.col("item_id"), F.lit("/fence="), fence.cast("string"))

    def table(self) -> DataFrame:
        """All items: (item_id, state, fence, worker, until, path). Of done items ``path`` is where readers find the output."""
        return self._at(self.log.read())

    def _change(self, decide) -> DataFrame:
        """Publish the events that ``decide`` makes of the newest state; the events."""
        columns = [c.split()[0] for c in EVENTS.split(", ")]
        return self.log.read([self.log.change(lambda rows: decide(self._at(rows)).select(*columns))])

    def add(self, items: DataFrame) -> None:
        """Register items (item_id) as pending; known ones stay as they are."""
        none = [F.lit("add").alias("event"), F.lit(0).cast("bigint").alias("fence"), F.lit("").alias("worker"), F.lit(0.0).alias("until")]
        self._change(lambda state: items.select("item_id").distinct().join(state, "item_id", "left_anti").select("item_id", *none))

    def claim(self, worker: str, seconds: float, items: DataFrame | None = None) -> Lease:
        """Lease the pending items (of ``items``, or all), each with the next fencing token. What isn't pending isn't leased."""
        until = self.clock() + seconds

        def take(state: DataFrame) -> DataFrame:
            free = state.where("state = 'pending'")
            free = free if items is None else free.join(items.select("item_id").distinct(), "item_id", "left_semi")
            return free.select("item_id", F.lit("claim").alias("event"), (F.col("fence") + 1).alias("fence"), F.lit(worker).alias("worker"), F.lit(float(until)).alias("until"))

        return Lease(worker, until, self._change(take).select("item_id", "fence", self.path(F.col("fence")).alias("path")))

    def _end(self, lease: Lease, event: str) -> None:
        def end(state: DataFrame) -> DataFrame:
            own = lease.items.select("item_id", F.col("fence").alias("own")).join(state, "item_id", "left")
            stale = own.where("fence IS NULL OR fence <> own").select("item_id", "own").limit(1).collect()
            if stale:
                raise StaleWriter(f"item {stale[0]['item_id']}: token {stale[0]['own']} of {lease.worker} is stale")
            open_ = own.where("state <> 'done'")
            return open_.select("item_id", F.lit(event).alias("event"), F.col("own").alias("fence"), F.lit(lease.worker).alias("worker"), F.lit(0.0).alias("until"))

        self._change(end)

    def complete(self, lease: Lease) -> None:
        """Publish a lease's items as done, all or none. Repeating it is harmless; a token that isn't the newest is refused.

        An expired lease may still complete if nobody took over: its output is whole, and publishing decides.
        """
        self._end(lease, "done")

    def release(self, lease: Lease) -> None:
        """Give a lease's items back: pending again at once."""
        self._end(lease, "release")
