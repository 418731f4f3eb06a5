"""Merging the live op stream: registers as keyed state, exactly once per stamp.

Late and out-of-order operations are always accepted: an older stamp simply loses, so there is
no event-time watermark. State per (document, feature) is one entry per register; repeated
deliveries leave it as it is and emit nothing.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lamina.operators.messages import messages, not_blank
from lamina.operators.replay import CHANGES

OUTPUT = "document_id string, feature_id string, kind string, property_key string, ts bigint, site_id string, seq bigint, gone boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Registers(StatefulProcessor):
    """Newest stamp per register: ("property", key), ("created", "") and ("deleted", "")."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("registers", "kind string, property_key string", "ts bigint, site_id string, seq bigint, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best: dict[tuple[str, str], tuple] = {}
        for part in rows:
            for kind, name, ts, site, seq, gone in zip(part["kind"], part["property_key"], part["ts"], part["site_id"], part["seq"], part["gone"], strict=True):
                stamp = (int(ts), site.encode("utf-8", "surrogatepass"), int(seq), site, bool(gone))
                if stamp > best.get((kind, name), (-1,)):
                    best[kind, name] = stamp
        out = []
        for (kind, name), (ts, raw, seq, site, gone) in best.items():
            old = self.state.getValue((kind, name)) if self.state.containsKey((kind, name)) else None
            if old is None or (ts, raw, seq) > (old[0], old[1].encode("utf-8", "surrogatepass"), old[2]):
                self.state.updateValue((kind, name), (ts, site, seq, gone))
                out.append((*key, kind, name, ts, site, seq, gone))
        if out:
            yield pd.DataFrame(out, columns=["document_id", "feature_id", "kind", "property_key", "ts", "site_id", "seq", "gone"])

    def close(self) -> None:
        pass


def writes(stream: DataFrame) -> DataFrame:
    """Register writes of messages: one row per register that an operation touches."""
    single = F.col("type").isin("set_property", "delete_property")
    op = messages(stream).where(F.col("type").isin(*CHANGES) & (~single | not_blank(F.col("property_key"))))
    entry = lambda kind, key, gone: F.struct(F.lit(kind).alias("kind"), key.alias("property_key"), F.lit(gone).alias("gone"))
    none = F.lit("")
    listed = F.transform(F.map_keys(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda k: entry("property", k, False))
    touched = (
        F.when(F.col("type") == "insert_feature", F.concat(F.array(entry("created", none, False)), listed))
        .when(F.col("type") == "delete_feature", F.array(entry("deleted", none, False)))
        .when(F.col("type") == "set_property", F.array(entry("property", F.col("property_key"), False)))
        .otherwise(F.array(entry("property", F.col("property_key"), True)))
    )
    return op.select("document_id", "feature_id", "ts", "site_id", "seq", F.explode(touched).alias("w")).select("document_id", "feature_id", "ts", "site_id", "seq", "w.*")


def merge(stream: DataFrame) -> DataFrame:
    """Changed registers of a stream of op messages, in update mode. Needs the RocksDB state store."""
    return writes(stream).groupBy("document_id", "feature_id").transformWithStateInPandas(statefulProcessor=Registers(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def settle(changes: DataFrame, base: DataFrame) -> DataFrame:
    """Current properties of visible features from all changes emitted so far, over the base.

    The same columns as replay.current. Of each register the newest change counts.
    """
    stamp = F.struct("ts", "site_id", "seq")
    zero = F.lit(0).cast("bigint")
    columns = ["document_id", "feature_id", "kind", "property_key", "ts", "site_id", "seq", "gone"]
    of_base = base.select("document_id", "feature_id", F.explode(F.concat(F.array(F.struct(F.lit("base").alias("kind"), F.lit("").alias("property_key"))), F.transform(F.map_keys(F.coalesce("properties", F.create_map().cast("map<string,string>"))), lambda k: F.struct(F.lit("property").alias("kind"), k.alias("property_key"))))).alias("e"))
    rows = changes.select(*columns).unionByName(of_base.select("document_id", "feature_id", "e.kind", "e.property_key", zero.alias("ts"), F.lit("").alias("site_id"), zero.alias("seq"), F.lit(False).alias("gone")))
    last = rows.groupBy("document_id", "feature_id", "kind", "property_key").agg(F.max(F.struct(stamp.alias("s"), "gone")).alias("w"))
    w = Window.partitionBy("document_id", "feature_id")
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("w.s"))).over(w)
    alive = last.withColumn("created", of("created")).withColumn("deleted", of("deleted")).withColumn("is_base", of("base").isNotNull())
    visible = F.when(F.col("deleted").isNull(), F.col("is_base") | F.col("created").isNotNull()).otherwise(F.coalesce(F.col("created") > F.col("deleted"), F.lit(False)))
    return alive.where(visible & (F.col("kind") == "property") & ~F.col("w.gone")).select("document_id", "feature_id", "property_key", "w.s.site_id", "w.s.seq")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there and stop: changes land in ``out`` as Parquet, each micro-batch once (its own folder, replaced on retry)."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number:09d}")

    start(merge(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save)).awaitTermination()


_STARTING = threading.Lock()


def start(writer: DataStreamWriter) -> StreamingQuery:
    """Start a query on the RocksDB state store.

    A query takes the session's settings as they are when it starts, so the setting is changed for that moment only.
    """
    spark = SparkSession.active()
    with _STARTING:
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        try:
            return writer.start()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
