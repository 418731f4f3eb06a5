"""Operation and snapshot stores as Parquet tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina import errors
from lamina.functions.canon import op_digest
from lamina.operators import clocks
from lamina.operators.envelope import require_distinct
from lamina.operators.messages import IDENTITY
from lamina.schemas import OP_COLUMNS, OPS_DDL
from lamina.sources.folders import FolderLog

#: Documents of a batch up to which an append names them in its scan of the store; of more, it reads the whole key columns.
NAMED_DOCUMENTS = 1000


class OpStore:
    """Idempotent append per (document, site, number), and scans beyond a clock.

    An append is one published folder, sorted by identity so that row groups can be skipped by document;
    check and write are one step, as another append in between makes it start over.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.log = FolderLog(spark, path, f"{OPS_DDL}, digest binary")

    def read(self, document_id: str | None = None) -> DataFrame:
        """All operations, or one document's; empty if nothing was stored."""
        rows = self.log.read()
        return rows if document_id is None else rows.where(F.col("document_id") == document_id)

    def append(self, batch: DataFrame) -> int:
        """Store what is new of a batch; the number of new operations.

        A collision, within the batch or with the store, refuses the batch before anything is written.
        Repeating an append changes nothing. Of the store only identities and digests of the batch's documents
        are read: named in the scan while they are few, joined otherwise.
        """
        require_distinct(batch if "delivery_id" in batch.columns else batch.withColumn("delivery_id", F.monotonically_increasing_id()))
        rows = batch.select("document_id", *OP_COLUMNS).withColumn("digest", op_digest(F.struct(*OP_COLUMNS))).dropDuplicates([*IDENTITY, "digest"]).persist()
        named = [r[0] for r in rows.select("document_id").distinct().limit(NAMED_DOCUMENTS + 1).collect()]

        def fresh(stored: DataFrame) -> DataFrame | None:
            known = stored.select(*IDENTITY, F.col("digest").alias("known"))
            if len(named) <= NAMED_DOCUMENTS:
                known = known.where(F.col("document_id").isin(named))
            met = rows.join(known, list(IDENTITY), "left")
            clash = met.where("digest <> known").select(*IDENTITY).limit(1).collect()
            if clash:
                raise errors.IdentityCollision("/".join(map(str, clash[0])))
            new = met.where("known IS NULL").drop("known")
            return None if new.isEmpty() else new

        try:
            folder = self.log.change(fresh, IDENTITY)
            return self.log.read([folder]).count() if folder else 0
        finally:
            rows.unpersist()

    def since(self, clock: DataFrame, document_id: str | None = None) -> DataFrame:
        """Operations beyond a clock (document_id, site_id, seq), by (document, site, number)."""
        return clocks.beyond(self.read(document_id).drop("digest"), clock).orderBy(*IDENTITY)


def _name(text: str) -> str:
    """A folder name for any text."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


class SnapshotStore:
    """Snapshots by document and id, a folder each; the last write of an id wins."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def save(self, snapshots: DataFrame) -> None:
        """Save rows of snapshots in one job: one row per id, and each id's folder is replaced.

        Of several rows with one id the largest clock counts. Nothing but the rows moves: ids stay on the executors.
        """
        order = F.col("clock") if "clock" in snapshots.columns else F.lit(0)
        once = snapshots.groupBy("document_id", "id").agg(F.max_by(F.struct(*snapshots.columns), order).alias("s")).select("s.*")
        placed = once.withColumn("_document", F.sha2("document_id", 256)).withColumn("_snapshot", F.sha2("id", 256))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_document", "_snapshot").parquet(self.path)

    def load(self, document_id: str, own: str) -> DataFrame:
        """One snapshot as a row; InvalidSnapshot if it isn't there."""
        at = f"{self.path}/_document={_name(document_id)}/_snapshot={_name(own)}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            raise errors.InvalidSnapshot(f"no snapshot {own!r} of {document_id!r}")
        return self.spark.read.parquet(at)
