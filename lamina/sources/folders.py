"""Tables as logs of Parquet folders: atomic appends with a check, on any Hadoop file system.

A change is a folder of rows, written first and then published as the next version by creating its entry
exclusively. Whoever decided on an older version fails to publish, reads again and decides anew, so
two writers never both act on the same state. Only version numbers and folder names reach the driver.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class FolderLog:
    """Versions of one table below ``root``; rows have the columns of ``schema``."""

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root, schema
        self._fs().mkdirs(self._path("log"))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _create(self, path, text: str) -> bool:
        """Create a file exclusively; false if it's there."""
        fs, data = self._fs(), text.encode()
        if fs.getScheme() == "file":  # the local file system's own create isn't atomic
            try:
                at = os.open(path.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(at, "wb") as f:
                f.write(data)
            return True
        try:
            out = fs.create(path, False)
        except Exception:
            if fs.exists(path):
                return False
            raise
        out.write(data)
        out.close()
        return True

    def versions(self) -> list[str]:
        """Folders of the published versions, in order."""
        names = sorted(s.getPath().getName() for s in self._fs().listStatus(self._path("log")))
        if not names:
            return []
        entries = self.spark.read.schema("version bigint, folder string").json([f"{self.root}/log/{n}" for n in names])
        return [f"{self.root}/{r['folder']}" for r in entries.orderBy("version").collect()]

    def read(self, folders: list[str] | None = None) -> DataFrame:
        """Rows of the given versions, or of all; empty where there are none."""
        folders = self.versions() if folders is None else folders
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def publish(self, version: int, rows: DataFrame, sort_by: tuple[str, ...] = ()) -> str | None:
        """Write rows and make them version ``version``; its folder, or None if another writer was faster."""
        folder = f"data/{uuid.uuid4().hex}"
        if sort_by:
            rows = rows.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by)
        rows.write.parquet(f"{self.root}/{folder}")
        done = self._create(self._path("log", f"{version:012d}.json"), json.dumps({"version": version, "folder": folder}))
        return f"{self.root}/{folder}" if done else None

    def change(self, decide: Callable[[DataFrame], DataFrame | None], sort_by: tuple[str, ...] = ()) -> str | None:
        """Publish what ``decide`` makes of the present rows, again whenever another version came between; None if it's nothing."""
        while True:
            folders = self.versions()
            rows = decide(self.read(folders))
            if rows is None:
                return None
            if (folder := self.publish(len(folders) + 1, rows, sort_by)) is not None:
                return folder
