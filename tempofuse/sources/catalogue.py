"""A catalogue of events with their status, as an append-only log that any number of writers may add to.

Each write is a file of its own, and what an event is follows from all its rows, in whatever order they came: a deletion
outweighs all else, a final status outweighs "processing", and of two final ones the first in time counts (then the
first in order of writer). So two writers at once lose nothing and agree on the result. compact() writes one row an event
as a new version of a snapshot; rows that are both in it and in the log count once, as the rule does not mind repeats.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "id string, status string, at timestamp, writer string, created timestamp, meta string"
PROCESSING, DELETED = "processing", "deleted"


@dataclass
class Catalogue:
    """The catalogue in a folder that all writers share. status is "processing", "deleted", or a final one (any other)."""

    spark: SparkSession
    path: str
    writer: str = field(default_factory=lambda: uuid.uuid4().hex)

    def _append(self, rows: DataFrame) -> None:
        rows.select("id", "status", "at", F.lit(self.writer).alias("writer"), "created", "meta").write.mode("append").parquet(f"{self.path}/log")

    def add(self, rows: DataFrame) -> None:
        """New events (id, at, meta), in processing."""
        self._append(rows.select("id", F.lit(PROCESSING).alias("status"), "at", F.col("at").alias("created"), "meta"))

    def finish(self, rows: DataFrame) -> None:
        """Final statuses (id, status, at). Events that were never added appear with it too."""
        self._append(rows.select("id", "status", "at", F.lit(None).cast("timestamp").alias("created"), F.lit(None).cast("string").alias("meta")))

    def delete(self, ids: DataFrame) -> None:
        """Tombstones for ids; what comes later for them changes nothing."""
        self.finish(ids.select("id", F.lit(DELETED).alias("status"), F.current_timestamp().alias("at")))

    def _rows(self) -> DataFrame:
        parts = []
        for folder in ("log", *(f"snapshot/{v}" for v in self.versions()[-1:])):
            try:
                parts.append(self.spark.read.schema(ROW).parquet(f"{self.path}/{folder}"))
            except AnalysisException:  # nothing was written yet
                parts.append(self.spark.createDataFrame([], ROW))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def versions(self) -> list[str]:
        """Whole snapshots, oldest first."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshot")
        system = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(files):
            return []
        whole = [x.getPath() for x in system.listStatus(files) if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted((x.getName() for x in whole), key=lambda name: int(name.split("=")[1]))

    def settled(self) -> DataFrame:
        """One row an event, deleted ones among them: status and when and by whom it was set, created and meta."""
        rank = F.when(F.col("status") == DELETED, 0).when(F.col("status") == PROCESSING, 2).otherwise(1)
        first = F.min(F.struct(rank.alias("rank"), "at", "writer", "status")).alias("s")
        born = F.min(F.when(F.col("created").isNotNull(), F.struct("created", "writer", "meta"))).alias("b")
        return self._rows().groupBy("id").agg(first, born).select("id", "s.status", "s.at", "s.writer", "b.created", "b.meta")

    def current(self) -> DataFrame:
        """Events that are not deleted."""
        return self.settled().where(F.col("status") != DELETED)

    def detail(self, ids: DataFrame, **tables: DataFrame) -> DataFrame:
        """The events of ids with the rows that tables have of each (by id), as arrays of structs; deleted ones have none."""
        out = self.current().join(ids.select("id").distinct(), "id")
        for name, rows in tables.items():
            out = out.join(rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "id"]))).alias(name)), "id", "left")
        return out

    def compact(self) -> str | None:
        """Write a new snapshot of all events; its name, or None if another writer was writing the same version."""
        have = self.versions()
        name = f"v={int(have[-1].split('=')[1]) + 1 if have else 1}"
        try:
            self.settled().select(*[c.split()[0] for c in ROW.split(", ")]).write.mode("errorifexists").parquet(f"{self.path}/snapshot/{name}")
        except AnalysisException:
            return None
        return name
