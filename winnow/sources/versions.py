"""Table versions as Parquet snapshots with an append-only log and a head pointer."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import diff_versions
from ..operators.quality import quality_metrics

LOG_SCHEMA = ("version int, operation string, description string, rows_affected bigint, quality double, "
              "rows bigint, columns string, saved_at timestamp")
HEAD_SCHEMA = "seq bigint, version int, action string"


class VersionStore:
    """Snapshots live in ``<root>/data/version=n``; the log and the head moves are small tables.

    Undo and redo move the head; no snapshot is copied or rewritten."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, row: tuple, schema: str) -> None:
        new = self.spark.createDataFrame([row], schema)
        if "saved_at" in new.columns:
            new = new.withColumn("saved_at", F.current_timestamp())
        new.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def history(self) -> DataFrame:
        """The log with a flag on the current version."""
        head = self.head()
        return self._read("log", LOG_SCHEMA).withColumn("is_current", F.col("version") == F.lit(head))

    def head(self) -> int | None:
        r = self._read("head", HEAD_SCHEMA).orderBy(F.desc("seq")).limit(1).collect()
        return r[0]["version"] if r else None

    def moves(self) -> DataFrame:
        return self._read("head", HEAD_SCHEMA)

    def _move(self, version: int, action: str) -> None:
        n = self._read("head", HEAD_SCHEMA).agg(F.max("seq")).first()[0]
        self._append("head", ((n or 0) + 1, version, action), HEAD_SCHEMA)

    def save(self, df: DataFrame, operation: str, description: str = "", rows_affected: int = 0) -> int:
        """Write a snapshot, log its size and quality, and make it current."""
        last = self._read("log", LOG_SCHEMA).agg(F.max("version")).first()[0]
        v = (last or 0) + 1
        while True:  # another writer may have taken the number: its snapshot stays
            path = f"{self.root}/data/version={v}"
            try:
                df.write.mode("errorifexists").parquet(path)
                break
            except AnalysisException as e:
                if e.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                v += 1
        snap = self.spark.read.parquet(path)
        m = quality_metrics(snap)
        row = (v, operation, description, int(rows_affected), m["overall"]["score"], m["completeness"]["rows"],
               ", ".join(snap.columns), None)
        self._append("log", row, LOG_SCHEMA)
        self._move(v, "save")
        return v

    def get(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/data/version={version}")

    def current(self) -> DataFrame:
        return self.get(self.head())

    def restore(self, version: int) -> DataFrame:
        self._move(version, "restore")
        return self.get(version)

    def undo(self) -> DataFrame:
        """Step back to the version before the current one."""
        prev = self._read("log", LOG_SCHEMA).where(F.col("version") < F.lit(self.head())).agg(F.max("version")).first()[0]
        if prev is None:
            raise ValueError("nothing to undo")
        self._move(prev, "undo")
        return self.get(prev)

    def redo(self) -> DataFrame:
        """Step forward again after an undo."""
        nxt = self._read("log", LOG_SCHEMA).where(F.col("version") > F.lit(self.head())).agg(F.min("version")).first()[0]
        if nxt is None:
            raise ValueError("nothing to redo")
        self._move(nxt, "redo")
        return self.get(nxt)

    def compare(self, old: int, new: int, key: str) -> DataFrame:
        """Keyed diff of two versions with the change in quality."""
        q = {r["version"]: r["quality"] for r in self._read("log", LOG_SCHEMA).where(
            F.col("version").isin(old, new)).select("version", "quality").collect()}
        return diff_versions(self.get(old), self.get(new), key).withColumn(
            "quality_change", F.round(F.lit(q[new] - q[old]), 2))
