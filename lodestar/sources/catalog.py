"""Stored snapshots: a version per write, a pointer that moves only when the write has ended, run counters beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SCHEMA_VERSION


class Catalog:
    """Tables below a root; all paths go through Hadoop file systems, so any store that Spark knows will do.

    A table's current version is the greatest whose write has ended (_SUCCESS); a failed or interrupted write leaves
    the last one in place. The schema version is part of the path: with a new one, derived tables start empty and
    the logs named in `learned` stay readable under their own path.
    """

    learned = ("clicks", "searches")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _base(self, table: str) -> str:
        return f"{self.root}/{table}" if table in self.learned else f"{self.root}/v{SCHEMA_VERSION}/{table}"

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, table: str, ended: bool = True) -> list[int]:
        p, fs = self._path(self._base(table))
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        numbers = [n for n in names if n.isdigit() and (not ended or fs.exists(self._path(f"{self._base(table)}/{n}/_SUCCESS")[0]))]
        return sorted(map(int, numbers))

    def read(self, table: str) -> DataFrame | None:
        found = self.versions(table)
        return self.spark.read.parquet(f"{self._base(table)}/{found[-1]}") if found else None

    def write(self, table: str, df: DataFrame, sort: str | None = None, keep: int = 2) -> DataFrame:
        """A new version, range-sorted for point look-ups if asked; readers of older ones go on, all but `keep` are deleted."""
        begun = self.versions(table, ended=False)
        df = df.repartitionByRange(sort).sortWithinPartitions(sort) if sort else df
        # a second writer of the same version fails, and a write that never ended keeps its number
        df.write.mode("error").parquet(f"{self._base(table)}/{begun[-1] + 1 if begun else 1}")
        for old in self.versions(table)[:-keep]:
            p, fs = self._path(f"{self._base(table)}/{old}")
            fs.delete(p, True)
        return self.read(table)

    def append(self, table: str, df: DataFrame) -> None:
        """Add to a log."""
        df.write.mode("append").parquet(f"{self._base(table)}/1")

    def reset(self) -> None:
        """Drop all derived tables; logs of what was learned stay."""
        p, fs = self._path(f"{self.root}/v{SCHEMA_VERSION}")
        fs.delete(p, True)

    def get_meta(self, key: str, default: str | None = None) -> str | None:
        table = self.read("meta")
        row = table.where(F.col("key") == key).first() if table is not None else None
        return row["value"] if row else default

    def set_meta(self, key: str, value: str) -> None:
        new, table = self.spark.createDataFrame([(key, str(value))], "key string, value string"), self.read("meta")
        self.write("meta", new if table is None else table.where(F.col("key") != key).union(new))
