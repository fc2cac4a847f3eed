"""A store of keyed tables in shared storage: rows replaced or kept by key, read as they stand.

A table is a folder of numbered versions; a write makes the next one and readers take the
last that is whole, so a lost writer leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import _path, delete, exists

# The tables of a crawl, their key and their columns.
TABLES = {
    "candidates": ("url", "url string, media string, search_keyword string, search_title string, search_date string, search_content string, study_year int"),
    "search_jobs": ("task_key", "task_key string, media string, keyword string, study_year int, max_pages int, status string, found int, error string, updated string"),
    "processed": ("url", "url string, media string, status string, reason string, updated string"),
    "articles": ("url", "url string, media string, date string, title string, text string"),
}


class Store:
    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, tuple[str, str]] = TABLES):
        self.spark, self.folder, self.tables = spark, folder.rstrip("/"), tables

    def _versions(self, name: str) -> list[int]:
        path, store = _path(self.spark, f"{self.folder}/{name}")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit() and exists(self.spark, f"{self.folder}/{name}/{n}/_SUCCESS"))

    def read(self, name: str) -> DataFrame:
        versions = self._versions(name)
        reader = self.spark.read.schema(self.tables[name][1])
        return reader.parquet(f"{self.folder}/{name}/{versions[-1]}") if versions else self.spark.createDataFrame([], self.tables[name][1])

    def _write(self, name: str, rows: DataFrame) -> None:
        versions = self._versions(name)
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/{versions[-1] + 1 if versions else 0}")
        for old in versions[:-1]:  # the last one may still be read
            delete(self.spark, f"{self.folder}/{name}/{old}")

    def _last(self, name: str, rows: DataFrame) -> DataFrame:
        """The rows with the table's columns, one a key."""
        own = self.read(name).schema
        full = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own])
        return full.dropDuplicates([self.tables[name][0]])

    def replace(self, name: str, rows: DataFrame) -> None:
        """Insert, or replace the rows with the same key."""
        fresh, key = self._last(name, rows), self.tables[name][0]
        self._write(name, self.read(name).join(fresh, key, "left_anti").unionByName(fresh))

    def insert(self, name: str, rows: DataFrame) -> None:
        """Insert the rows whose key isn't there."""
        fresh, key = self._last(name, rows), self.tables[name][0]
        self._write(name, self.read(name).unionByName(fresh.join(self.read(name), key, "left_anti")))

    def pending(self, done: str = "processed", of: str = "candidates", failed: str = "failed") -> DataFrame:
        """Candidates that nothing was done with, or whose work failed, in order."""
        key = self.tables[of][0]
        seen = self.read(done).select(key, "status")
        return self.read(of).join(seen, key, "left").where(F.col("status").isNull() | (F.col("status") == failed)).drop("status").orderBy("study_year", "media", key)
