"""Sinks beside the plain ones: replaced and appended tables, summaries, arrays, splits."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import delete, exists, rename, write_csv


def _fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The fields in their order as strings; other columns go, missing ones are blank."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in fields])


def replace_csv(df: DataFrame, fields: Sequence[str], path: str) -> None:
    """Write beside the old table first, then take its place; a failed write leaves the old one."""
    spark, fresh, old = df.sparkSession, f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    for leftover in (fresh, old):
        delete(spark, leftover)
    write_csv(_fields(df, fields), fresh)
    if exists(spark, path):
        rename(spark, path, old)
    rename(spark, fresh, path)
    delete(spark, old)


def append_csv(df: DataFrame, fields: Sequence[str], path: str) -> None:
    """Add rows; each part of the table has the one header, so readers see it once."""
    _fields(df, fields).write.mode("append").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_summary(spark: SparkSession, summary: Mapping, path: str) -> None:
    """One JSON object as a file, non-ASCII characters as they are."""
    spark.createDataFrame([(json.dumps(summary, ensure_ascii=False, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_summary(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_arrays(spark: SparkSession, path: str, **arrays: np.ndarray) -> None:
    """Arrays of a model as compressed rows of name, type, shape and bytes."""
    rows = [(name, a.dtype.str, list(a.shape), np.ascontiguousarray(a).tobytes()) for name, a in arrays.items()]
    spark.createDataFrame(rows, "name string, kind string, shape array<long>, data binary").write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_arrays(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    return {r["name"]: np.frombuffer(r["data"], r["kind"]).reshape(r["shape"]) for r in spark.read.parquet(path).collect()}  # one row an array


def write_splits(df: DataFrame, split: Column, path: str) -> None:
    """Every row into the folder of its split, in one pass."""
    df.withColumn("split", split).write.mode("overwrite").partitionBy("split").parquet(path)


def export_store(store: DataFrame, order: Sequence[str], folder: str, status: str = "status", failed: str = "failed") -> None:
    """The store in order, and its failed rows, as two tables of CSV."""
    write_csv(store.orderBy(*[F.col(c).asc_nulls_last() for c in order]), f"{folder}/export")
    write_csv(store.where(F.col(status) == failed).orderBy(*order), f"{folder}/failures")
