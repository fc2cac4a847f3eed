"""Readers beside the plain ones: headers, required columns, lineage, caches, settings."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import exists


def normalised_headers(df: DataFrame) -> DataFrame:
    """Column names without byte order marks and white space around them."""
    return df.toDF(*[c.replace("﻿", "").strip() for c in df.columns])


def required(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df itself; fails with the names it lacks, before anything is read."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: Sequence[str]) -> str:
    """The first of the names that the table has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns: {', '.join(names)}")


def read_with_lineage(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The rows of CSV files as strings (missing ones blank), with source_file, upload_number
    (the file's place in ``paths``, from 1) and source_row (the record's number in its file,
    where the header is 1). Files are read whole, so their rows are numbered where they are read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    rows = reader.csv(list(paths)).na.fill("").select(*columns, F.col("_metadata.file_name").alias("source_file"))
    order = {p.rstrip("/").rpartition("/")[2]: i for i, p in enumerate(paths, 1)}
    names = [*columns, "source_file", "upload_number", "source_row"]

    def number(batches):
        name, n = None, 1
        for batch in batches:
            files, places = batch.column(len(columns)).to_pylist(), []
            for file in files:
                n = 2 if file != name else n + 1
                name = file
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([order.get(f, 0) for f in files], pa.int32()), pa.array(places, pa.int64())], names)

    out = T.StructType([*schema.fields, T.StructField("source_file", T.StringType()), T.StructField("upload_number", T.IntegerType()), T.StructField("source_row", T.LongType())])
    return rows.mapInArrow(number, out)


def signature(df: DataFrame, settings: Mapping) -> str:
    """A digest of a table's rows, in any order, and of settings."""
    h = [F.xxhash64(F.lit(seed), *df.columns) for seed in (1, 2)]
    sums = df.select(*[x.cast("decimal(38,0)").alias(f"h{i}") for i, x in enumerate(h)]).agg(F.count(F.lit(1)), F.sum("h0"), F.sum("h1")).first()
    told = json.dumps([df.schema.jsonValue(), *map(str, sums), settings], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()


def cached(spark: SparkSession, folder: str, sign: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under a signature; built and kept if there is none. Another signature,
    so other data or settings, never finds it; half-written tables aren't found either."""
    path = f"{folder.rstrip('/')}/{sign}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def setting_int(name: str, default: int, values: Mapping[str, str] = os.environ) -> int:
    """A whole number from the settings; blank is the default."""
    return int(values[name]) if values.get(name) else default


def setting_list(name: str, default: Sequence[str], values: Mapping[str, str] = os.environ) -> list[str]:
    """A JSON list, or items between commas; a JSON string is one item; blank items go."""
    value = values.get(name)
    if not value:
        return list(default)
    try:
        items = json.loads(value)
    except json.JSONDecodeError:
        items = [x.strip() for x in value.split(",")]
    items = items if isinstance(items, list) else [items]
    return [x for x in items if x]
