"""Exact stratified samples, splits and folds in a reproducible hash order.

A sample keeps the first rows of each stratum in each task before the shuffle (a limit on a
window's rank). Splits and folds need every row's place: a stratum is cut into ranges of its
hash, as many as its size asks for, ranges are numbered from their counts, so a stratum that
holds most of the rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANGE = 100_000


def _order(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each stratum, or all of a smaller one."""
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(_order(key, seed), key))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def placed(df: DataFrame, key: str, stratum: str, seed: str = "42", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """df with _place (from 1, in hash order within the stratum) and _size of the stratum."""
    sizes = df.groupBy(F.col(stratum).alias("_s")).agg(F.count(F.lit(1)).alias("_size"))
    share = F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    marked = df.withColumn("_order", _order(key, seed)).join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("_part", F.floor(share * F.ceil(F.col("_size") / rows_per_range)))
    counts = marked.groupBy(F.col("_s").alias("_of"), F.col("_part").alias("_in")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_of").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = counts.select("_of", "_in", before.alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_s", "_part").orderBy("_order", key))
    numbered = marked.withColumn("_inside", inside).join(starts, F.col("_s").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_in")))
    return numbered.select(*df.columns, (F.col("_start") + F.col("_inside")).alias("_place"), "_size")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.2, seed: str = "42", **how) -> DataFrame:
    """``part``: 'validation' for the given share of each stratum, else 'train'."""
    held = F.col("_place") <= F.floor(F.col("_size") * F.lit(share) + 0.5)
    return placed(df, key, stratum, seed, **how).select(*df.columns, F.when(held, "validation").otherwise("train").alias("part"))


def kfold(df: DataFrame, key: str, stratum: str, k: int = 5, seed: str = "42", **how) -> DataFrame:
    return placed(df, key, stratum, seed, **how).select(*df.columns, F.pmod("_place", F.lit(k)).cast("long").alias("fold"))
