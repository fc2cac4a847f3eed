"""Row numbers and average ranks of whole tables, without a sort in one task.

Rows are cut into ranges by a bounded number of approximate quantiles; each range is
numbered by its own task and starts after the rows of the ranges before it. Ranks work
on distinct values with their counts, so a value that most rows share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a table; the cuts between them are the only values that reach the driver.
RANGES = 128


def correlation(x: str, y: str) -> Column:
    """Pearson's, as an aggregate; null where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _range_of(df: DataFrame, column: str, ranges: int) -> Column:
    """Which range a number falls in; nulls have the last one."""
    at = [i / ranges for i in range(1, ranges)]
    found = df.agg(F.percentile_approx(column, at, 8 * ranges)).first()[0] if at else []
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    below = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(column)))
    return F.when(F.col(column).isNull(), len(cuts) + 1).otherwise(below)


def row_numbers(df: DataFrame, group: str, order: str, name: str = "row_id", ranges: int = RANGES) -> DataFrame:
    """df and each row's place, from 0, in the order (group, order); nulls last. Rows
    that agree in both are numbered in any order."""
    marked = df.withColumn("_range", _range_of(df, order, ranges))
    sizes = marked.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"))
    # One row for each group and range: the sort in one task is of these alone.
    before = Window.orderBy(F.col(group).asc_nulls_last(), "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("_group"), F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_range").orderBy(F.col(order).asc_nulls_last())
    numbered = marked.withColumn("_place", F.row_number().over(inside))
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of"))
    return numbered.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_place") - 1).alias(name))


def average_ranks(df: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """(value, n, average_rank): each distinct value, its rows and their mean place from
    1; nulls are one value, the last."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    marked = counts.withColumn("_range", _range_of(counts, value, ranges))
    sizes = marked.groupBy("_range").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES + 1 rows
    starts = sizes.select(F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    placed = placed.join(F.broadcast(starts), F.col("_range") == F.col("_of"))
    return placed.select(value, "n", (F.col("_start") + F.col("_before") + (F.col("n") + 1) * 0.5).alias("average_rank"))


def with_rank(df: DataFrame, value: str, name: str, ranges: int = RANGES) -> DataFrame:
    """df and each row's average rank by value."""
    ranks = average_ranks(df, value, ranges).select(F.col(value).alias("_value"), F.col("average_rank").alias(name))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("_value"))).drop("_value")


def spearman(df: DataFrame, x: str, y: str, ranges: int = RANGES) -> DataFrame:
    """rho over rows where both are known (null where one is constant); pairs are counted before they are ranked."""
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    a = average_ranks(known, x, ranges).select(x, F.col("average_rank").alias("_a"))
    b = average_ranks(known, y, ranges).select(y, F.col("average_rank").alias("_b"))
    pairs = known.groupBy(x, y).agg(F.count(F.lit(1)).alias("_n")).join(a, x).join(b, y)
    weighted = [F.sum(F.col("_n") * c).alias(k) for k, c in (("n", F.lit(1.0)), ("a", F.col("_a")), ("b", F.col("_b")))]
    means = pairs.agg(*weighted).select((F.col("a") / F.col("n")).alias("_ma"), (F.col("b") / F.col("n")).alias("_mb"))
    da, db = F.col("_a") - F.col("_ma"), F.col("_b") - F.col("_mb")
    moments = pairs.crossJoin(F.broadcast(means)).agg(*[F.sum(F.col("_n") * c).alias(k) for k, c in (("ab", da * db), ("aa", da * da), ("bb", db * db))])  # one row of means
    return moments.select(F.try_divide("ab", F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))
