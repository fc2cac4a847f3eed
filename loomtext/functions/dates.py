"""Dates and years in untidy spellings, as column expressions; what is no date is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _day(c: Column, pattern: str) -> Column:
    year, month, day = (F.regexp_extract(c, pattern, i) for i in (1, 2, 3))
    found = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.regexp_like(c, F.lit(pattern)), found)


def parse_date(c: Column) -> Column:
    """The timestamp in a text: year, month and day with dashes, slashes, dots or the Chinese
    signs, the first eight digits of a date within an address, else an ISO time. The first of
    these that fits decides, also if it is no date."""
    text = F.trim(F.replace(F.translate(c, "年月", "--"), F.lit("日"), F.lit("")))
    loose, tight = _day(text, r"(20\d{2})[-/.](\d{1,2})[-/.](\d{1,2})"), _day(text, r"(20\d{2})(\d{2})(\d{2})")
    iso = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    whole = F.when(F.regexp_like(iso, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?$")), iso)
    return F.coalesce(loose, tight, whole).try_cast("timestamp_ntz")


def parse_epoch(c: Column) -> Column:
    """A number of seconds, or of milliseconds beyond 10**11."""
    seconds = F.when(c > 10**11, c / 1000).otherwise(c)
    return F.timestamp_micros((seconds * 1_000_000).cast("long")).cast("timestamp_ntz")


def year_of(c: Column, fallback: Column, search: bool = False) -> Column:
    """The first year of this century in a text; else the fallback's first four characters,
    or (``search``) the first year in it; blank if there is none."""
    found = lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), r"20\d{2}", 0), F.lit(""))
    other = found(fallback) if search else F.substring(F.coalesce(fallback, F.lit("")), 1, 4)
    return F.coalesce(found(c), other, F.lit(""))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """Every day from first to last, both included."""
    days = F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    return spark.range(1).select(days)


def day_blocks(days: DataFrame, size: int = 5) -> DataFrame:
    """block_start and block_end of each ``size`` days of a calendar; a shorter rest joins the
    last whole block (or is the only one)."""
    bounds = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    n = F.datediff("last", "first") + 1
    blocks = F.greatest(F.lit(1), F.floor(n / size)).cast("int")
    each = bounds.select("first", "last", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    end = F.when(F.col("i") == F.col("blocks") - 1, F.col("last")).otherwise(F.date_add("first", (F.col("i") + 1) * size - 1))
    return each.select(F.date_add("first", F.col("i") * size).alias("block_start"), end.alias("block_end"))


def month_bounds(days: DataFrame) -> DataFrame:
    """month, its first and its last day, for every month of a calendar."""
    month = F.trunc("day", "month")
    return days.select(F.date_format("day", "yyyy-MM").alias("month"), month.alias("month_start"), F.last_day("day").alias("month_end")).distinct()


def year_bounds_ms(year: Column) -> tuple[Column, Column]:
    """The first millisecond and the last second, in milliseconds, of a year (UTC)."""
    start = lambda y: F.unix_date(F.make_date(y, F.lit(1), F.lit(1))).cast("long") * 86_400_000
    return start(year), start(year + 1) - 1000
