"""Python functions over tables, a batch at a time: on a column, on rows, on groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import PandasUDFType


def apply_column(df: DataFrame, column: str, f: Callable, kind: str, name: str | None = None) -> DataFrame:
    """df with ``f`` of each value of a column (nulls too) in ``name`` or in its place."""

    @F.pandas_udf(kind)
    def mapped(values: pd.Series) -> pd.Series:
        return pd.Series([f(None if pd.isna(v) else v) for v in values], dtype=object)

    return df.withColumn(name or column, mapped(column))


def apply_rows(df: DataFrame, f: Callable[[dict], Mapping], schema: str) -> DataFrame:
    """df and the fields that ``f`` makes of each row (a dict), side by side."""
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    own = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema)

    def scan(frames):
        for frame in frames:
            made = [f(row) for row in frame.to_dict("records")]
            yield pd.concat([frame, pd.DataFrame({n: pd.Series([m[n] for m in made], dtype=object) for n in names}, index=frame.index)], axis=1)

    return df.mapInPandas(scan, f"{own}, {schema}")


def aggregate_groups(df: DataFrame, keys: Sequence[str], functions: Mapping[str, tuple[str, Callable]], kinds: Mapping[str, str]) -> DataFrame:
    """The keys and, for each name, a function of the group's values of a column. A group's
    columns are in memory at once, so built-in aggregates are the way for large groups."""

    def udaf(kind: str, f: Callable):
        return F.pandas_udf(lambda values: f(values), kind, PandasUDFType.GROUPED_AGG)

    return df.groupBy(*keys).agg(*[udaf(kinds[n], f)(column).alias(n) for n, (column, f) in functions.items()])
