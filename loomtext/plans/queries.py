"""The catalogue's plans as Spark queries and as SQL for the checks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import more  # noqa: F401  its plans join the catalogue
from .catalogue import PLANS
from .dialect import TABLES, Portable, Spark


def run_plan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The plan over the folder's tables, through views of this call's own, which go once the
    names are resolved."""
    sql, mark, views = PLANS[name](Spark()), uuid.uuid4().hex, []
    for table in TABLES:
        if f"loomtext_{table}" in sql:
            views.append(f"loomtext_{table}_{mark}")
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(views[-1])
            sql = re.sub(rf"\bloomtext_{table}\b", views[-1], sql)
    try:
        return spark.sql(sql)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, name=name: run_plan(spark, sf_dir, name) for name in PLANS}


def oracle_sql() -> dict[str, str]:
    return {name: sql(Portable()) for name, sql in PLANS.items()}
