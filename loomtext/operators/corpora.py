"""Corpora of different origins under one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a column may come, the preferred one first.
NAMES = {"doc_id": ("doc_id", "page_id", "id"), "text": ("text", "html", "content", "body"), "year": ("year", "published", "pub_year")}
TYPES = {"doc_id": "long", "text": "string", "year": "long"}


def resolved(df: DataFrame, wanted: str) -> Column:
    """The first column of the wanted kind that the table has; a null column if none."""
    found = next((n for n in NAMES[wanted] if n in df.columns), None)
    return (F.col(found) if found else F.lit(None)).cast(TYPES[wanted]).alias(wanted)


def standardised(corpora: dict[str, DataFrame]) -> DataFrame:
    """source (the corpus's name), doc_id, text, year of every row."""
    parts = [df.select(F.lit(name).alias("source"), *(resolved(df, c) for c in NAMES)) for name, df in corpora.items()]
    return reduce(DataFrame.unionByName, parts)
