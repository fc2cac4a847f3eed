"""Text functions without a built-in: entity decoding and phrase-first segmentation."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def named_entities(text: Column, names: Sequence[str]) -> Column:
    """The given named references decoded, where they end in a semicolon, and no others; amp
    comes last, so nothing is decoded twice."""
    ordered = sorted(names, key=lambda n: n == "amp")
    return reduce(lambda c, n: F.replace(c, F.lit(f"&{n};"), F.lit(html5[f"{n};"])), ordered, text)


def tokenize_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """Lower-case letter runs, with the given phrases kept whole (the longest first)."""
    ordered = sorted((p.lower() for p in phrases), key=lambda p: (-len(p), p))
    pattern = "|".join([*("\\Q" + p + "\\E" for p in ordered), r"\p{L}+"])
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
