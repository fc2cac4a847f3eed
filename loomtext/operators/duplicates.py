"""Duplicates and reprints by key: aggregates over digests, joined back, no sorted groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import duplicate_key, stripped
from ..sources.storage import written


def nulls_last(*columns: str) -> list[Column]:
    """What to order by so that nulls come last within a struct."""
    return [c for name in columns for c in (F.col(name).isNull().alias(f"{name}_missing"), F.col(name).alias(f"{name}_value"))]


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    return df.withColumn("_digest", F.md5(key.cast("string")))


def keep_first(df: DataFrame, key: Column, order: Sequence[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): of rows with equal keys the first in the order (nulls last, then the
    unique ``row_id``) stays; removed rows carry the kept row's values as retained_*. A null
    key is a key."""
    keyed = _keyed(df, key).withColumn("_digest", F.coalesce("_digest", F.lit("")))
    first = keyed.groupBy("_digest").agg(F.min(F.struct(*nulls_last(*order, row_id))).alias("_least"))
    marked = keyed.join(first, "_digest")
    own = F.col(row_id) == F.col(f"_least.{row_id}_value")
    retained = [F.col(f"_least.{c}_value").alias(f"retained_{c}") for c in (row_id, *order)]
    return marked.where(own).select(*df.columns), marked.where(~own).select(*df.columns, *retained)


def group_metadata(df: DataFrame, key: Column, lists: Mapping[str, Column]) -> DataFrame:
    """key_digest, duplicate_group_size and for each of ``lists`` its sorted distinct non-blank
    values, as a JSON array."""
    unique = lambda c: F.to_json(F.array_sort(F.collect_set(F.when(stripped(c) != "", stripped(c)))))
    return _keyed(df, key).groupBy(F.col("_digest").alias("key_digest")).agg(F.count(F.lit(1)).alias("duplicate_group_size"), *[unique(c).alias(n) for n, c in lists.items()])


def reprints(df: DataFrame, row_id: str, media: str, title: Column, text: Column) -> DataFrame:
    """row_id, same_media_duplicate, cross_media_reprint, cross_media_match_type: rows whose
    normalised title or text another row of the same outlet has, or one of another outlet
    (the type is same_text where both agree). Blank titles and texts agree with nothing."""
    digest = lambda c: F.md5(F.nullif(duplicate_key(c), F.lit("")))
    rows = written(df.select(F.col(row_id), F.col(media).alias("_media"), digest(title).alias("_title"), digest(text).alias("_text")), "digests")  # texts are read once
    for kind in ("_title", "_text"):
        known = rows.where(F.col(kind).isNotNull())
        across = known.where(F.col("_media").isNotNull()).groupBy(kind).agg((F.min("_media") != F.max("_media")).alias(f"{kind}_across"))
        within = known.where(F.col("_media").isNotNull()).groupBy("_media", kind).agg((F.count(F.lit(1)) > 1).alias(f"{kind}_within"))
        rows = rows.join(across, kind, "left").join(within, ["_media", kind], "left")
    yes = lambda name: F.coalesce(name, F.lit(False))
    kind = F.when(yes("_text_across"), "same_text").when(yes("_title_across"), "same_title").otherwise("")
    return rows.select(row_id, (yes("_title_within") | yes("_text_within")).alias("same_media_duplicate"), (kind != "").alias("cross_media_reprint"), kind.alias("cross_media_match_type"))


def merged_candidates(df: DataFrame, key: str, keywords: str, others: Sequence[str], order: str, separator: str = "|") -> DataFrame:
    """One row a key: the sorted union of the keyword lists, and the other columns of the first row in the order."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.coalesce(keywords, F.lit("")), f"\\Q{separator}\\E")))))
    first = F.min_by(F.struct(*others), F.struct(*nulls_last(order))).alias("_first")
    out = df.groupBy(key).agg(F.array_join(F.filter(words, lambda w: w != ""), separator).alias(keywords), first)
    return out.select(key, keywords, *[F.col(f"_first.{c}").alias(c) for c in others])
