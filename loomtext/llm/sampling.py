"""The bounded, reproducible sample of labelled rows that the classifiers learn from.

Cases: labels that are null, or whose id is, are no labels; an id with several labels
takes the largest; of rows that share an id the one with the least text digest stands
for it; null texts are empty; a text longer than the bound on bytes isn't sampled; empty
tables give an empty sample; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_share, held_out, materialise

#: Bytes of text that a sample holds at most.
TRAIN_BYTES = 256 << 20


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, bound: int, seed: str, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """At most ``bound`` labelled rows (key, doc_id, label, text) of ``max_bytes`` together,
    none of the held-out fold, in the order of a hash of the id.

    The bounds make the sample safe to broadcast and to train on in one task.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
        .select("doc_id", "label", hashed_share("doc_id", seed).alias("key"))
        .orderBy("key", "doc_id")
        .limit(bound)
    )
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= max_bytes)
    found = found.join(F.broadcast(chosen), "doc_id")  # ``bound`` rows at most
    one = found.groupBy("doc_id").agg(F.first("key").alias("key"), F.first("label").alias("label"), F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("least"))
    rows = materialise(one.select("key", "doc_id", "label", F.col("least.text").alias("text")), "sample")
    size = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = F.broadcast(rows.select("key", "doc_id", size.alias("bytes")).where(F.col("bytes") <= max_bytes).select("doc_id"))
    return rows.join(inside, "doc_id", "left_semi")
