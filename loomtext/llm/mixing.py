"""Mixing sources to target weights (operator 3).

Every document gets a hash-random key. Keys are uniform, so each source is range
partitioned by key into as many ranges as its row count asks for; a hot source
has more ranges, never a larger one. Range totals give distributed prefix sums,
and each source is cut where its budget ends, after as many whole epochs as fit.

Cases: a null text has size 0; the null source is a source of its own, ordered
last; repeated rows are separate documents; a null id sorts by its empty text; a text
of any length counts whole; an empty table gives an empty result; other columns are
ignored by the figures and kept by the mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: At most so many source rows are broadcast; beyond it the join shuffles.
BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, n, target): shares by weight, stopped at cap x size.

    Sources whose cap lies below the common level are filled to the cap; the level
    is what remains over the weights that remain, so one pass in the order of
    cap / weight finds the fixed point of resharing the excess.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        totals.withColumn("weight", weight)
        .withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("left_size", F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("water", F.col("left_size") / F.col("left_weight"))
        .withColumn("open", F.col("water") <= F.col("level"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("water"))).over(everything))
        .withColumn("target", F.when(F.col("open"), F.least(F.col("final") * F.col("weight"), F.col("limit"))).otherwise(F.col("limit")))
        .select("source", "source_size", "n", "target")
    )


def _ranged(docs: DataFrame, weights: Sequence[float], cap: float, seed: str, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, size and the figures of the source of each row, with its range; and
    (source, part, part_size, offset): the size of each range and of those before it."""
    sized = materialise(docs.select("doc_id", "source", _size().alias("size"), _key(seed).alias("key")), "mix-sized")
    targets = materialise(source_targets(sized, weights, cap), "mix-targets")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    ranged = (
        sized.alias("d")
        .join(_few_sources(targets).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.*", "source_size", "target", F.floor(place * F.ceil(F.col("n") / rows_per_range)).alias("part"), epochs.alias("epochs"))
        .withColumn("left_over", budget - F.col("epochs") * F.col("source_size"))
    )
    sums = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return ranged, sums.select("source", "part", "part_size", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("offset"))


def _size() -> F.Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")


def _key(seed: str) -> F.Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _few_sources(sources: DataFrame) -> DataFrame:
    """A written table of one row a source, marked for a broadcast if there are few."""
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", rows_per_range: int = 4096) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs for each document.

    ``taken`` is exact: the sum over a source is its target rounded to whole words.
    """
    ranged, offsets = _ranged(docs, weights, cap, seed, rows_per_range)
    inner = Window.partitionBy("d.source", "d.part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.alias("d")
        .join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.part") == F.col("o.part")))
        .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .withColumn("rest", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_over") - F.col("before"))))
        .select("doc_id", "d.source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("rest")).cast("long").alias("taken"), "epochs")
    )


def _cuts(docs: DataFrame, weights: Sequence[float], cap: float, seed: str, rows_per_range: int) -> DataFrame:
    """source, epochs and where the last, partial epoch ends: rows before ``cut`` (key,
    doc_id, size) are whole, and of each row that equals it ``share`` words are taken."""
    ranged, offsets = _ranged(docs, weights, cap, seed, rows_per_range)
    same = F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.part") == F.col("o.part"))
    crossed = ranged.alias("d").join(offsets.alias("o"), same).where("left_over >= offset AND left_over < offset + part_size")  # one range a source
    groups = crossed.groupBy("d.source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("m"), F.first("left_over").alias("left_over"), F.first("offset").alias("offset"))
    earlier = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("left_over") - F.col("offset") - F.coalesce(F.sum(F.col("m") * F.col("size")).over(earlier), F.lit(0))
    here = groups.withColumn("rest", rest).where("rest >= 0 AND rest < m * size")
    here = here.select("source", F.struct("key", "doc_id", "size").alias("cut"), F.floor(F.col("rest") / F.col("m")).alias("share"))
    every = ranged.groupBy("source").agg(F.first("epochs").alias("epochs"))
    return every.alias("e").join(here.alias("h"), F.col("e.source").eqNullSafe(F.col("h.source")), "left").select("e.source", "epochs", "cut", "share")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, seed: str = "mix", rows_per_range: int = 4096) -> DataFrame:
    """The mix itself: a row for each copy that it takes of a document, with the document's
    columns, ``epoch`` (from 1) and ``taken`` (the copy's words) in place of columns of those
    names. In a source's last epoch the document at the cut is shortened to what the budget
    leaves (n_chars follows). Only the cuts, one row a source, reach the documents, which
    stay where they lie. Rows that share id and size and lie at the cut share it evenly."""
    names = [c for c in docs.columns if c not in ("epoch", "taken")]
    cuts = _few_sources(materialise(_cuts(docs, weights, cap, seed, rows_per_range), "mix-cuts")).select(F.struct("source", "epochs", "cut", "share").alias("at"))
    rows = docs.select(F.struct(*names).alias("row"), F.struct(_key(seed).alias("key"), "doc_id", _size().alias("size")).alias("own"))
    joined = rows.join(cuts, F.col("row.source").eqNullSafe(F.col("at.source")))
    last = F.when(F.col("own") < F.col("at.cut"), F.col("own.size")).when(F.col("own") == F.col("at.cut"), F.col("at.share")).otherwise(F.lit(0))
    whole = F.when(F.col("own.size") > 0, F.col("at.epochs")).otherwise(F.lit(0)).cast("int")
    counted = joined.withColumn("last", last).withColumn("copies", whole + (F.col("last") > 0).cast("int")).where("copies > 0")
    copies = counted.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    taken = F.when(F.col("epoch") > F.col("at.epochs"), F.col("last")).otherwise(F.col("own.size")).cast("long")
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(taken < F.col("own.size"), F.array_join(F.slice(pieces, F.lit(1), taken.cast("int")), "")).otherwise(F.col("row.text"))
    out = copies.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names], "epoch", taken.alias("taken"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             3.0::DOUBLE * source_size AS lim FROM s),
l AS (SELECT *, lim / weight AS level FROM w),
q AS (SELECT *, ((SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(lim) OVER b, 0.0::DOUBLE))
             / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER b, 0.0::DOUBLE)) AS water
      FROM l WINDOW b AS (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN water <= level
             THEN least((SELECT max(water) FROM q WHERE water <= level) * weight, lim) ELSE lim END AS target FROM q),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
             (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM e
"""
