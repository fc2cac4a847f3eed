"""Statistics of labels, scores and groups, for any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import average_ranks


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def half_even(c: Column, digits: int) -> Column:
    """Rounded to ``digits`` decimals, halves to the even neighbour, on the binary number."""
    return F.rint(c * 10.0**digits) / 10.0**digits


def classification_report(df: DataFrame, truth: str, guess: str, classes: Sequence[int]) -> DataFrame:
    """class, precision, recall, f1 and support of each class; shares of nothing are 0."""
    sums = [f(c) for c in classes for f in (
        lambda c: F.count(F.when((F.col(truth) == c) & (F.col(guess) == c), 1)).alias(f"hit_{c}"),
        lambda c: F.count(F.when(F.col(guess) == c, 1)).alias(f"guessed_{c}"),
        lambda c: F.count(F.when(F.col(truth) == c, 1)).alias(f"true_{c}"),
    )]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"hit_{c}").alias("hit"), F.col(f"guessed_{c}").alias("guessed"), F.col(f"true_{c}").alias("support")) for c in classes])).alias("x")
    rows = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull()).agg(*sums).select(each).select("x.*")
    rows = rows.withColumn("precision", _share(F.col("hit"), F.col("guessed"))).withColumn("recall", _share(F.col("hit"), F.col("support")))
    return rows.select("class", "precision", "recall", _share(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"), "support")


def agreement(df: DataFrame, truth: str, guess: str, classes: Sequence[int]) -> DataFrame:
    """n, accuracy, macro_f1 (over ``classes``) and Cohen's kappa (null where chance explains all)."""
    known = df.where(F.col(truth).isNotNull() & F.col(guess).isNotNull())
    counts = known.groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.select(F.explode(F.array(F.struct(F.col("t").alias("c"), F.col("n").alias("a"), F.lit(0).cast("long").alias("b")), F.struct(F.col("g").alias("c"), F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))).alias("x")).select("x.*")
    chance = per.groupBy("c").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("chance"))
    hits = counts.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("t") == F.col("g"), F.col("n"))), F.lit(0)).alias("hit"))
    f1 = classification_report(df, truth, guess, classes).agg(F.avg("f1").alias("macro_f1"))
    one = hits.crossJoin(chance).crossJoin(f1)  # one row each
    po, pe = F.col("hit") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return one.select("n", po.alias("accuracy"), "macro_f1", F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """U of the rows where ``first`` holds and its two-sided p, by the normal approximation
    with corrections for ties and continuity (null without rows on both sides or any spread)."""
    ranks = average_ranks(df.where(F.col(value).isNotNull() & first.isNotNull()), value).select(F.col(value).alias("_value"), "average_rank")
    held = df.where(first.isNotNull()).groupBy(value).agg(F.sum(F.when(first, 1).otherwise(0)).alias("k"), F.count(F.lit(1)).alias("n"))
    sums = held.join(ranks, F.col(value) == F.col("_value")).agg(
        F.sum("k").cast("double").alias("a"), F.sum("n").cast("double").alias("n"), F.sum(F.col("k") * F.col("average_rank")).alias("r"),
        F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("ties"),
    )
    a, n = F.col("a"), F.col("n")
    b = n - a
    u = F.col("r") - a * (a + 1) / 2
    spread = F.sqrt(a * b / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(u - a * b / 2) - 0.5) / spread
    return sums.select(u.alias("u"), F.when((a > 0) & (b > 0) & (spread > 0), F.least(F.lit(1.0), 2 * (1 - normal_cdf(z)))).alias("p"))


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution function, to about 1e-12: a series near zero, a
    continued fraction in the tails."""
    x = F.abs(z)
    density = F.exp(-x * x / 2) / F.lit(2.5066282746310002)
    state = F.struct(x.alias("term"), x.alias("total"))

    def next_(a: Column, k: Column) -> Column:
        term = a["term"] * x * x / (2 * k + 1)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), state, next_, lambda a: a["total"])
    fraction = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / a)
    upper = F.when(x < 3, 0.5 + density * series).otherwise(1 - density / fraction)
    return F.when(z < 0, 1 - upper).otherwise(upper)


def trimmed_mean(df: DataFrame, group: Sequence[str], value: str, share: float = 0.1, least: int = 10) -> DataFrame:
    """The groups with their mean of all but the least and the greatest ``share`` of rows (one at
    least on each side; groups of fewer than ``least`` rows are whole). Equal values are counted
    before they are ordered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    inside = Window.partitionBy(*group)
    below = F.coalesce(F.sum("_n").over(inside.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(inside)
    placed = counts.select(*group, value, "_n", below.alias("_below"), total.alias("_total"))
    cut = F.when(F.col("_total") < least, 0).otherwise(F.greatest(F.lit(1), F.floor(F.col("_total") * share)))
    kept = F.greatest(F.lit(0), F.least(F.col("_below") + F.col("_n"), F.col("_total") - cut) - F.greatest(F.col("_below"), cut))
    sums = placed.select(*group, value, kept.alias("_kept")).groupBy(*group)
    return sums.agg((F.sum(F.col("_kept") * F.col(value)) / F.sum("_kept")).alias("trimmed_mean"), F.sum("_kept").alias("n_kept"))


def mean_interval(df: DataFrame, group: Sequence[str], value: str, single: float | None = None) -> DataFrame:
    """n, mean and half the width of the 95 % interval; ``single`` for fewer than two rows."""
    rows = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("_sd"))
    return rows.select(*group, "n", "mean", F.when(F.col("n") >= 2, 1.96 * F.col("_sd") / F.sqrt("n")).otherwise(F.lit(single).cast("double")).alias("ci"))


def histogram(df: DataFrame, value: str, low: float, high: float, edges: int = 70, group: Sequence[str] = ()) -> DataFrame:
    """bin, its edges, n and density of the values between ``edges`` equally spaced edges; the
    last bin is closed, values outside aren't counted, empty bins have 0 rows."""
    bins, width = edges - 1, (high - low) / (edges - 1)
    at = F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(*group, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    every = df.select(*group).distinct().select(*group, grid) if group else df.sparkSession.range(1).select(grid)
    total = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    filled = every.join(counts, [*group, "bin"], "left").join(F.broadcast(total), [*group], "left") if group else every.join(counts, "bin", "left").crossJoin(F.broadcast(total))
    n = F.coalesce("n", F.lit(0))
    return filled.select(*group, "bin", (F.col("bin") * width + low).alias("low"), ((F.col("bin") + 1) * width + low).alias("high"), n.alias("n"), F.when(F.col("_total") > 0, n / (F.col("_total") * width)).otherwise(F.lit(0.0)).alias("density"))


def recall_and_direction(df: DataFrame, human: str, model: str, target: int = -1) -> DataFrame:
    """Rows that people gave the target label, how many the model did too, its recall, and
    errors by direction (the model above or below the human label)."""
    known = df.where(F.col(human).isNotNull() & F.col(model).isNotNull())
    n = lambda c: F.count(F.when(c, 1))
    hit, own = n((F.col(human) == target) & (F.col(model) == target)), n(F.col(human) == target)
    return known.agg(own.alias("n_target"), hit.alias("n_found"), F.when(own > 0, hit / own).alias("recall"), n(F.col(model) > F.col(human)).alias("too_high"), n(F.col(model) < F.col(human)).alias("too_low"))


def box_statistics(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, Tukey whiskers and the percentage of outliers of each group, ordered by median."""
    q = lambda p: F.percentile(value, F.lit(p))
    quartiles = df.groupBy(group).agg(q(0.25).alias("q1"), q(0.5).alias("median"), q(0.75).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    rows = df.join(F.broadcast(quartiles), group).groupBy(group, "q1", "median", "q3")  # one row a group
    ends = rows.agg(F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count(F.when(~inside, 1)).alias("outliers"), F.count(value).alias("n"))
    return ends.select("*", (100 * F.col("outliers") / F.col("n")).alias("outlier_pct")).orderBy("median", group)


def verdict(value: Column, limits: Sequence[tuple[float, str]], otherwise: str = "FAIL") -> Column:
    """The name of the first limit (from the highest) that the value reaches; null has the last."""
    out = F.lit(otherwise)
    for least, name in sorted(limits):
        out = F.when(value >= least, name).otherwise(out)
    return out


def zero_streak(df: DataFrame, group: str, order: str, count: str, stop: int = 5) -> DataFrame:
    """The group's tasks up to and with the ``stop``-th empty one in a row; later ones aren't run."""
    w = Window.partitionBy(group).orderBy(order)
    filled = F.sum((F.col(count) > 0).cast("int")).over(w)
    run = df.withColumn("_block", filled).withColumn("_streak", F.sum((F.col(count) == 0).cast("int")).over(Window.partitionBy(group, "_block").orderBy(order)))
    tripped = F.max((F.col("_streak") >= stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return run.withColumn("_before", F.coalesce(tripped, F.lit(0))).where("_before = 0").drop("_block", "_streak", "_before")
