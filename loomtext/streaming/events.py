"""Crawl-stream operators: duplicates, late but earlier records, quotas, early ends, task logs.

State is a few numbers for each key; a key's rows of one micro-batch are put in order of
arrival in memory, and ``maxFilesPerTrigger`` bounds a micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.storage import exists, scratch


def arrival(event_id):
    return event_id * 7919 % 1_000_003


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run to the end of what is there; the sink and the state live in shared storage."""
    spark = stream.sparkSession
    out = scratch(spark, "stream")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.select(*keys).dropDuplicates(keys)


def _ordered(frames: Iterator[pd.DataFrame], by: str, row: str) -> pd.DataFrame:
    """Equal rows in the order of their ids, however they were dealt out."""
    return pd.concat(list(frames)).sort_values([by, row], kind="stable")


def earlier_rows(stream: DataFrame, key: Column, at: Column, order: Column, row_id: str) -> DataFrame:
    """The row ids of rows that are the first of their key, or older than all of it that arrived before;
    one without a time is older than none and none is older than it."""
    kind = stream.schema[row_id].dataType.simpleString()

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = _ordered(frames, "order", "row")
        low, kept = state.get[0] if state.exists else None, []
        for row, ms, dated in zip(rows["row"], rows["ms"], rows["dated"], strict=True):
            if low is None or dated and ms < low:
                low = int(ms) if dated else None
                kept.append(row)
        state.update((low,))
        yield pd.DataFrame({row_id: kept})

    rows = stream.select(key.alias("key"), F.col(row_id).alias("row"), F.coalesce(at, F.lit(0)).alias("ms"), at.isNotNull().alias("dated"), order.alias("order"))
    return rows.groupBy("key").applyInPandasWithState(step, f"{row_id} {kind}", "low long", "append", GroupStateTimeout.NoTimeout)


def earlier_records(stream: DataFrame) -> DataFrame:
    """Events that are a user's first, or older than all of the user's before them."""
    return earlier_rows(stream, F.col("user_id"), F.expr("unix_micros(cast(ts as timestamp))"), arrival(F.col("event_id")), "event_id")


def accepted_posts(stream: DataFrame, prefix: int, at: Column, order: Column, n: int, stratum: str, text: str, row_id: str) -> DataFrame:
    """row id, accepted_as: posts by the rules of a crawl. The first of a text's prefix takes a
    place of its stratum's quota ('new') while there is one; a later post of a prefix that has
    been seen is dropped if it isn't older, else it is emitted beside the quota ('earlier')."""
    kind = stream.schema[row_id].dataType.simpleString()

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState):
        rows = _ordered(frames, "order", "row")
        done, keys, lows = state.get if state.exists else (0, [], [])
        seen, out = dict(zip(keys, lows, strict=True)), []
        for row, head, ms in zip(rows["row"], rows["head"], rows["ms"], strict=True):
            if head in seen:
                if ms < seen[head]:
                    seen[head] = int(ms)
                    out.append((row, "earlier"))
            elif done < n:
                done, seen[head] = done + 1, int(ms)
                out.append((row, "new"))
        state.update((done, list(seen), list(seen.values())))
        yield pd.DataFrame(out, columns=[row_id, "accepted_as"])

    rows = stream.select(F.col(stratum).alias("stratum"), F.col(row_id).alias("row"), F.substring(text, 1, prefix).alias("head"), at.alias("ms"), order.alias("order"))
    return rows.groupBy("stratum").applyInPandasWithState(step, f"{row_id} {kind}, accepted_as string", "done long, heads array<string>, lows array<long>", "append", GroupStateTimeout.NoTimeout)


def quota(stream: DataFrame, n: int = 50) -> DataFrame:
    """The first n events of each type, by arrival, then id."""

    def step(_, frames: Iterator[pd.DataFrame], state: GroupState):
        done = state.get[0] if state.exists else 0
        rows = _ordered((f.nsmallest(max(0, n - done), ["order", "event_id"]) for f in frames), "order", "event_id")[: max(0, n - done)]
        state.update((done + len(rows),))
        yield rows[["event_id", "event_type"]]

    # The arrival by Spark: pandas' remainders of negative numbers are others than SQL's.
    rows = stream.select("event_id", "event_type", arrival(F.col("event_id")).alias("order"))
    return rows.groupBy("event_type").applyInPandasWithState(step, "event_id long, event_type string", "n long", "append", GroupStateTimeout.NoTimeout)


def until_older(stream: DataFrame, at: str, bound: Column, sink: Callable[[DataFrame], None]) -> int:
    """Feed ``sink`` the rows not older than ``bound`` of an ordered source, newest first, and end
    after the first micro-batch that holds an older one; the number of micro-batches read."""
    read: list[bool] = []

    def step(batch: DataFrame, _: int) -> None:
        if read and read[-1]:
            return  # what lies behind the bound isn't wanted
        sink(batch.where(F.col(at) >= bound))
        read.append(bool(batch.agg(F.max(F.col(at) < bound)).first()[0]))

    state = f"{scratch(stream.sparkSession, 'early')}-state"
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    while query.isActive and not (read and read[-1]):
        query.awaitTermination(1)
    query.stop()
    return len(read)


TASKS = "task string, status string, rows long, error string"


def run_tasks(spark: SparkSession, tasks: Sequence[str], work: Callable[[str], DataFrame], folder: str, empty_stop: int = 5) -> DataFrame:
    """The log (task, status, rows, error) of ``work`` on each task, whose rows go to a folder of
    the task's own. Tasks whose rows are there already are skipped; one that fails is noted and
    the others go on; after ``empty_stop`` empty ones in a row the rest are left pending. A
    second call with the same folder does what is failed or pending."""
    log, streak = [], 0
    for task in tasks:
        path = f"{folder.rstrip('/')}/{task}"
        if exists(spark, f"{path}/_SUCCESS"):
            log.append((task, "skipped", spark.read.parquet(path).count(), ""))
        elif streak >= empty_stop:
            log.append((task, "pending", 0, ""))
        else:
            try:
                work(task).write.mode("overwrite").parquet(path)
                n = spark.read.parquet(path).count()
                log.append((task, "complete", n, ""))
                streak = 0 if n else streak + 1
            except Exception as e:  # noqa: BLE001  one day's failure is the log's business
                log.append((task, "failed", 0, str(e).splitlines()[0][:300]))
    return spark.createDataFrame(log, TASKS)


def year_status(log: DataFrame, year: Column) -> DataFrame:
    """year, status: complete, or partial if any of its tasks failed or is pending, for the next run."""
    open_ = F.max(F.col("status").isin("failed", "pending").cast("int"))
    return log.groupBy(year.alias("year")).agg(F.when(open_ == 1, "partial").otherwise("complete").alias("status"), F.sum("rows").alias("rows"))


def clean_items(stream: DataFrame, reasons: Column) -> DataFrame:
    """The stream with the reasons to drop each item; blank ones stay."""
    return stream.withColumn("removal_reason", reasons)
