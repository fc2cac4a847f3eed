"""Stream operators over several micro-batches, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.streaming import events


def batches(spark, tmp_path, rows, schema, n=4):
    """A stream that reads ``rows`` in n files, one a micro-batch."""
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{i}")
    files = spark.readStream.schema(spark.read.schema(schema).parquet(f"file://{tmp_path}/in/0").schema)
    return files.option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")


def arriving(n=240):
    """(event_id, user_id, type, ms) in order of arrival."""
    rng = random.Random(3)
    rows = [(i, rng.randrange(12), rng.choice(["a", "b", "c"]), rng.randrange(10_000)) for i in range(n)]
    return sorted(rows, key=lambda r: events.arrival(r[0]))


def test_earlier_records_over_batches(spark, tmp_path):
    rows, low, want = arriving(), {}, set()
    for i, user, _, ms in rows:
        if user not in low or ms < low[user]:
            low[user] = ms
            want.add(i)
    stream = batches(spark, tmp_path, rows, "event_id long, user_id long, event_type string, ms long")
    got = events.drained(events.earlier_rows(stream, F.col("user_id"), F.col("ms"), events.arrival(F.col("event_id")), "event_id"))
    assert {r.event_id for r in got.collect()} == want


def test_quota_over_batches(spark, tmp_path):
    rows = arriving()
    want = {r[0] for t in "abc" for r in [r for r in rows if r[2] == t][:50]}
    got = events.drained(events.quota(batches(spark, tmp_path, rows, "event_id long, user_id long, event_type string, ms long")))
    assert {r.event_id for r in got.collect()} == want


def test_first_seen_over_batches(spark, tmp_path):
    rows = arriving()
    got = events.drained(events.first_seen(batches(spark, tmp_path, rows, "event_id long, user_id long, event_type string, ms long"), ["user_id", "event_type"]))
    assert sorted(map(tuple, got.collect())) == sorted({(r[1], r[2]) for r in rows})


def test_posts_by_prefix_and_quota(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice(["k1", "k2"]), f"{rng.randrange(30):020d} tail {i}", rng.randrange(1000)) for i in range(200)]
    want, state = set(), {}
    for i, stratum, text, ms in rows:
        done, seen = state.setdefault(stratum, [0, {}])
        head = text[:20]
        if head in seen:
            if ms < seen[head]:
                seen[head] = ms
                want.add((i, "earlier"))
        elif done < 9:
            state[stratum][0] += 1
            seen[head] = ms
            want.add((i, "new"))
    stream = batches(spark, tmp_path, rows, "id long, stratum string, text string, ms long", 5)
    got = events.drained(events.accepted_posts(stream, 20, F.col("ms"), F.col("id"), 9, "stratum", "text", "id"))
    assert {tuple(r) for r in got.collect()} == want and sum(k == "new" for _, k in want) == 18


def test_an_ordered_source_ends_early(spark, tmp_path):
    rows = [(i, 1000 - i) for i in range(120)]
    taken: list = []
    n = events.until_older(batches(spark, tmp_path, rows, "id long, ms long", 6), "ms", F.lit(950), lambda df: taken.extend(df.collect()))
    assert {r.id for r in taken} == set(range(51)) and n == 3


def test_days_fail_alone(spark, tmp_path):
    broken = {"2021-01-02"}

    def work(day):
        if day in broken:
            raise OSError("no reply\nsecond line")
        return spark.createDataFrame([(day, i) for i in range(int(day[-1]))], "day string, n long")

    days = ["2021-01-01", "2021-01-02", "2022-01-03"]
    log = events.run_tasks(spark, days, work, f"file://{tmp_path}/t")
    assert [tuple(r) for r in log.collect()] == [("2021-01-01", "complete", 1, ""), ("2021-01-02", "failed", 0, "no reply"), ("2022-01-03", "complete", 3, "")]
    years = {r.year: r.status for r in events.year_status(log, F.substring("task", 1, 4)).collect()}
    assert years == {"2021": "partial", "2022": "complete"}
    broken.clear()
    log = events.run_tasks(spark, days, work, f"file://{tmp_path}/t")
    assert [(r.status, r.rows) for r in log.collect()] == [("skipped", 1), ("complete", 2), ("skipped", 3)]


def test_empty_tasks_break_the_circuit(spark, tmp_path):
    log = events.run_tasks(spark, [f"t{i}" for i in range(5)], lambda t: spark.createDataFrame([], "x long"), f"file://{tmp_path}/t", empty_stop=3)
    assert [r.status for r in log.collect()] == ["complete"] * 3 + ["pending"] * 2


@pytest.mark.parametrize("n", [1, 4])
def test_items_carry_their_reasons(spark, tmp_path, n):
    rows = [(1, "short"), (2, "long enough"), (3, "")]
    stream = batches(spark, tmp_path, rows, "id long, text string", 1)
    reasons = F.concat_ws("; ", F.when(F.col("text") == "", "blank"), F.when(F.length("text") < 8, "short"))
    got = events.drained(events.clean_items(stream, reasons))
    assert {r.id: r.removal_reason for r in got.collect()} == {1: "short", 2: "", 3: "blank; short"}
