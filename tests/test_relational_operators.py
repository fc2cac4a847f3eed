"""Operators outside the plan catalogue: oracles on the smallest tables and fixtures."""

import itertools
import random

import duckdb
import pytest

from loomtext.operators.topics import best_assignment
from loomtext.operators import ranks
from loomtext.plans.dialect import TABLES
from loomtext.queries import ORACLES, QUERIES
from loomtext.sources import storage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        expected = sorted(con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]}) q").fetchall())
        mine = sorted(map(tuple, rows))
        assert [pytest.approx(r, rel=1e-9) for r in expected] == mine if name == "spearman" else mine == expected


def test_assignment_is_the_best():
    rng = random.Random(1)
    for _ in range(20):
        cost = [[rng.random() for _ in range(5)] for _ in range(4)]
        least = min(sum(cost[i][c] for i, c in enumerate(p)) for p in itertools.permutations(range(5), 4))
        assert abs(sum(cost[i][c] for i, c in enumerate(best_assignment(cost))) - least) < 1e-12


def test_encodings():
    assert storage.detect_encoding("Überschrift".encode()) == "utf-8"
    assert storage.detect_encoding("婚姻登记".encode("gb18030")) == "gb18030"


@pytest.mark.parametrize("ranges", [1, 3, 128])
def test_ranks_in_ranges(spark, ranges):
    rng = random.Random(2)
    rows = [(i, rng.choice("abb"), rng.choice([None, 1, 1, 1, 2, 5, 9, i])) for i in range(200)] + [(900, None, 4)]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    big = float("inf")
    values = [big if v is None else v for *_, v in rows]
    expected = {i: sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2 for (i, *_), v in zip(rows, values, strict=True)}
    assert {r.id: r.rank for r in ranks.with_rank(df, "v", "rank", ranges).collect()} == expected
    numbered = sorted(ranks.row_numbers(df, "g", "v", "place", ranges).collect(), key=lambda r: r.place)
    assert [r.place for r in numbered] == list(range(len(rows)))
    order = [(r.g is None, r.g or "", big if r.v is None else r.v) for r in numbered]
    assert order == sorted(order)
    assert ranks.average_ranks(df.limit(0), "v").collect() == []
    assert ranks.row_numbers(df.limit(0), "g", "v").collect() == []
