"""Components against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.llm import common, graph


def plain(edges):
    near, found = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in sorted(near):
        if start not in found:
            todo, found[start] = [start], start
            while todo:
                for x in near[todo.pop()]:
                    if x not in found:
                        found[x] = start
                        todo.append(x)
    return found


def cases():
    rng = random.Random(1)
    yield [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    yield [(i, i + 1) for i in range(120)]
    yield [(7, i) for i in range(8, 400)] + [(i, 1000 + i) for i in range(8, 30)]
    yield [(5, 5), (3, 9), (9, 3), (3, 9)]


@pytest.mark.parametrize("local", [graph.LOCAL, 40])
@pytest.mark.parametrize("edges", cases(), ids=["random", "path", "hub", "loops"])
def test_components(spark, edges, local, monkeypatch):
    """In one task, and by stars over several with hubs joined by broadcast."""
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    df = spark.createDataFrame([(a, b, "x") for a, b in edges], "a long, b long, node string").repartition(8)
    got = {r.node: r.component for r in graph.components(df, local=local).collect()}
    assert got == plain([(a, b) for a, b in edges if a != b])


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([(None, 1)], "a long, b long")).collect() == []


def test_hot_keys_join_as_others(spark, monkeypatch):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 3, None, i]), rng.randrange(3)) for i in range(600)], "i long, k long, p long")
    for key in ("k", ["k", "p"]):
        keys = common.materialise(rows.groupBy(key if isinstance(key, list) else [key]).agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND k IS NOT NULL"), "keys")
        want = sorted(map(tuple, rows.join(keys, key).select("i", "n").collect()))
        for least in (5, 10_000):
            monkeypatch.setattr(common, "HOT_ROWS", least)
            assert sorted(map(tuple, common.join_keys(rows, keys, key, "n").select("i", "n").collect())) == want
