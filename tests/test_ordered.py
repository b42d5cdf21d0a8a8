"""Chunked ordered work against plain Python, with one group holding most rows."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tracelake.operators import ordered as O


@pytest.fixture(scope="module")
def data(spark):
    draw = random.Random(5)
    rows = [(f"g{min(draw.randrange(9), 3)}", float(draw.randrange(40)), i) for i in range(3000)]
    groups = {}
    for group, value, i in rows:
        groups.setdefault(group, []).append((value, i))
    for members in groups.values():
        members.sort()
    return spark.createDataFrame(rows, "g string, t double, ord bigint"), groups


@pytest.mark.parametrize("chunks", [None, 7, 60])
def test_neighbours_and_rank(data, chunks):
    df, groups = data
    after, before, rank = {}, {}, {}
    for members in groups.values():
        for k, (_, i) in enumerate(members):
            after[i] = members[k + 1][0] if k + 1 < len(members) else None
            before[i] = members[k - 1][0] if k else None
            rank[i] = k + 1
    got = O.with_next(df, ["g"], ["t", "ord"], "t", "x", chunks).collect()
    assert {r.ord: r.x for r in got} == after
    got = O.with_previous(df, ["g"], ["t", "ord"], "t", "x", chunks).collect()
    assert {r.ord: r.x for r in got} == before
    got = O.with_rank(df, ["g"], ["t", "ord"], "x", chunks).collect()
    assert {r.ord: r.x for r in got} == rank
    got = O.with_rank(df, [], ["t", "ord"], "x", chunks).collect()
    assert [r.x for r in sorted(got, key=lambda r: (r.t, r.ord))] == list(range(1, 3001))


@pytest.mark.parametrize("chunks", [None, 40])
def test_order_statistics(data, chunks):
    df, groups = data
    counted = df.groupBy("g", "t").agg(F.count(F.lit(1)).alias("n"))
    wanted = {"q1": O.lower_hinge_ranks, "q2": O.median_ranks, "q3": O.upper_hinge_ranks, "top": lambda n: [n]}
    for row in O.order_statistics(counted, ["g"], "t", "n", wanted, chunks).collect():
        values = [value for value, _ in groups[row.g]]
        half = len(values) // 2
        assert row.q1 == statistics.median(values[:half])
        assert row.q2 == statistics.median(values)
        assert row.q3 == statistics.median(values[(len(values) + 1) // 2 :])
        assert row.top == values[-1]


def test_order_with_nulls_and_chunk_split(spark):
    rows = [("a", None, 1), ("a", 2.0, 2), (None, 1.0, 3), ("a", None, 4), (None, None, 5), ("a", 1.0, 6)]
    df = spark.createDataFrame(rows, "g string, t double, ord bigint")
    for chunks in (1, 4):
        got = O.with_rank(df, ["g"], ["t", "ord"], "x", chunks).collect()
        assert {r.ord: r.x for r in got} == {1: 1, 4: 2, 6: 3, 2: 4, 5: 1, 3: 2}


def test_chunks_spread_one_hot_group(spark):
    df = spark.range(20000).select(F.lit("hot").alias("g"), F.lit(1.0).alias("t"), F.col("id").alias("ord"))
    chunked = O.with_chunks(df, ["g", "t", "ord"], 10)
    sizes = [row["count"] for row in chunked.groupBy("_chunk").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 6000 and sum(sizes) == 20000
