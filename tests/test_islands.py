"""Unions of spans and span joins against plain versions, with hot keys and long spans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyhawk.operators import callers, islands


@pytest.fixture
def many_segments(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def plain_union(rows, gap=0):
    out = []
    for key, s, e in sorted((r for r in rows if None not in r[1:] and r[2] >= r[1]), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        if out and out[-1][0] == key and s - gap <= out[-1][2]:
            out[-1][2] = max(out[-1][2], e)
            out[-1][3] += 1
        else:
            out.append([key, s, e, 1])
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("gap", [0, 3])
def test_union_of_a_hot_key(spark, many_segments, seed, gap):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), t := rng.randint(-400, 400), t + rng.choice([0, 1, 2, 5, 1 if rng.random() < 0.99 else 300])) for _ in range(500)] + [(4, None, 3), (4, 1, None), (4, 5, 2)]
    df = spark.createDataFrame(rows, "k long, start long, end long")
    got = islands.union_spans(df, ["k"], gap=gap)
    assert sorted(map(tuple, got.select("k", "start", "end", "spans").collect()), key=str) == plain_union(rows, gap)


def test_a_hot_key_is_many_segments(spark, many_segments):
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 9).alias("end"))
    plan = islands.union_spans(hot, ["k"])
    assert plan.count() == 20_000 and plan.where("spans = 1").count() == 20_000
    swallowed = hot.unionByName(spark.createDataFrame([("hot", 5, 10_000_000)], "k string, start long, end long"))
    assert [tuple(r) for r in islands.union_spans(swallowed, ["k"]).select("start", "end", "spans").collect()] == [(0, 10_000_000, 20_001)]


def test_loops_of_a_hot_caller(spark, many_segments):
    rng = random.Random(9)
    times, t = [], 0
    for _ in range(3_000):
        t += rng.choice([1, 2, 30, 31, 90])
        times.append(t)
    df = spark.createDataFrame([("c", x) for x in times] + [("d", 1), ("d", 1), ("e", None)], "caller string, s long").select("caller", F.timestamp_seconds("s").alias("ts"))
    got = {r["caller"]: r for r in callers.loop_cadence(df, ["caller"]).collect()}
    runs, last = [], None
    for x in times:
        if last is not None and x - last <= 30:
            runs[-1] += 1
        else:
            runs.append(1)
        last = x
    loops = [r for r in runs if r >= 3]
    c = got["c"]
    assert (c["calls"], c["loops"], c["longest"], c["calls_in_loops"]) == (len(times), len(loops), max(loops), sum(loops))
    assert got["d"]["calls"] == 1 and got["d"]["loops"] == 0 and "e" not in got


@pytest.mark.parametrize("closed", [False, True])
def test_span_join(spark, closed):
    rng = random.Random(1)
    spans = [(i, rng.choice(["a", "a", "b", None]), s := rng.randint(-1000, 1000), s + rng.choice([0, 1, 2, 3, 4, 7, 8, 9, 60, 3600, 10**9])) for i in range(300)] + [(900, "a", None, 5), (901, "a", 5, None), (902, "a", 9, 3)]
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([rng.randint(-1100, 1100), rng.randint(0, 10**9), None])) for i in range(400)]
    s = spark.createDataFrame(spans, "span long, k string, start long, end long")
    r = spark.createDataFrame(rows, "id long, k string, t long")
    got = islands.join_spans(r, s, ["k"], "t", closed=closed)
    assert got.columns == ["id", "k", "t", "span", "start", "end"]
    holds = lambda t, a, b: a <= t <= b if closed else a <= t < b
    expected = {(i, n) for i, k, t in rows for n, sk, a, b in spans if None not in (k, sk, t, a, b) and k == sk and holds(t, a, b)}
    assert {(x["id"], x["span"]) for x in got.collect() if x["span"] is not None} == expected
    assert got.where("span is not null").count() == len(expected)
    assert {x["id"] for x in got.collect()} == {x[0] for x in rows}
    assert islands.join_spans(r, s.limit(0), ["k"], "t").where("span is null").count() >= 1


def test_long_spans_make_few_rows(spark):
    ten_years = 10 * 365 * 86_400 * 1_000_000
    s = spark.createDataFrame([(1_700_000_000_000_000 + i, 1_700_000_000_000_000 + i + n) for i in range(5) for n in (0, 1, 1_000_000, ten_years)], "start long, end long")
    level = islands._level(F.col("end") - F.col("start"))
    dealt = s.withColumn("b", F.explode(F.sequence(islands._bucket(F.col("start"), level), islands._bucket(F.col("end") - 1, level))))
    assert dealt.where("end > start").groupBy("start", "end").count().agg(F.max("count")).first()[0] <= 2
