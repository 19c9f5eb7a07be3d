"""Key-splitting building blocks against plain windows."""

import random
import statistics

import numpy as np
import pytest
from conftest import plan_of
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plangauge.operators import skew


@pytest.fixture(scope="module")
def log(spark):
    generator = random.Random(7)
    data, step = [], 0
    for _ in range(900):
        step += generator.choice([1, 1, 2, 40])
        key = "hot" if generator.random() < 0.4 else f"k{generator.randrange(5)}"
        data.append((key, step, float(generator.randrange(100))))
    return spark.createDataFrame(data, "run_id string, step long, value double").cache()


def as_set(df, *columns):
    return {tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect()}


def test_top_n(log):
    expected = log.withColumn("_rank", F.row_number().over(W.partitionBy("run_id").orderBy("step"))).filter("_rank <= 7")
    got = skew.top_n_per_key(log, ["run_id"], [F.col("step").asc()], 7, ["step"], salts=5)
    assert as_set(got, "run_id", "step", "_rank") == as_set(expected, "run_id", "step", "_rank")


def test_top_n_limits_before_the_shuffle(log):
    text = plan_of(skew.top_n_per_key(log, ["run_id"], [F.col("step").asc()], 7, ["step"]))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize("span", [1, 13, 100000])
def test_position_and_prefix(log, span):
    w = W.partitionBy("run_id").orderBy("step")
    expected = log.withColumn("_pos", F.row_number().over(w).cast("long")).withColumn(
        "s", F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0))
    )
    got = skew.with_prefix(log, ["run_id"], "step", {"_pos": F.lit(1).cast("long"), "s": F.col("value")}, span)
    assert as_set(got, "run_id", "step", "_pos", "s") == as_set(expected, "run_id", "step", "_pos", "s")


@pytest.mark.parametrize("width,span", [(10, 10), (10, 37), (3, 100000)])
def test_rolling(log, width, span):
    w = W.partitionBy("run_id").orderBy("step").rowsBetween(-(width - 1), 0)
    expected = log.withColumn("m", F.avg("value").over(w))
    placed = skew.with_position(log, ["run_id"], "step", span=span)
    got = skew.rolling(placed, ["run_id"], width, {"m": F.avg("value")}, block=span)
    assert got.count() == log.count()
    assert as_set(got, "run_id", "step", "m") == as_set(expected, "run_id", "step", "m")


def test_top_n_limits_many_rows_before_the_shuffle(log):
    limited = skew.top_n_per_key(log, ["run_id"], [F.col("step").asc()], 3000, ["step"])
    assert plan_of(limited).count("WindowGroupLimit") >= 6  # partial and final, in three stages
    assert limited.count() == log.count()


def test_prefix_of_sparse_values(spark):
    """Steps 10^9 and 10^15 apart, below zero too."""
    data = [("a", k * 10**9 - 5 * 10**10, k) for k in range(100)] + [("a", k * 10**15, 1) for k in range(1, 9000, 7)]
    df = spark.createDataFrame(data, "k string, at long, v long")
    got = {r["at"]: r["s"] for r in skew.with_prefix(df, ["k"], "at", {"s": F.col("v")}).collect()}
    total = 0
    for _, at, v in sorted(data, key=lambda r: r[1]):
        total += v
        assert got[at] == total


def test_exact_median(log):
    expected = {}
    for r in log.collect():
        expected.setdefault(r["run_id"], []).append(r["value"])
    out = skew.exact_median(log, ["run_id"], "value", F.max("step").alias("last")).collect()
    assert {r["run_id"]: (r["median"], r["n"]) for r in out} == {k: (statistics.median(v), len(v)) for k, v in expected.items()}
    assert out[0]["last"] == log.filter(F.col("run_id") == out[0]["run_id"]).agg(F.max("step")).first()[0]


def test_exact_median_of_one_hot_key(spark):
    """A key with most rows, all values different, beside keys of one and two values."""
    hot = spark.range(0, 400_001, numPartitions=6).select(F.lit("hot").alias("k"), F.sqrt(F.col("id") * 7919 % 400_001).alias("v"))
    few = spark.createDataFrame([("one", 3.5), ("two", 1.0), ("two", 2.0)], "k string, v double")
    got = {r["k"]: (r["median"], r["n"]) for r in skew.exact_median(hot.union(few), ["k"], "v").collect()}
    assert got == {"hot": (200_000**0.5, 400_001), "one": (3.5, 1), "two": (1.5, 2)}


def test_no_task_sees_more_than_the_bound_of_a_key_with_ten_million_values(spark):
    n, bins = 10_000_000, 1024
    hot = spark.range(0, n, numPartitions=8).select(F.lit("hot").alias("k"), (F.col("id") * 2 + F.pmod(F.xxhash64("id"), F.lit(2))).cast("double").alias("v"))
    near = skew.median_candidates(hot, ["k"], "v", bins)
    assert near.count() <= 4 * n / bins**2 + 4  # a bin around each of the two middle ranks
    # the only windows run over bins, or over what is left
    text = plan_of(skew.exact_median(hot, ["k"], "v", bins=bins))
    windows = [line for line in text.splitlines() if "windowspecdefinition(" in line]
    assert windows and all("_bin" in w or "_v" in w for w in windows)


@pytest.mark.parametrize("bins", [2, 3, 50])
def test_exact_median_of_uneven_values(spark, bins):
    import random

    rng = random.Random(bins)
    inf = float("inf")
    sets = {
        "powers": [2.0**k for k in range(-300, 301)], "inf": [1.0, inf, 2.0, -inf, 3.0], "all inf": [inf, inf], "wide": [-1.7e308, 1.7e308, 5e-324, 0.0], "same": [4.0] * 9,
        "even": [rng.gauss(0, 1) for _ in range(300)], "odd": [rng.expovariate(1e-6) for _ in range(301)], "ties": [float(rng.randint(0, 5)) for _ in range(200)], "zeros": [-0.0, 0.0, 1.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in sets.items() for v in vs], "k string, v double")
    got = {r["k"]: r["median"] for r in skew.exact_median(df, ["k"], "v", bins=bins).collect()}
    assert got == {k: statistics.median(v) for k, v in sets.items()}


def test_exact_median_one_value_and_nulls(spark):
    df = spark.createDataFrame([("a", 5.0)] * 4 + [("a", None), ("b", None)], "k string, v double")
    out = {r["k"]: (r["median"], r["n"]) for r in skew.exact_median(df, ["k"], "v").collect()}
    assert out == {"a": (5.0, 4), "b": (None, 0)}


def test_a_task_reads_no_more_when_a_table_grows(spark):
    # some 100 MB are shuffled: four tasks, one a core, would share them
    counts = spark.range(6_000_000).groupBy(F.xxhash64("id").alias("k")).count()
    assert counts.rdd.getNumPartitions() > 4


def test_median_joins_divide_a_hot_key(spark):
    """Half of all rows belong to one key and differ in value: each join with the ranges reads the key in several tasks."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    }
    before = {name: spark.conf.get(name) for name in small}
    key = F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    rows = spark.range(0, 40_000, 1, 8).select(key.alias("key"), (F.col("id") * 7919 % 40_009).cast("double").alias("ms"))
    values = {}
    for i in range(40_000):
        values.setdefault("hot" if i % 2 == 0 else f"k{i % 50}", []).append(i * 7919 % 40_009)
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        found = skew.exact_median(rows, ["key"], "ms")
        assert {r["key"]: (r["median"], r["n"]) for r in found.collect()} == {k: (statistics.median(v), len(v)) for k, v in values.items()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("skew=true") >= skew.ROUNDS + 1
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_rows_of_a_median_are_dealt_before_they_are_counted(spark):
    df = spark.range(1000).selectExpr("CAST(id % 3 AS STRING) AS k", "CAST(id % 400 AS DOUBLE) AS v", "id")
    found = skew.exact_median(df, ["k"], "v", F.max("id").alias("last"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    counted = [at for at, line in enumerate(plan.splitlines()) if "Aggregate" in line and "count(" in line]
    dealt = [at for at, line in enumerate(plan.splitlines()) if "RepartitionByExpression" in line and "_deal" in line]
    assert counted and len(dealt) >= len(counted) and all(any(d > at for d in dealt) for at in counted)
    want = {str(k): (float(np.median([i % 400 for i in range(1000) if i % 3 == k])), max(i for i in range(1000) if i % 3 == k)) for k in range(3)}
    assert {r["k"]: (r["median"], r["last"]) for r in found.collect()} == want
