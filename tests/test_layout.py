"""Stored layouts: joins without a shuffle, scans that skip on several columns."""

import datetime as dt
import random

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from plangauge.plans import tpch
from plangauge.session import new_work_dir
from plangauge.sources import layout
from plangauge.sources.tables import read_table


def scan_rows(df):
    """Run a query and add up the rows that its file scans give."""
    executed = df._jdf.queryExecution()
    executed.toRdd().count()
    todo, total = [executed.executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_colocated_tables_join_without_a_shuffle(spark, data):
    names = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
    stored = {n: layout.write_colocated(read_table(spark, data, n), f"colocated_{n}", key, 8, new_work_dir(spark, f"colocated-{n}")) for n, key in names.items()}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = stored["orders"].join(stored["lineitem"], F.col("o_orderkey") == F.col("l_orderkey"))
        assert "Exchange" not in plan_of(joined) and "SortMergeJoin" in plan_of(joined)
        by_order = joined.groupBy("o_orderkey").agg(F.count("*").alias("n"))
        assert "Exchange" not in plan_of(by_order)
        plain = read_table(spark, data, "orders").join(read_table(spark, data, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        assert joined.count() == plain.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for n in names:
            spark.sql(f"DROP TABLE colocated_{n}")


def test_curve_takes_the_bits_in_turn(spark):
    rows = [(x, y) for x in range(8) for y in range(8)]
    df = spark.createDataFrame(rows, "x long, y long")
    # scaled so that each value is its own step of three bits
    ranges = [layout.Scale("x", 0.0, 8.0), layout.Scale("y", 0.0, 8.0)]
    got = {(r["x"], r["y"]): r["z"] for r in df.select("x", "y", layout.curve_position(df, ranges, 3).alias("z")).collect()}
    assert got == {(x, y): sum((x >> k & 1) << (2 * k + 1) | (y >> k & 1) << (2 * k) for k in range(3)) for x, y in rows}


def test_curve_of_nulls_single_values_and_odd_types(spark):
    df = spark.createDataFrame([(None, None, None, "a"), (dt.date(2020, 1, 1), 5.0, dt.datetime(2020, 1, 1), "b"), (dt.date(2021, 1, 1), float("nan"), None, "c")], "d date, v double, t timestamp, s string")
    places = [r[0] for r in df.select(layout.curve_position(df, layout.scales(df, ["d", "v", "t"])).alias("z")).collect()]
    assert places[0] == 0 and all(p is not None and p >= 0 for p in places)
    with pytest.raises(TypeError):
        layout.scales(df, ["s"])
    with pytest.raises(ValueError):
        layout.curve_position(df, layout.scales(df, ["d", "v"]), 40)
    assert layout.write_zordered(df.filter("false"), new_work_dir(spark, "z-none"), ["d"]).count() == 0
    assert layout.write_zordered(df, new_work_dir(spark, "z-few"), ["d", "v"], 2).count() == 3


def test_filters_on_either_column_skip_row_groups(spark, data):
    lines = read_table(spark, data.replace("0.001", "0.01"), "lineitem")
    path = new_work_dir(spark, "z-lines")
    stored = layout.write_zordered(lines, path, ["l_shipdate", "l_orderkey"], files=16, row_group_bytes=64 << 10)
    assert stored.count() == lines.count()
    by_date = stored.filter((F.col("l_shipdate") >= F.lit(dt.date(1994, 1, 1))) & (F.col("l_shipdate") < F.lit(dt.date(1995, 1, 1))))
    most = lines.agg(F.max("l_orderkey")).first()[0]
    by_key = stored.filter(F.col("l_orderkey").between(most // 2, most // 2 + most // 20))
    n = lines.count()
    # a seventh of the days, a twentieth of the keys
    assert scan_rows(by_date) < 0.35 * n and scan_rows(by_key) < 0.25 * n
    # a table in the order of its first column alone reads everything for the second
    assert scan_rows(lines.filter(F.col("l_shipdate") >= F.lit(dt.date(1994, 1, 1)))) == n
    want = tpch.forecast_revenue(lines).collect()
    assert tpch.forecast_revenue(stored).collect() == want


def test_a_hot_value_is_dealt_over_files(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(7 if k % 3 else rng.randrange(1000), k) for k in range(6000)], "x long, k long")
    path = new_work_dir(spark, "z-hot")
    sizes = layout.write_zordered(df, path, ["x"], files=8).groupBy(F.input_file_name()).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 2 * 6000 / 8
