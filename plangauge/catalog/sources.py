"""Reading and writing, over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.catalog.benchmarks import ROWS
from plangauge.operators import benchmarks
from plangauge.session import new_work_dir
from plangauge.sources import layout, logs
from plangauge.sources.standins import standin
from plangauge.sources.tables import TABLE_ROWS, read_table, register_views, table_rows

CATALOG = Catalog()
Q = CATALOG.query
TABLES = [t for t in TABLE_ROWS if t != "partsupp"]


@Q(
    "IO1_base_tables",
    (),
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count, {n}::BIGINT AS nominal_rows FROM {t}" for t, n in TABLE_ROWS.items() if t != "partsupp"),
)
def io1(spark, d):
    register_views(spark, d, TABLES)
    counts = [spark.table(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("row_count")) for t in TABLES]
    nominal = table_rows(spark).withColumnRenamed("row_count", "nominal_rows")
    return reduce(lambda a, b: a.unionByName(b), counts).join(nominal, "table_name")


@Q(
    "IO1_colocated_join",
    (),
    "SELECT o_orderpriority, COUNT(*) AS lines, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority",
)
def io1_colocated(spark, d):
    """Orders and lines stored by order key: the join reads both as they lie."""
    stored = {}
    for name, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        path = new_work_dir(spark, f"colocated-{name}")
        stored[name] = layout.write_colocated(read_table(spark, d, name), f"colocated_{path.rsplit('-', 1)[1]}", key, 16, path)
    joined = stored["orders"].join(stored["lineitem"].hint("merge"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("long").alias("quantity"))


@Q(
    "IO1_zordered_scan",
    (),
    """SELECT COUNT(*) AS lines, MIN(l_orderkey) AS least, MAX(l_orderkey) AS most, CAST(SUM(l_quantity) AS BIGINT) AS quantity FROM lineitem
    WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_orderkey > (SELECT MAX(l_orderkey) FROM lineitem) / 2""",
)
def io1_zordered(spark, d):
    """Lines stored along a curve of day and order key: a filter on both skips row groups by both."""
    lines = layout.write_zordered(read_table(spark, d, "lineitem"), new_work_dir(spark, "zordered-lineitem"), ["l_shipdate", "l_orderkey"], row_group_bytes=4 << 20)
    half = lines.agg(F.max("l_orderkey")).first()[0] / 2
    some = lines.filter((F.col("l_shipdate") >= F.lit("1994-01-01").cast("date")) & (F.col("l_shipdate") < F.lit("1995-01-01").cast("date")) & (F.col("l_orderkey") > half))
    return some.agg(F.count("*").alias("lines"), F.min("l_orderkey").alias("least"), F.max("l_orderkey").alias("most"), F.sum("l_quantity").cast("long").alias("quantity"))


_ROUND_TRIP = """SELECT run_id, COUNT(*) AS entries, COUNT(reward_mean) - COUNT(*) FILTER (isnan(reward_mean)) AS rewards, MAX(step) AS last_step,
    ROUND(SUM(speedup_ratio), 4) AS speedups FROM history GROUP BY run_id"""


def _by_run(history):
    reward = F.nanvl("reward_mean", F.lit(None).cast("double"))
    return plain(
        history.groupBy("run_id").agg(
            F.count("*").alias("entries"), F.count(reward).alias("rewards"), F.max("step").alias("last_step"), F.sum("speedup_ratio").alias("speedups")
        ),
        4,
    )


@Q("IO2_read_jsonl", ("history",), _ROUND_TRIP)
def io2(spark, d):
    path = new_work_dir(spark, "jsonl")
    logs.write_jsonl(standin(spark, d, "history"), path)
    return _by_run(logs.read_jsonl(spark, path, logs.HISTORY))


@Q(
    "IO3_write_jsonl",
    (),
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, printf('%.2f', o_totalprice) AS o_totalprice FROM orders",
)
def io3(spark, d):
    path = new_work_dir(spark, "orders-jsonl")
    typed = spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), F.col("o_totalprice").cast("decimal(15,2)").alias("o_totalprice")
    )
    logs.write_jsonl(typed, path)  # dates and decimals are written as text
    return spark.read.schema("o_orderkey BIGINT, o_orderdate STRING, o_totalprice STRING").json(path)


@Q(
    "IO4_read_history",
    ("history",),
    "SELECT run_id, step, episode_length FROM history",
)
def io4(spark, d):
    path = new_work_dir(spark, "history")
    standin(spark, d, "history").write.parquet(path)
    return plain(logs.read_history(spark, path, ["episode_length"], fmt="parquet"))


@Q(
    "IO4_read_tracked_history",
    ("history",),
    """SELECT run_id, step, speedup_ratio, result_changed, syntax_error, seq_scans_removed, episode_length, action AS train_action, CAST(rewrite_unchanged AS BIGINT) AS rewrite_unchanged
    FROM history""",
)
def io4_tracked(spark, d):
    path = new_work_dir(spark, "tracked-history")
    history = standin(spark, d, "history").withColumn("train_action", F.col("action")).drop("action")
    logs.write_jsonl(history.withColumnsRenamed(logs.TRACKED), path)
    wanted = ["speedup_ratio", "result_changed", "syntax_error", "seq_scans_removed", "episode_length", "train_action", "rewrite_unchanged"]
    return plain(logs.read_history(spark, path, wanted))


@Q(
    "IO5_benchmark_payload",
    ("timings", "timing_baselines"),
    ROWS
    + """SELECT query_id, ROUND(baseline_ms, 6) AS baseline_ms, ROUND(trained_ms, 6) AS trained_ms, hash_match_trained FROM rated
    UNION ALL SELECT 'summary', NULL, ROUND(COALESCE(AVG(CASE WHEN speedup > 0 THEN speedup END), 0e0), 4), COUNT(*) FILTER (speedup >= 2 AND untrained_ms > 0 AND hash_match_untrained AND hash_match_trained) >= 3 FROM rated""",
)
def io5(spark, d):
    path = new_work_dir(spark, "benchmark")
    rows = benchmarks.benchmark(standin(spark, d, "timings"), standin(spark, d, "timing_baselines"))
    logs.write_benchmark(rows, benchmarks.benchmark_verdict, path)
    queries = spark.read.schema(rows.schema).json(f"{path}/queries").select("query_id", "baseline_ms", "trained_ms", "hash_match_trained")
    summary = spark.read.schema("avg_speedup DOUBLE, passed BOOLEAN").json(f"{path}/summary")
    last = summary.select(
        F.lit("summary").alias("query_id"), F.lit(None).cast("double").alias("baseline_ms"), F.round("avg_speedup", 4).alias("trained_ms"), F.col("passed").alias("hash_match_trained")
    )
    return plain(queries.unionByName(last))


@Q(
    "IO6_verification_reports",
    ("history",),
    "SELECT CAST(FLOOR(step / 1000) AS BIGINT) AS global_step, run_id, COUNT(*) AS entries, ROUND(AVG(speedup_ratio), 6) AS mean_speedup FROM history GROUP BY 1, 2",
)
def io6(spark, d):
    path = new_work_dir(spark, "reports")
    reports = (
        standin(spark, d, "history")
        .groupBy(F.floor(F.col("step") / 1000).cast("long").alias("global_step"), "run_id")
        .agg(F.count("*").alias("entries"), F.round(F.avg("speedup_ratio"), 6).alias("mean_speedup"))
    )
    logs.write_reports(reports, path)
    return spark.read.schema("run_id STRING, entries BIGINT, mean_speedup DOUBLE, global_step BIGINT").json(path)


_RUNS = "SELECT event_type AS project, run_id || '-' || CAST(event_id AS STRING) AS run_id, CASE WHEN k % 5 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END AS created_at FROM event_log"


@Q(
    "IO7_newest_run",
    ("event_log",),
    f"""WITH runs AS ({_RUNS}) SELECT project, run_id, created_at FROM (SELECT project, run_id, COALESCE(created_at, '') AS created_at,
    row_number() OVER (PARTITION BY project ORDER BY COALESCE(created_at, '') DESC, run_id DESC) AS rn FROM runs) x WHERE rn = 1""",
)
def io7(spark, d):
    log = standin(spark, d, "event_log")
    runs = log.select(
        F.col("event_type").alias("project"),
        F.concat_ws("-", "run_id", F.col("event_id").cast("string")).alias("run_id"),
        F.when(F.col("k") % 5 != 0, F.col("ts").cast("date").cast("string")).alias("created_at"),
    )
    return logs.newest_run(runs)
