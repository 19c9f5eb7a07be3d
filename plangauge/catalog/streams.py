"""Streaming jobs, run to the end over the given events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.catalog.series import ALERTS, FILLED, IMPROVED, INFLECTION, NOOP
from plangauge.session import new_work_dir
from plangauge.sources.standins import standin
from plangauge.streaming import jobs, running

CATALOG = Catalog()
Q = CATALOG.query


def _step_stream(spark, d) -> DataFrame:
    """The events as a stream of attempts: the derivation of the event log, plus reward and error per row."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # the stream watches the folder for files of this name
    events = jobs.read_stream(spark, d, schema, name_pattern="events.parquet")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    episode = F.floor(F.col("event_id") / 7).cast("long")
    run = F.when(episode % 3 == 0, F.lit("run-0")).otherwise(F.concat(F.lit("run-"), (1 + episode % 4).cast("string")))
    error = F.when(F.col("event_type") == "error", "syntax_error").when(F.col("event_type") == "signup", "result_changed")
    action = F.when(k % 2 == 0, "push_filter").otherwise("add_cte")
    return events.select(
        run.alias("run_id"),
        episode.alias("episode_id"),
        F.pmod("event_id", F.lit(7)).alias("step_index"),
        "ts",
        F.col("value").alias("new_ms"),
        ((F.col("value") - 20) / 100).cast("decimal(18,4)").alias("reward"),
        error.alias("error"),
        action.alias("action"),
    )


_STEPS = """WITH steps AS (SELECT run_id, episode_id, step_index, ts, value AS new_ms, CAST((value - 20) / 1e2 AS DECIMAL(18,4)) AS reward,
    CASE event_type WHEN 'error' THEN 'syntax_error' WHEN 'signup' THEN 'result_changed' END AS error,
    CASE WHEN k % 2 = 0 THEN 'push_filter' ELSE 'add_cte' END AS action FROM event_log)
    """


@Q(
    "ST1_live_episode_totals",
    ("event_log",),
    _STEPS
    + """, marked AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY run_id, episode_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM steps),
    numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY run_id, episode_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked),
    sessions AS (SELECT run_id, episode_id, COUNT(*) AS episode_length, CAST(SUM(reward) AS DOUBLE) AS episode_total_reward, last(new_ms ORDER BY ts, step_index) AS final_execution_ms,
      COUNT(*) FILTER (error = 'syntax_error') AS syntax_penalties, COUNT(*) FILTER (error = 'result_changed') AS result_penalties,
      MAX(ts) + INTERVAL 1 HOUR AS session_end FROM numbered GROUP BY run_id, episode_id, session)
    SELECT * EXCLUDE (session_end) FROM sessions WHERE session_end <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM steps)""",
)
def st1(spark, d):
    folder = new_work_dir(spark, "live-episodes")
    # finished sessions only: one that may still grow is not written yet
    jobs.start_append(jobs.live_episode_totals(_step_stream(spark, d)), folder).awaitTermination()
    rows = spark.read.parquet(f"{folder}/data")
    return plain(rows.drop("session_start", "session_end"))


@Q(
    "ST1_running_episode_totals",
    ("event_log",),
    _STEPS
    + """, marked AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY run_id, episode_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM steps),
    numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY run_id, episode_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM marked)
    SELECT run_id, episode_id, MIN(ts) AS session_start, COUNT(*) AS episode_length, CAST(SUM(reward) AS DOUBLE) AS episode_total_reward, last(new_ms ORDER BY ts, step_index) AS final_execution_ms,
      COUNT(*) FILTER (error = 'syntax_error') AS syntax_penalties, COUNT(*) FILTER (error = 'result_changed') AS result_penalties,
      MAX(ts) + INTERVAL 1 HOUR <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM steps) AS closed FROM numbered GROUP BY run_id, episode_id, session""",
)
def st1_running(spark, d):
    folder = new_work_dir(spark, "running-episodes")
    changes = running.running_episode_totals(_step_stream(spark, d))
    jobs.start_versioned(changes, folder, keys=running.KEYS).awaitTermination()
    rows = running.current(jobs.latest_versions(spark, folder, running.KEYS)).drop("session_end")
    return plain(rows.withColumn("session_start", F.col("session_start").cast("timestamp_ntz")))


@Q(
    "ST2_health_checks",
    ("history",),
    FILLED
    + INFLECTION
    + NOOP
    + IMPROVED
    + ALERTS
    + """SELECT h.run_id, h.global_step, i.inflection, i.pass AS inflection_pass, noop_rate, n.pass AS noop_pass, improvement_rate, g.pass AS improvement_pass,
    COALESCE(f.points >= 2 AND abs(last_v - first_v) / GREATEST(abs(first_v), 1e-9) <= 0.05, false) AS reward_flat, COALESCE(tampered, false) AS result_tampering,
    full_length >= 10 AS stuck FROM (SELECT run_id, MAX(step) AS global_step FROM history GROUP BY run_id) h
    LEFT JOIN inflections i ON i.run_id = h.run_id LEFT JOIN noop_check n ON n.run_id = h.run_id LEFT JOIN gain_check g ON g.run_id = h.run_id
    LEFT JOIN flat f ON f.run_id = h.run_id LEFT JOIN recent r ON r.run_id = h.run_id""",
)
def st2(spark, d):
    folder = new_work_dir(spark, "health")
    # the metric history arrives as files, two per micro-batch
    history = standin(spark, d, "history")
    history.repartitionByRange(4, "step").sortWithinPartitions("step").write.parquet(f"{folder}/arriving")
    stream = jobs.read_stream(spark, f"{folder}/arriving", history.schema, files_per_batch=2)
    jobs.start_health_checks(stream, folder).awaitTermination()
    return plain(jobs.latest_report(spark, folder))


def _windows_sql(slide: str, steps: int) -> str:
    starts = ", ".join(str(i) for i in range(steps))
    return f"""SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, action, COUNT(*) AS attempts, COUNT(error) AS penalties,
    ROUND(COUNT(error) / CAST(COUNT(*) AS DOUBLE), 6) AS penalty_rate
    FROM (SELECT *, time_bucket(INTERVAL '{slide}', ts, TIMESTAMP '2000-01-01') - INTERVAL '{slide}' * UNNEST([{starts}]) AS w FROM steps) x GROUP BY w, action"""


def _windows(spark, d, slide, name):
    folder = new_work_dir(spark, name)
    keys = ["window_start", "window_end", "action"]
    jobs.start_versioned(jobs.penalty_windows(_step_stream(spark, d), "1 hour", slide), folder, keys=keys).awaitTermination()
    rows = jobs.latest_versions(spark, folder, keys)
    return plain(
        rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn(
            "window_end", F.col("window_end").cast("timestamp_ntz")
        )
    )


@Q("ST3_penalty_windows_tumbling", ("event_log",), _STEPS + _windows_sql("1 hour", 1))
def st3_tumbling(spark, d):
    return _windows(spark, d, None, "tumbling")


@Q("ST3_penalty_windows_sliding", ("event_log",), _STEPS + _windows_sql("15 minutes", 4))
def st3_sliding(spark, d):
    return _windows(spark, d, "15 minutes", "sliding")
