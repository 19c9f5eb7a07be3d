"""Streaming results against batch results, late rows, readers and writers, the registry."""

import datetime as dt
import inspect

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plangauge import session
from plangauge.sources import logs
from plangauge.sources.standins import standin
from plangauge.streaming import jobs

STEP = "run_id string, episode_id long, step_index int, ts timestamp_ntz, new_ms double, reward double, error string, action string"
START = dt.datetime(2024, 1, 1)


def step(minute, episode=1, reward=1.0, error=None, index=0):
    return ("r", episode, index, START + dt.timedelta(minutes=minute), float(minute), reward, error, "push_filter")


def arrive(spark, folder, *files):
    for i, file in enumerate(files):
        spark.createDataFrame(list(file), STEP).coalesce(1).write.parquet(f"{folder}/in/f={i}")
    schema = spark.createDataFrame([], STEP).schema
    return jobs.read_stream(spark, f"{folder}/in/*", schema, files_per_batch=1)


def test_late_row_dropped_and_row_within_bound_kept(spark, tmp_path):
    folder = str(tmp_path)
    stream = arrive(spark, folder, [step(0), step(10)], [step(300)], [step(310)], [step(250), step(5)], [step(400)])
    jobs.start_versioned(jobs.penalty_windows(stream, delay="2 hours"), folder).awaitTermination()
    out = jobs.latest_versions(spark, folder, ["window_start", "window_end", "action"]).orderBy("window_start").collect()
    # minute 250 is within two hours of 300, minute 5 is not (a watermark counts from the batch after the next)
    assert [(r["window_start"].hour, r["attempts"]) for r in out] == [(0, 2), (4, 1), (5, 2), (6, 1)]


def test_live_totals_equal_batch(spark, tmp_path):
    folder = str(tmp_path)
    first = [step(0, 1), step(5, 1, error="syntax_error"), step(7, 2, 2.0)]
    stream = arrive(spark, folder, first, [step(20, 1, -3.0, "result_changed")], [step(1000, 3)], [step(2000, 4)])
    jobs.start_append(jobs.live_episode_totals(stream), folder).awaitTermination()
    out = spark.read.parquet(f"{folder}/data").orderBy("episode_id").collect()
    got = [(r["episode_id"], r["episode_length"], r["episode_total_reward"], r["final_execution_ms"], r["syntax_penalties"], r["result_penalties"]) for r in out]
    # the last episode may still grow
    assert got == [(1, 3, -1.0, 20.0, 1, 1), (2, 1, 2.0, 7.0, 0, 0), (3, 1, 1.0, 1000.0, 0, 0)]


def test_sliding_windows(spark, tmp_path):
    folder = str(tmp_path)
    stream = arrive(spark, folder, [step(61), step(70, error="syntax_error")])
    jobs.start_versioned(jobs.penalty_windows(stream, "1 hour", "15 minutes"), folder).awaitTermination()
    out = jobs.latest_versions(spark, folder, ["window_start", "window_end", "action"])
    assert sorted((r["attempts"], r["penalty_rate"]) for r in out.collect()) == [(2, 0.5)] * 4


def test_health_reports_per_batch(spark, data, tmp_path):
    folder = str(tmp_path)
    history = standin(spark, data, "history")
    history.repartitionByRange(3, "step").write.parquet(f"{folder}/in")
    stream = jobs.read_stream(spark, f"{folder}/in", history.schema, files_per_batch=1)
    jobs.start_health_checks(stream, folder).awaitTermination()
    assert spark.read.parquet(f"{folder}/reports").select("batch").distinct().count() == 3
    last = jobs.latest_report(spark, folder)
    assert rows(last.select(*jobs.health_report(history).columns), "run_id") == rows(jobs.health_report(history), "run_id")


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "log" / "episodes")
    assert logs.read_jsonl(spark, path, logs.EPISODES).count() == 0
    df = spark.createDataFrame([(1, "a", 1.5, 2.0, 0.5, 0, 1, None)], logs.EPISODES)
    for _ in range(2):
        logs.write_jsonl(df, path)
    assert rows(logs.read_jsonl(spark, path, logs.EPISODES)) == [(1, "a", 1.5, 2.0, 0.5, 0, 1, None)]
    (tmp_path / "hand.jsonl").write_text('{"episode": 1}\n\n   \n{"episode": 2}\n')
    assert logs.read_jsonl(spark, str(tmp_path / "hand.jsonl"), logs.EPISODES).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"episode": 1}\n{"episode": oops\n')
    with pytest.raises(Exception):
        logs.read_jsonl(spark, str(tmp_path / "bad.jsonl"), logs.EPISODES).collect()


def test_reports_replace_only_their_step(spark, tmp_path):
    def report(*records):
        logs.write_reports(spark.createDataFrame(list(records), "global_step long, overall string"), str(tmp_path / "r"))

    report((10, "FAIL"), (20, "FAIL"))
    report((20, "PASS"))
    out = spark.read.schema("overall string, global_step long").json(str(tmp_path / "r"))
    assert rows(out.select("global_step", "overall"), "global_step") == [(10, "FAIL"), (20, "PASS")]


def test_newest_run(spark):
    runs = spark.createDataFrame([("p", "a", "2024-01-02"), ("p", "b", None), ("q", "c", None)], "project string, run_id string, created_at string")
    assert rows(logs.newest_run(runs), "project") == [("p", "a", "2024-01-02"), ("q", "c", "")]


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_registry(spark, data):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(oracles) <= set(queries)
    assert all(len(inspect.signature(q).parameters) == 2 for q in queries.values())
    assert entry.entry(spark).columns == ["n_name", "revenue"]


@pytest.mark.parametrize("key", ["Q1_pricing_summary", "Q9_product_profit", "R4_early_aggregation_same_result", "P4_key_fields", "S3_reward", "M4_reward_inflection", "T16_truncated_prompt"])
def test_sample_of_queries_against_sql(spark, data, key):
    import duckdb

    from check import rows_of
    from plangauge.sources.standins import BASE_TABLES

    con = duckdb.connect()
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    result = con.execute(entry.oracle_sql()[key])
    columns = [c[0] for c in result.description]
    df = entry.queries()[key](spark, data)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
    assert F is not None


def test_the_last_of_steps_at_the_same_time(spark, tmp_path):
    folder = str(tmp_path)
    late = ("r", 1, 2, START + dt.timedelta(minutes=5), 77.0, 1.0, None, "push_filter")
    stream = arrive(spark, folder, [late, step(5, index=1), step(5, index=0)], [step(1000, 2)], [step(2000, 3)])
    jobs.start_append(jobs.live_episode_totals(stream), folder).awaitTermination()
    out = spark.read.parquet(f"{folder}/data").filter("episode_id = 1").first()
    assert (out["final_execution_ms"], out["episode_length"]) == (77.0, 3)


def test_history_under_tracker_names(spark, tmp_path):
    lines = [
        '{"run_id": "a", "_step": 1, "reward/mean": 0.5, "penalty/syntax_error": 1, "train/action": "no_op", "plan/seq_scans_removed": 2}',
        '{"run_id": "a", "step": 2, "reward_mean": 0.25, "env/reward": 4, "action": "x", "other": [1]}',
    ]
    (tmp_path / "history.jsonl").write_text("\n".join(lines))
    got = logs.read_history(spark, str(tmp_path), ["reward_mean", "env_reward", "syntax_error", "train_action", "action", "seq_scans_removed"])
    assert rows(got, "step") == [("a", 1, 0.5, None, 1.0, "no_op", None, 2.0), ("a", 2, 0.25, 4.0, None, None, "x", None)]
    first = logs.read_history(spark, str(tmp_path), ["reward_mean"], cap=1)
    assert rows(first) == [("a", 1, 0.5)]


def test_reports_of_a_step_are_one_file(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.range(60).selectExpr("CAST(id % 5 AS STRING) AS run_id", "id AS entries", "id % 12 AS global_step").repartition(3)
    logs.write_reports(rows, path)
    folders = [f for f in (tmp_path / "reports").iterdir() if f.is_dir()]
    assert len(folders) == 12 and all(len(list(f.glob("part-*"))) == 1 for f in folders)
    assert spark.read.schema("run_id STRING, entries BIGINT, global_step BIGINT").json(path).count() == 60
