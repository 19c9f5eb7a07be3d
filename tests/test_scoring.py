"""Replaying episodes from attempts; episodes, runs and benchmarks."""

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from plangauge.operators import benchmarks, episodes, scoring

ATTEMPT = (
    "run_id string, episode_id long, step_index int, action string, rewritten_query string, parse_ok boolean, timed_out boolean, "
    "exec_error string, new_ms double, new_hash string, node_type string, total_cost double, rows long, seq_scans int, nested_loops int, hash_joins int"
)
INITIAL = (
    "run_id string, episode_id long, task_level int, target_ms double, original_query string, execution_ms double, base_hash string, "
    "base_node_type string, base_total_cost double, base_rows long, base_seq_scans int, base_nested_loops int, base_hash_joins int"
)
PLAN = ("Seq Scan", 10000.0, 100000, 1, 0, 0)


def attempt(step, action="push_filter", query="SELECT 1", ok=True, late=False, error=None, ms=5000.0, hash="h", plan=PLAN, episode=1):
    return ("r", episode, step, action, query, ok, late, error, ms, hash, *plan)


def initial(spark, *episode_ids, target=10.0):
    data = [("r", e, 2, target, "SELECT 0", 5000.0, "h", *PLAN) for e in episode_ids or (1,)]
    return spark.createDataFrame(data, INITIAL)


def score(spark, *attempts, **options):
    df = scoring.score_attempts(spark.createDataFrame(list(attempts), ATTEMPT), initial(spark, **options))
    return df.orderBy("episode_id", "step_index").collect()


def test_outcome_ladder_in_order(spark):
    out = score(
        spark,
        attempt(0, action="explode", query="DROP TABLE x", ok=False, late=True, error="e", hash="x"),
        attempt(1, query="DROP TABLE x", late=True, error="e", hash="x"),
        attempt(2, late=True, error="e", hash="x"),
        attempt(3, error="e", hash="x"),
        attempt(4, hash="x"),
    )
    assert [(r["error"], r["reward"]) for r in out] == [
        ("invalid_action", -15.0), ("syntax_error", -15.0), ("timeout", -12.0), ("execution_error", -15.0), ("result_changed", -20.0),
    ]
    assert not any(r["done"] or r["accepted"] for r in out)


def test_rejected_steps_change_nothing(spark):
    out = score(spark, attempt(0, ms=4000.0), attempt(1, ms=1.0, hash="x"), attempt(2, ms=4000.0), attempt(3, query=""), attempt(4, ms=4000.0))
    assert [r["old_ms"] for r in out] == [5000.0, 4000.0, 4000.0, 4000.0, 4000.0]
    assert [r["step_count"] for r in out] == [1, 1, 2, 2, 3]
    # the second and third accepted steps are no-ops, judged at steps 1 and 2
    assert [r["breakdown"]["noop_penalty"] if r["breakdown"] else None for r in out] == [0.0, None, -4.0, None, -6.0]


def test_done_by_target_and_by_count(spark):
    out = score(spark, attempt(0, ms=4000.0), attempt(1, ms=10.0), attempt(2, ms=9.0))
    assert [(r["step_index"], r["done"]) for r in out] == [(0, False), (1, True)]
    out = score(spark, *[attempt(i) for i in range(9)])
    assert [r["done"] for r in out] == [False] * 4 + [True]


def test_best_query_and_revert(spark):
    out = score(
        spark,
        attempt(0, action="revert", ms=4500.0),
        attempt(1, query="SELECT 2", ms=3000.0),
        attempt(2, query="SELECT 3", ms=3000.0),
        attempt(3, action="revert", query="ignored DROP", ms=2000.0),
        attempt(4, action="revert", query="x", ms=9000.0),
    )
    assert [r["effective_query"] for r in out] == ["SELECT 0", "SELECT 2", "SELECT 3", "SELECT 2", "SELECT 2"]
    assert [r["best_ms"] for r in out] == [4500.0, 3000.0, 3000.0, 2000.0, 2000.0]
    history = scoring.with_history(scoring.score_attempts(spark.createDataFrame([attempt(0, query="SELECT 2"), attempt(1, hash="x"), attempt(2, query="SELECT 3")], ATTEMPT), initial(spark)))
    assert [r["previous_rewrites"] for r in history.orderBy("step_index").collect()] == [["SELECT 2"], ["SELECT 2"], ["SELECT 2", "SELECT 3"]]


def test_unreadable_plan_keeps_the_old_one(spark):
    out = score(spark, attempt(0, ms=4000.0, plan=("Sort", 5.0, 5, 0, 0, 0)), attempt(1, ms=3000.0, plan=(None,) * 6))
    assert out[1]["new_plan"]["node_type"] == "Sort" and out[1]["state_plan"]["seq_scans"] == 0


def test_one_shuffle_of_the_log(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = spark.createDataFrame([attempt(0)], ATTEMPT)
        rows = scoring.with_history(scoring.score_attempts(log, initial(spark)))
        text = plan_of(episodes.episode_metrics(rows, initial(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 * 1024 * 1024))
    # one for the log, one for each reading of the initial observations
    assert text.count("\n(") and text.split("== Physical Plan ==")[1].split("\n\n\n")[0].count("Exchange") == 3
    assert "EvalPython" not in text


def test_episode_metrics(spark):
    log = spark.createDataFrame(
        [attempt(0, ms=4000.0, plan=("Sort", 1.0, 1, 0, 0, 0)), attempt(1, hash="x"), attempt(2, query="DROP x"), attempt(3, ms=2500.0, plan=("Sort", 1.0, 1, 0, 0, 0))],
        ATTEMPT,
    )
    start = initial(spark, 1, 2)
    out = {r["episode_id"]: r for r in episodes.episode_metrics(scoring.score_attempts(log, start), start).collect()}
    one, none = out[1], out[2]
    assert (one["result_changed"], one["syntax_errors"], one["seq_scans_removed"], one["episode_length"], one["task_level"]) == (1, 1, 1, 4, 2)
    assert one["speedup_ratio"] == pytest.approx(0.5) and one["final_execution_ms"] == 2500.0
    assert one["mean_step_reward"] == pytest.approx(one["episode_total_reward"] / 4)
    assert (none["mean_step_reward"], none["speedup_ratio"], none["episode_length"], none["task_level"], none["final_execution_ms"]) == (0.0, 0.0, 0, 2, 5000.0)


EPISODE = "run_id string, episode long, label string, episode_total_reward double, final_execution_ms double, speedup_ratio double, syntax_penalties int, result_penalties int"


def test_run_summary_and_comparison(spark):
    log = spark.createDataFrame(
        [("a", 1, "late", 4.0, 10.0, 0.5, 1, 0), ("a", 0, "first", 2.0, 20.0, 0.0, 0, 0), ("b", 0, "t", 6.0, 5.0, 1.0, 0, 2)], EPISODE
    )
    out = {r["run_id"]: r for r in episodes.summarize_runs(log, ["run_id"]).collect()}
    assert (out["a"]["label"], out["a"]["mean_episode_reward"], out["a"]["episodes"]) == ("first", 3.0, 2)
    empty = episodes.summarize_runs(log.filter("false")).first()
    assert (empty["label"], empty["mean_execution_ms"], empty["episodes"]) == ("empty", 0.0, 0)
    table = {r["metric"]: r for r in episodes.compare_runs(episodes.summarize_runs(log, ["run_id"]), F.col("run_id"), "a", "b").collect()}
    assert table["mean_episode_reward"]["percent_change"] == pytest.approx(100.0)
    assert table["mean_result_changed_penalties"]["percent_change"] is None
    running = {(r["run_id"], r["episode"]): r["running_mean"] for r in episodes.running_mean_reward(log.select("run_id", "episode", "episode_total_reward"), span=1).collect()}
    assert running == {("a", 0): 2.0, ("a", 1): 3.0, ("b", 0): 6.0}


def test_task_assignment(spark):
    tasks = [("Q1", 1), ("Q6", 1), ("Q3", 2)]
    resets = spark.range(600).select(F.lit("r").alias("run_id"), F.col("id").alias("reset_index"), F.col("id").alias("seed"))
    out = episodes.assign_tasks(resets, tasks, first=100)
    assert out.filter("reset_index < 100").agg(F.max("task_level")).first()[0] == 1
    late = {r["task_level"]: r["count"] for r in out.filter("reset_index >= 100").groupBy("task_level").count().collect()}
    assert set(late) == {1, 2, 3} and min(late.values()) > 100
    # no task has level 3, so any task may be drawn there
    assert out.filter("task_level = 3").select("task_id").distinct().count() == 3
    assert out.filter("task_level = 2").select("task_id").distinct().collect()[0][0] == "Q3"
    assert {r[0] for r in episodes.assign_tasks(resets, tasks, gating=False).select("task_level").distinct().collect()} == {1}
    levels = episodes.tasks_for_levels(spark.createDataFrame(tasks, "task_id string, level int"), 1)
    assert levels.count() == 2


def bench(spark, *records):
    return spark.createDataFrame(list(records), "query_id string, baseline_ms double, untrained_ms double, trained_ms double, hash_match_untrained boolean, hash_match_trained boolean").withColumn(
        "speedup", benchmarks.speedup(F.col("untrained_ms"), F.col("trained_ms"))
    )


def test_benchmark_rules(spark):
    rows = bench(
        spark,
        ("Q1", 100.0, 90.0, 45.0, True, True),
        ("Q3", 100.0, 90.0, 30.0, True, False),
        ("Q5", 900.0, 900.0, 300.0, True, True),
        ("Q6", 10.0, None, 5.0, False, True),
        ("Q14", 10.0, 30.0, 10.0, True, True),
    )
    v = benchmarks.benchmark_verdict(rows).first()
    assert (v["count_passing"], v["passed"]) == (3, True) and v["avg_speedup"] == pytest.approx((2 + 3 + 3 + 3) / 4)
    best = benchmarks.best_speedup(rows).first()
    assert (best["query_id"], best["best_speedup"], best["summary"]) == ("Q14", 3.0, "3.0x on Q14")
    nothing = benchmarks.best_speedup(rows.filter("query_id = 'Q6'")).first()
    assert (nothing["summary"], nothing["best_speedup"]) == ("", 0.0)
    gate = {r["query_id"]: r for r in benchmarks.single_query_gate(rows).collect()}
    assert (gate["Q5"]["pass"], gate["Q5"]["meets_target"], gate["Q5"]["meets_stretch"], gate["Q5"]["speedup"]) == (True, True, True, 3.0)
    assert gate["Q3"]["pass"] is False


def test_level_success_ignores_nan(spark):
    h = spark.createDataFrame([(1.0, 0.5), (1.0, float("nan")), (1.0, None), (1.0, -1.0), (2.0, 5.0)], "task_level double, reward_mean double")
    out = episodes.level_success(h).first()
    assert (out["success_rate"], out["entries"], out["gating"]) == (0.25, 4, True)
    top = episodes.highest_reward(h).first()
    assert (top["max_reward_seen"], top["episodes_logged"], top["ok"]) == (5.0, 5, True)


def test_benchmark_reads_the_timings_twice(spark, tmp_path):
    data = [("q", v, float(i), "h" if v != "trained" else "x") for v in ("baseline", "untrained", "trained") for i in range(9)]
    data += [("nulls", "trained", 1.0, None), ("other", "trained", None, "h")]
    timings = spark.createDataFrame(data, "query_id string, variant string, ms double, result_hash string")
    base = spark.createDataFrame([("q", "h"), ("nulls", None)], "query_id string, base_hash string")
    out = {r["query_id"]: r for r in benchmarks.benchmark(timings, base).collect()}
    q = out["q"]
    assert (q["baseline_ms"], q["trained_ms"], q["hash_match_untrained"], q["hash_match_trained"]) == (4.0, 4.0, True, False)
    assert out["nulls"]["hash_match_trained"] is True  # no hash anywhere agrees with no baseline hash
    assert (out["other"]["trained_ms"], out["other"]["hash_match_trained"]) == (None, False)
    timings.write.parquet(f"{tmp_path}/timings")
    stored = benchmarks.benchmark(spark.read.parquet(f"{tmp_path}/timings"), base)
    stored.collect()
    # rounds of the medians read the counts that are there already, which shows in the plan as it ran
    final = plan_of(stored).split("== Initial Plan ==")[0]
    assert final.count("Scan parquet") == 2 and "ReusedExchange" in final
