"""Timing-log and run-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.operators import benchmarks, episodes
from plangauge.sources.standins import standin

CATALOG = Catalog()
Q = CATALOG.query
T = ("timings", "timing_baselines")

ROWS = """WITH medians AS (SELECT query_id, variant, median(ms) AS median_ms, COUNT(ms) AS repetitions FROM timings GROUP BY query_id, variant),
    same AS (SELECT t.query_id, variant, bool_and(result_hash IS NOT DISTINCT FROM base_hash) AS hash_match
      FROM timings t JOIN timing_baselines b ON t.query_id = b.query_id GROUP BY t.query_id, variant),
    bench AS (SELECT m.query_id, MAX(median_ms) FILTER (m.variant = 'baseline') AS baseline_ms,
      MAX(median_ms) FILTER (m.variant = 'untrained') AS untrained_ms, MAX(median_ms) FILTER (m.variant = 'trained') AS trained_ms,
      COALESCE(bool_or(hash_match) FILTER (m.variant = 'untrained'), false) AS hash_match_untrained,
      COALESCE(bool_or(hash_match) FILTER (m.variant = 'trained'), false) AS hash_match_trained
      FROM medians m LEFT JOIN same s ON m.query_id = s.query_id AND m.variant = s.variant GROUP BY m.query_id),
    rated AS (SELECT *, CASE WHEN trained_ms > 0 THEN untrained_ms / GREATEST(trained_ms, 1e-6) END AS speedup FROM bench)
    """


def _bench(spark, d):
    return benchmarks.benchmark(standin(spark, d, "timings"), standin(spark, d, "timing_baselines"))


@Q("E6_median_timings", T, ROWS + "SELECT query_id, variant, ROUND(median_ms, 6) AS median_ms, repetitions FROM medians")
def e6(spark, d):
    return plain(benchmarks.median_timings(standin(spark, d, "timings")))


@Q(
    "E7_speedups",
    T,
    ROWS
    + """SELECT query_id, ROUND(baseline_ms, 6) AS baseline_ms, ROUND(untrained_ms, 6) AS untrained_ms, ROUND(trained_ms, 6) AS trained_ms,
    hash_match_untrained, hash_match_trained, ROUND(speedup, 6) AS speedup FROM rated""",
)
def e7(spark, d):
    return plain(_bench(spark, d))


@Q(
    "E8_benchmark_verdict",
    T,
    ROWS
    + """SELECT ROUND(COALESCE(AVG(CASE WHEN speedup > 0 THEN speedup END), 0e0), 4) AS avg_speedup,
    COUNT(*) FILTER (speedup >= 2 AND untrained_ms > 0 AND hash_match_untrained AND hash_match_trained) AS count_passing, COUNT(*) AS queries,
    COUNT(*) FILTER (speedup >= 2 AND untrained_ms > 0 AND hash_match_untrained AND hash_match_trained) >= 3 AS passed FROM rated""",
)
def e8(spark, d):
    return plain(benchmarks.benchmark_verdict(_bench(spark, d)), 4)


@Q(
    "E9_best_speedup",
    T,
    ROWS
    + "SELECT ROUND(speedup, 6) AS best_speedup, query_id FROM rated WHERE speedup > 0 ORDER BY speedup DESC, query_id LIMIT 1",
)
def e9(spark, d):
    return plain(benchmarks.best_speedup(_bench(spark, d)).drop("summary"))


@Q(
    "E10_single_query_gate",
    T,
    ROWS
    + """SELECT query_id, ROUND(baseline_ms, 6) AS original_ms, ROUND(trained_ms, 6) AS rewritten_ms,
    CASE WHEN trained_ms > 0 THEN ROUND(baseline_ms / trained_ms, 6) ELSE 0e0 END AS speedup, hash_match_trained AS hash_verified,
    COALESCE(hash_match_trained AND trained_ms <= 1000, false) AS pass, COALESCE(hash_match_trained AND trained_ms <= 500, false) AS meets_target,
    COALESCE(hash_match_trained AND trained_ms <= 310, false) AS meets_stretch FROM bench""",
)
def e10(spark, d):
    return plain(benchmarks.single_query_gate(_bench(spark, d)))


CTE_SQL = r"(regexp_matches(upper(text), '\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s*\(') OR regexp_matches(upper(text), '\bWITH\s+[A-Z0-9_`\"\[\].]+\s+AS\s+MATERIALIZED'))"


@Q(
    "E11_cte_share",
    ("completions",),
    f"""SELECT ROUND(AVG(CASE WHEN {CTE_SQL} THEN 1 ELSE 0 END), 6) AS cte_rate, COUNT(*) AS samples_checked,
    AVG(CASE WHEN {CTE_SQL} THEN 1 ELSE 0 END) >= 0.4 AS pass FROM completions""",
)
def e11(spark, d):
    return plain(episodes.cte_share(standin(spark, d, "completions")))


@Q(
    "E12_level_success",
    ("history",),
    """SELECT run_id, ROUND(AVG(CASE WHEN reward_mean > 0 AND NOT isnan(reward_mean) THEN 1 ELSE 0 END), 6) AS success_rate, COUNT(*) AS entries,
    AVG(CASE WHEN reward_mean > 0 AND NOT isnan(reward_mean) THEN 1 ELSE 0 END) < 0.3 AS gating FROM history WHERE task_level = 1 GROUP BY run_id""",
)
def e12(spark, d):
    return plain(episodes.level_success(standin(spark, d, "history"), ["run_id"]))


@Q(
    "E13_highest_reward",
    ("history",),
    """SELECT ROUND(GREATEST(0e0, MAX(CASE WHEN NOT isnan(reward_mean) THEN reward_mean END), MAX(env_reward)), 6) AS max_reward_seen,
    COUNT(*) AS episodes_logged, GREATEST(0e0, MAX(CASE WHEN NOT isnan(reward_mean) THEN reward_mean END), MAX(env_reward)) > 0.5 AS ok FROM history""",
)
def e13(spark, d):
    return plain(episodes.highest_reward(standin(spark, d, "history")))


# The ten tasks and their levels.
TASKS = [("Q1", 1), ("Q6", 1), ("Q14", 1), ("Q3", 2), ("Q5", 2), ("Q10", 2), ("Q12", 2), ("Q2", 3), ("Q9", 3), ("Q17", 3)]


def _draw(purpose: str) -> str:
    return f"('0x' || substr(md5(CAST(event_id AS VARCHAR) || ':{purpose}'), 1, 8))::BIGINT"


_CHOICES = " ".join(f"WHEN {level} THEN {[task for task, of in TASKS if of == level]}" for level in (1, 2, 3))


@Q(
    "E15_task_assignment",
    ("event_log",),
    f"""WITH numbered AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS rn FROM event_log),
    leveled AS (SELECT run_id, event_id, CASE WHEN rn <= 200 THEN 1 ELSE {_draw("level")} % 3 + 1 END AS task_level FROM numbered),
    chosen AS (SELECT *, CASE task_level {_CHOICES} END AS choices FROM leveled)
    SELECT run_id, event_id AS reset_index, task_level, choices[{_draw("task")} % len(choices) + 1] AS task_id FROM chosen""",
)
def e15(spark, d):
    log = standin(spark, d, "event_log").select("run_id", F.col("event_id").alias("reset_index"), F.col("event_id").alias("seed"))
    return plain(episodes.assign_tasks(log, TASKS).drop("seed"))
