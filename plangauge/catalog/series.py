"""Metric-history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.catalog.benchmarks import CTE_SQL
from plangauge.operators import benchmarks, episodes, series
from plangauge.sources.standins import standin

CATALOG = Catalog()
Q = CATALOG.query
H = ("history",)


def _history(spark, d):
    return standin(spark, d, "history")


_CLEAN = "CASE WHEN isnan({c}) THEN NULL ELSE {c} END"
FILLED = """WITH filled AS (SELECT run_id, step, COALESCE(CASE WHEN isnan(reward_mean) THEN NULL ELSE reward_mean END, 0e0) AS reward_mean,
      speedup_ratio, result_changed, syntax_error, COALESCE(seq_scans_removed, 0e0) AS seq_scans_removed,
      COALESCE(episode_length, 4e0) AS episode_length, COALESCE(task_level, 1e0) AS task_level,
      row_number() OVER (PARTITION BY run_id ORDER BY step) AS pos, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back,
      COUNT(*) OVER (PARTITION BY run_id) AS n FROM history),
    rewards AS (SELECT run_id, step, COALESCE(reward_mean, env_reward) AS reward,
      row_number() OVER (PARTITION BY run_id ORDER BY step) AS pos, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back
      FROM history WHERE COALESCE(reward_mean, env_reward) IS NOT NULL AND NOT isnan(COALESCE(reward_mean, env_reward))),
    tail AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS back FROM history)
    """


def _rolling(column: str, width: int) -> str:
    return f"AVG({column}) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW)"


@Q(
    "M1_rolling_mean_full",
    H,
    FILLED + f"SELECT run_id, step, ROUND(m, 6) AS reward_mean_10 FROM (SELECT run_id, step, pos, {_rolling('reward', 10)} AS m FROM rewards) x WHERE pos >= 10",
)
def m1(spark, d):
    rows = series.rolling_mean(series.reward_series(_history(spark, d)), ["reward"], 10, full_only=True)
    return plain(rows.select("run_id", "step", F.col("reward_mean").alias("reward_mean_10")))


@Q(
    "M2_rolling_mean_partial",
    H,
    FILLED
    + f"""SELECT run_id, step, ROUND({_rolling('reward_mean', 20)}, 9) AS reward_20, ROUND({_rolling('result_changed', 20)}, 9) AS changed_20
    FROM filled""",
)
def m2(spark, d):
    rows = series.rolling_mean(series.filled(_history(spark, d)), ["reward_mean", "result_changed"], 20)
    return plain(rows.select("run_id", "step", F.col("reward_mean_mean").alias("reward_20"), F.col("result_changed_mean").alias("changed_20")), 9)


@Q("M3_reward_series", H, FILLED + "SELECT run_id, step, ROUND(reward, 6) AS reward FROM rewards")
def m3(spark, d):
    return plain(series.reward_series(_history(spark, d)))


INFLECTION = f""", rolled AS (SELECT run_id, pos, pos - 10 AS idx, {_rolling('reward', 10)} AS roll FROM rewards),
    pairs AS (SELECT *, LAG(roll) OVER (PARTITION BY run_id ORDER BY idx) AS prev FROM rolled WHERE pos >= 10),
    hits AS (SELECT run_id, MIN(idx) AS inflection, arg_min(prev, idx) AS before, arg_min(roll, idx) AS after FROM pairs
      WHERE idx BETWEEN 1 AND 499 AND prev > 0 AND roll > 1.1e0 * prev GROUP BY run_id),
    ends AS (SELECT run_id, COUNT(*) AS points, arg_max(reward, step) AS last_reward FROM rewards GROUP BY run_id),
    edges AS (SELECT run_id, arg_min(roll, idx) AS first_roll, arg_max(roll, idx) AS last_roll FROM pairs GROUP BY run_id),
    inflections AS (SELECT e.run_id, points, CASE WHEN points >= 20 THEN inflection END AS inflection,
      CASE WHEN points >= 20 THEN COALESCE(ROUND(before, 4), first_roll) END AS reward_before,
      CASE WHEN points >= 20 THEN COALESCE(ROUND(after, 4), last_roll) END AS reward_after,
      CASE WHEN points >= 20 AND inflection IS NOT NULL THEN ROUND(last_reward, 4) END AS reward_at_end,
      COALESCE(points >= 20 AND inflection < 100, false) AS pass, false AS skipped
      FROM ends e LEFT JOIN hits h ON e.run_id = h.run_id LEFT JOIN edges g ON e.run_id = g.run_id)
    """
NOOP = """, noops AS (SELECT run_id, COUNT(*) FILTER (rewrite_unchanged = 1 OR COALESCE(noop = 1, false)
        OR lower(trim(action)) IN ('no_op', 'noop', 'no-op', 'identity')) AS bad, GREATEST(3, LEAST(COUNT(*), 50)) AS w FROM tail WHERE back <= 50 GROUP BY run_id),
    noop_check AS (SELECT run_id, ROUND(bad / CAST(w AS DOUBLE), 4) AS noop_rate, bad / CAST(w AS DOUBLE) <= 0.1 AS pass, false AS skipped FROM noops)
    """
IMPROVED = """, gains AS (SELECT run_id, COUNT(*) FILTER (seq_scans_removed > 0) AS good, COUNT(seq_scans_removed) AS seen,
      GREATEST(3, LEAST(COUNT(*), 50)) AS w FROM tail WHERE back <= 50 GROUP BY run_id),
    gain_check AS (SELECT run_id, CASE WHEN seen > 0 THEN ROUND(good / CAST(w AS DOUBLE), 4) END AS improvement_rate,
      CASE WHEN seen > 0 THEN good / CAST(w AS DOUBLE) >= 0.3 END AS pass, seen = 0 AS skipped FROM gains)
    """


@Q(
    "M4_reward_inflection",
    H,
    FILLED
    + INFLECTION
    + """SELECT run_id, points, inflection, ROUND(reward_before, 6) AS reward_before, ROUND(reward_after, 6) AS reward_after,
    ROUND(reward_at_end, 6) AS reward_at_end, pass, skipped FROM inflections""",
)
def m4(spark, d):
    return plain(series.reward_inflection(_history(spark, d)))


@Q("M5_noop_rate", H, FILLED + NOOP + "SELECT * FROM noop_check")
def m5(spark, d):
    return plain(series.noop_rate(_history(spark, d)))


@Q("M6_improvement_rate", H, FILLED + IMPROVED + "SELECT * FROM gain_check")
def m6(spark, d):
    return plain(series.improvement_rate(_history(spark, d)))


_METRICS = list(series.REPORT_METRICS)
_LOWER = ", ".join(f"'{m}'" for m, low in series.REPORT_METRICS.items() if low)
REPORT = """, long AS (
    {selects}),
    valid AS (SELECT run_id, metric, value, row_number() OVER (PARTITION BY run_id, metric ORDER BY place) AS lo,
      row_number() OVER (PARTITION BY run_id, metric ORDER BY place DESC) AS hi, COUNT(*) OVER (PARTITION BY run_id, metric) AS n
      FROM long WHERE value IS NOT NULL),
    moves AS (SELECT run_id, metric, MAX(n) AS n, AVG(value) FILTER (hi <= CASE WHEN n >= 3 THEN 3 ELSE 1 END)
      - AVG(value) FILTER (lo <= CASE WHEN n >= 3 THEN 3 ELSE 1 END) AS delta FROM valid GROUP BY run_id, metric),
    wide AS (SELECT run_id, metric, {places} FROM long GROUP BY run_id, metric),
    report AS (SELECT w.*, CASE WHEN n IS NULL OR n < 2 THEN 'n/a' WHEN abs(delta) < 1e-9 THEN 'flat'
      WHEN w.metric IN ({lower}) AND delta < 0 THEN 'improving' WHEN w.metric NOT IN ({lower}) AND delta > 0 THEN 'improving' ELSE 'worse' END AS trend
      FROM wide w LEFT JOIN moves m ON w.run_id = m.run_id AND w.metric = m.metric)
    """.format(
    selects="\n    UNION ALL ".join(
        f"SELECT run_id, '{m}' AS metric, {_CLEAN.format(c=m)} AS value, (COUNT(*) OVER (PARTITION BY run_id)) - back AS place FROM tail WHERE back <= 10"
        for m in _METRICS
    ),
    places=", ".join(f"MAX(value) FILTER (place = {i}) AS e{i}" for i in range(10)),
    lower=_LOWER,
)


@Q("M7_trend", H, FILLED + REPORT + "SELECT run_id, metric, trend FROM report")
def m7(spark, d):
    return series.last_rows_report(_history(spark, d)).select("run_id", "metric", "trend")


@Q(
    "M8_last_rows_report",
    H,
    FILLED + REPORT + "SELECT run_id, metric, " + ", ".join(f"CASE WHEN ROUND(e{i}, 6) = 0 THEN 0e0 ELSE ROUND(e{i}, 6) END AS e{i}" for i in range(10)) + ", trend FROM report",
)
def m8(spark, d):
    return plain(series.last_rows_report(_history(spark, d)))


ALERTS = """, usable AS (SELECT run_id, CASE WHEN isnan(reward_mean) THEN NULL ELSE reward_mean END AS v, back FROM tail WHERE back <= 20),
    flat AS (SELECT run_id, COUNT(v) AS points, arg_max(v, back) FILTER (v IS NOT NULL) AS first_v, arg_min(v, back) FILTER (v IS NOT NULL) AS last_v
      FROM usable GROUP BY run_id),
    recent AS (SELECT run_id, bool_or(result_changed > 0.1) AS tampered, COUNT(*) FILTER (round_even(episode_length, 0) = 5) AS full_length
      FROM tail WHERE back <= 10 GROUP BY run_id)
    """


@Q(
    "M9_alert_flat",
    H,
    FILLED + ALERTS + "SELECT run_id, COALESCE(points >= 2 AND abs(last_v - first_v) / GREATEST(abs(first_v), 1e-9) <= 0.05, false) AS reward_flat FROM flat",
)
def m9(spark, d):
    return series.alerts(_history(spark, d)).select("run_id", "reward_flat")


@Q("M10_alert_tampering", H, FILLED + ALERTS + "SELECT run_id, COALESCE(tampered, false) AS result_tampering FROM recent")
def m10(spark, d):
    return series.alerts(_history(spark, d)).select("run_id", "result_tampering")


@Q("M11_alert_stuck", H, FILLED + ALERTS + "SELECT run_id, full_length >= 10 AS stuck FROM recent")
def m11(spark, d):
    return series.alerts(_history(spark, d)).select("run_id", "stuck")


_LENGTH = 3000


def _padded(column: str, repeat: bool) -> str:
    if repeat:
        over = "OVER (PARTITION BY run_id ORDER BY episode ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        return f"ROUND(last_value({column} IGNORE NULLS) {over}, 6) AS {column}"
    return f"ROUND(COALESCE({column}, 0e0), 6) AS {column}"


@Q(
    "M12_aligned_series",
    H,
    FILLED
    + f""", grid AS (SELECT run_id, UNNEST(range(0, {_LENGTH})) AS episode FROM (SELECT DISTINCT run_id FROM history) r),
    joined AS (SELECT g.run_id, g.episode, f.* EXCLUDE (run_id, step, pos, back, n) FROM grid g LEFT JOIN filled f ON f.run_id = g.run_id AND f.pos = g.episode + 1),
    padded AS (SELECT run_id, episode, {', '.join(_padded(c, r) for c, (_, r) in series.SERIES_DEFAULTS.items())} FROM joined)
    SELECT *, seq_scans_removed >= 2 AS scan_star FROM padded""",
)
def m12(spark, d):
    return plain(series.aligned_series(_history(spark, d), _LENGTH))


CTE_CHECK = f""", cte_check AS (SELECT run_id, AVG(CASE WHEN {CTE_SQL} THEN 1 ELSE 0 END) >= 0.4 AS pass, false AS skipped FROM completions GROUP BY run_id)
    """
GATE = """, run_times AS (SELECT run_id AS query_id, CASE WHEN step_index < 3 THEN 'baseline' ELSE 'trained' END AS variant, step_index AS rep, new_ms AS ms,
      CASE WHEN run_id = 'run-2' AND timed_out THEN 'late' ELSE 'h' END AS result_hash FROM attempts),
    gate_check AS (SELECT query_id AS run_id, median(ms) <= 1000 AND bool_and(result_hash = 'h') AS pass, false AS skipped
      FROM run_times WHERE variant = 'trained' GROUP BY query_id)
    """
ALL_CHECKS = (
    FILLED
    + INFLECTION
    + NOOP
    + IMPROVED
    + CTE_CHECK
    + GATE
    + """, checks AS (SELECT run_id, 'CTE_PRODUCTION' AS c, 0 AS prio, pass, skipped FROM cte_check
    UNION ALL SELECT run_id, 'REWARD_INFLECTION', 1, pass, skipped FROM inflections UNION ALL SELECT run_id, 'NOOP_ELIMINATION', 2, pass, skipped FROM noop_check
    UNION ALL SELECT run_id, 'PLAN_IMPROVEMENTS', 3, pass, skipped FROM gain_check UNION ALL SELECT run_id, 'Q5_PERFORMANCE', 4, pass, skipped FROM gate_check),
    counted AS (SELECT run_id, COUNT(*) FILTER (pass) AS p, COUNT(*) FILTER (NOT skipped AND pass = false) AS f, COUNT(*) FILTER (skipped) AS k,
      arg_min(c, prio) FILTER (NOT skipped AND pass = false) AS worst FROM checks GROUP BY run_id),
    verdicts AS (SELECT run_id, p AS checks_passed, f AS checks_failed, k AS checks_skipped, worst,
      CASE WHEN f = 0 AND p = 5 AND k = 0 THEN 'PASS' WHEN f = 0 AND p + k = 5 AND k > 0 THEN 'PARTIAL'
        WHEN f = 0 AND 5 - k > 0 AND p = 5 - k THEN 'PASS' WHEN p >= 3 AND f <= 2 AND p + f + k = 5 THEN 'PARTIAL' ELSE 'FAIL' END AS overall FROM counted)
    """
)
CHECK_VIEWS = ("history", "completions", "attempts")


def _verdict(spark, d):
    history = _history(spark, d)
    times = standin(spark, d, "attempts").select(
        F.col("run_id").alias("query_id"),
        F.when(F.col("step_index") < 3, "baseline").otherwise("trained").alias("variant"),
        F.col("new_ms").alias("ms"),
        F.when((F.col("run_id") == "run-2") & F.col("timed_out"), "late").otherwise("h").alias("result_hash"),
    )
    base = times.select("query_id", F.lit("h").alias("base_hash")).distinct()
    rows = benchmarks.benchmark(times, base)
    gate = benchmarks.single_query_gate(rows).select(F.col("query_id").alias("run_id"), "pass", F.lit(False).alias("skipped"))
    cte = episodes.cte_share(standin(spark, d, "completions"), keys=["run_id"]).withColumn("skipped", F.lit(False))
    named = {
        "CTE_PRODUCTION": cte,
        "NOOP_ELIMINATION": series.noop_rate(history),
        "REWARD_INFLECTION": series.reward_inflection(history),
        "PLAN_IMPROVEMENTS": series.improvement_rate(history),
        "Q5_PERFORMANCE": gate,
    }
    checks = None
    for name, rows in named.items():
        part = series.check_rows(name, rows)
        checks = part if checks is None else checks.unionByName(part)
    return series.verdict(checks)


@Q("M13_verdict", CHECK_VIEWS, ALL_CHECKS + "SELECT run_id, checks_passed, checks_failed, checks_skipped, overall FROM verdicts")
def m13(spark, d):
    return plain(_verdict(spark, d).drop("recommendation"))


@Q(
    "M14_recommendation",
    CHECK_VIEWS,
    ALL_CHECKS
    + "SELECT run_id, CASE WHEN overall = 'PASS' THEN '{}' {} ELSE '{}' END AS recommendation FROM verdicts".format(
        series.ADVICE_PASS, " ".join(f"WHEN worst = '{n}' THEN '{t}'" for n, t in series.ADVICE), series.ADVICE_OTHER
    ),
)
def m14(spark, d):
    return _verdict(spark, d).select("run_id", "recommendation")


@Q(
    "M15_first_syntax_penalties",
    H,
    FILLED
    + "SELECT run_id, step, rn AS position FROM (SELECT run_id, step, row_number() OVER (PARTITION BY run_id ORDER BY step) AS rn FROM history WHERE syntax_error > 0) x WHERE rn <= 5",
)
def m15(spark, d):
    return plain(series.first_syntax_penalties(_history(spark, d)).select("run_id", "step", "position"))


@Q("M16_scan_gain_marks", H, "SELECT run_id, step, COALESCE(seq_scans_removed >= 2, false) AS scan_star FROM history")
def m16(spark, d):
    return series.mark_scan_gains(_history(spark, d)).select("run_id", "step", "scan_star")


@Q(
    "E14_series_summary",
    H,
    FILLED
    + """, smooth AS (SELECT *, AVG(reward_mean) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS roll FROM filled),
    total AS (SELECT run_id, MAX(reward_mean) AS best_reward, SUM(syntax_error) AS syntax_errors, SUM(result_changed) AS result_changed, COUNT(*) AS episodes,
      AVG(reward_mean) FILTER (back <= 50) AS final_mean_reward, AVG(seq_scans_removed) FILTER (back <= 50) AS mean_scans_removed,
      AVG(episode_length) FILTER (back <= 50) AS mean_episode_length, AVG(roll) FILTER (back <= 20) AS final_smoothed_reward,
      MAX(result_changed) AS peak FROM smooth GROUP BY run_id)
    SELECT t.run_id, ROUND(best_reward, 9) AS best_reward, syntax_errors, result_changed, episodes, ROUND(final_mean_reward, 9) AS final_mean_reward,
    ROUND(mean_scans_removed, 9) AS mean_scans_removed, ROUND(mean_episode_length, 9) AS mean_episode_length,
    ROUND(final_smoothed_reward, 9) AS final_smoothed_reward, CASE WHEN floor(peak) > 3 THEN peak END AS peak_penalty,
    CASE WHEN floor(peak) > 3 THEN (SELECT MIN(step) FROM filled f WHERE f.run_id = t.run_id AND f.result_changed = t.peak) END AS peak_step FROM total t""",
)
def e14(spark, d):
    return plain(series.series_summary(_history(spark, d)), 9)
