"""Rewrite-attempt scoring and episode queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plangauge.catalog.base import Catalog, plain
from plangauge.operators import episodes, scoring
from plangauge.session import cut_lineage, new_work_dir
from plangauge.sources import steplog
from plangauge.sources.standins import standin

CATALOG = Catalog()
Q = CATALOG.query
LOGS = ("attempts", "initial_obs")

_PREV = "OVER (PARTITION BY run_id, episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_UPTO = "OVER (PARTITION BY run_id, episode_id ORDER BY step_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BLOCKED = r"\b(CREATE|DROP|ALTER|TRUNCATE|INSERT|UPDATE|DELETE|GRANT|REVOKE|VACUUM|ANALYZE)\b"


def _last(column: str, frame: str, start: str) -> str:
    return f"COALESCE(last_value(CASE WHEN error IS NULL THEN {column} END IGNORE NULLS) {frame}, {start})"


def reward_sql(old_ms: str, new_ms: str, old: str, new: str, step: str, source: str, node: tuple[str, str, str] | None = None) -> str:
    """The reward formula over a source with plan columns prefixed ``old`` and ``new``."""
    same = " AND ".join(f"{old}{c} IS NOT DISTINCT FROM {new}{c}" for c in ("node_type", "seq_scans", "nested_loops", "hash_joins"))
    return f"""SELECT *, plan_type_bonus + speedup_reward + rows_signal + cost_signal + noop_penalty + slowdown_penalty AS raw,
      GREATEST(-1e0, LEAST(1e0, (plan_type_bonus + speedup_reward + rows_signal + cost_signal + noop_penalty + slowdown_penalty) / 44e0)) AS normalized
    FROM (SELECT *, 8e0 * GREATEST({old}seq_scans - {new}seq_scans, 0) + 6e0 * GREATEST({old}nested_loops - {new}nested_loops, 0) AS plan_type_bonus,
      15e0 * ratio + CASE WHEN ratio > 0.5 THEN 5e0 ELSE 0e0 END + CASE WHEN ratio > 0.8 THEN 8e0 ELSE 0e0 END AS speedup_reward,
      CASE WHEN {old}rows > 0 THEN 5e0 * GREATEST(0e0, LEAST(1e0, ({old}rows - {new}rows) / CAST({old}rows AS DOUBLE))) ELSE 0e0 END AS rows_signal,
      CASE WHEN {old}total_cost > 0 THEN 3e0 * GREATEST(0e0, LEAST(1e0, ({old}total_cost - {new}total_cost) / {old}total_cost)) ELSE 0e0 END AS cost_signal,
      CASE WHEN {same} AND abs({old_ms} - {new_ms}) < {old_ms} * 2e-2 THEN -2e0 * (1 + GREATEST(0, LEAST({step}, 4))) ELSE 0e0 END AS noop_penalty,
      CASE WHEN {new_ms} > {old_ms} AND {old_ms} > 0 THEN -1e1 * LEAST(({new_ms} - {old_ms}) / {old_ms}, 2e0) ELSE 0e0 END AS slowdown_penalty
      FROM (SELECT *, CASE WHEN {old_ms} > 0 AND {new_ms} > 0 THEN GREATEST(0e0, LEAST(1e0, ({old_ms} - {new_ms}) / {new_ms}))
        WHEN {old_ms} > 0 AND {new_ms} = 0 THEN 1e0 ELSE 0e0 END AS ratio FROM {source}) r1) r2"""


_PLAN = [
    ("node_type", "base_node_type"),
    ("total_cost", "base_total_cost"),
    ("rows_out", "base_rows"),
    ("seq_scans", "base_seq_scans"),
    ("nested_loops", "base_nested_loops"),
    ("hash_joins", "base_hash_joins"),
]


def _name(column: str) -> str:
    return "rows" if column == "rows_out" else column


SCORED = f"""WITH judged AS (
      SELECT a.*, i.run_id IS NOT NULL AS has_start, i.task_level, i.target_ms, i.original_query, i.execution_ms, i.base_hash, i.base_node_type, i.base_total_cost,
      i.base_rows, i.base_seq_scans, i.base_nested_loops, i.base_hash_joins,
      CASE WHEN action NOT IN ('rewrite_join', 'add_cte', 'push_filter', 'reorder_joins', 'suggest_index', 'limit_early', 'revert') THEN 'invalid_action'
        WHEN NOT parse_ok OR (action <> 'revert' AND regexp_matches(upper(rewritten_query), '{_BLOCKED}')) THEN 'syntax_error'
        WHEN timed_out THEN 'timeout' WHEN exec_error IS NOT NULL THEN 'execution_error'
        WHEN i.run_id IS NULL THEN 'no_start' WHEN new_hash IS DISTINCT FROM base_hash THEN 'result_changed' END AS error
      FROM attempts a LEFT JOIN initial_obs i ON a.run_id = i.run_id AND a.episode_id = i.episode_id WHERE step_index < 5),
    carried AS (
      SELECT *, {_last('new_ms', _PREV, 'execution_ms')} AS old_ms, {_last('new_ms', _UPTO, 'execution_ms')} AS state_ms,
      {', '.join(f"{_last(c, _PREV, b)} AS old_{_name(c)}" for c, b in _PLAN)},
      {_last('seq_scans', _UPTO, 'base_seq_scans')} AS state_seq,
      {', '.join(f"{c} AS new_{_name(c)}" for c, _ in _PLAN)},
      COUNT(CASE WHEN error IS NULL THEN 1 END) {_PREV} AS steps_before, COUNT(CASE WHEN error IS NULL THEN 1 END) {_UPTO} AS step_count,
      MIN(CASE WHEN error IS NULL THEN new_ms END) {_PREV} AS best_before, MIN(CASE WHEN error IS NULL THEN new_ms END) {_UPTO} AS best_ms
      FROM judged),
    flagged AS (
      SELECT *, error IS NULL AND (new_ms <= target_ms OR step_count >= 5) AS done,
      CASE WHEN error IS NULL AND action <> 'revert' AND (best_before IS NULL OR new_ms < best_before) THEN rewritten_query END AS new_best
      FROM carried),
    ended AS (
      SELECT *, COALESCE(bool_or(done) {_PREV}, false) AS over_before,
      COALESCE(last_value(new_best IGNORE NULLS) {_PREV}, original_query) AS best_query_before,
      COALESCE(last_value(new_best IGNORE NULLS) {_UPTO}, original_query) AS best_query FROM flagged),
    kept AS (SELECT *, CASE WHEN action = 'revert' THEN best_query_before ELSE rewritten_query END AS effective_query FROM ended WHERE NOT over_before),
    rewarded AS ({reward_sql('old_ms', 'new_ms', 'old_', 'new_', 'steps_before', 'kept')}),
    scored AS (SELECT *, CASE error WHEN 'invalid_action' THEN -15e0 WHEN 'syntax_error' THEN -15e0 WHEN 'timeout' THEN -12e0
      WHEN 'execution_error' THEN -15e0 WHEN 'result_changed' THEN -20e0 ELSE normalized END AS reward FROM rewarded)
    """


def attempts(spark, d):
    """The log in canonical form (the stand-in calls the row count rows_out)."""
    return standin(spark, d, "attempts").withColumnRenamed("rows_out", "rows")


def scored(spark, d):
    return scoring.score_attempts(attempts(spark, d), standin(spark, d, "initial_obs"))


KEY = ["run_id", "episode_id", "step_index"]
KEY_SQL = "run_id, episode_id, CAST(step_index AS BIGINT) AS step_index"


@Q(
    "S1_outcome_ladder",
    LOGS,
    SCORED.replace(" WHERE step_index < 5", "")
    + f"""SELECT {KEY_SQL}, has_start, NULLIF(error, 'no_start') AS error, CASE error WHEN 'invalid_action' THEN -15e0 WHEN 'syntax_error' THEN -15e0 WHEN 'timeout' THEN -12e0
    WHEN 'execution_error' THEN -15e0 WHEN 'result_changed' THEN -20e0 END AS penalty FROM judged""",
)
def s1(spark, d):
    rows = attempts(spark, d)
    base = standin(spark, d, "initial_obs").select(*scoring.EPISODE, "base_hash")
    judged = scoring.judge(rows, base)
    return plain(judged.select(*KEY, "has_start", "error", scoring.penalty(F.col("error")).alias("penalty")))


@Q(
    "S2_state_carry",
    LOGS,
    SCORED
    + f"""SELECT {KEY_SQL}, ROUND(old_ms, 6) AS old_ms, ROUND(state_ms, 6) AS state_ms, old_node_type,
    CAST(old_seq_scans AS BIGINT) AS old_seq_scans, CAST(state_seq AS BIGINT) AS state_seq_scans FROM kept""",
)
def s2(spark, d):
    rows = scored(spark, d)
    return plain(
        rows.select(
            *KEY,
            "old_ms",
            "state_ms",
            F.col("old_plan.node_type").alias("old_node_type"),
            F.col("old_plan.seq_scans").alias("old_seq_scans"),
            F.col("state_plan.seq_scans").alias("state_seq_scans"),
        )
    )


def _step_log(spark, d):
    """The log in its nested layout, with the first half of some lines once more, as a writer that was stopped leaves them."""
    path = new_work_dir(spark, "step-log")
    lines = cut_lineage(steplog.to_step_log(scoring.with_history(scored(spark, d))))
    torn = lines.filter(_torn()).select(F.expr("left(value, cast(length(value) / 2 as int))").alias("value"))
    lines.unionByName(torn).write.text(path)
    return steplog.read_step_log(spark, path)


def _torn():
    return (F.get_json_object("value", "$.episode_id").cast("long") % 10 == 0) & (F.get_json_object("value", "$.step_index") == "0")


@Q(
    "IO2_nested_step_log",
    LOGS,
    SCORED
    + f"SELECT {KEY_SQL}, NULLIF(error, 'no_start') AS error, ROUND(reward, 6) + 0e0 AS reward, ROUND(old_ms, 6) AS old_ms, ROUND(state_ms, 6) AS state_ms, done, effective_query FROM scored",
)
def io2_nested(spark, d):
    rows, _ = _step_log(spark, d)
    replayed = scoring.score_attempts(steplog.attempts(rows), steplog.initial_observations(rows))
    return plain(replayed.select(*KEY, "error", "reward", "old_ms", "state_ms", "done", "effective_query"))


@Q("IO2_quarantined_lines", LOGS, SCORED + "SELECT 'not a JSON object' AS problem, COUNT(*) AS lines FROM scored WHERE episode_id % 10 = 0 AND step_index = 0")
def io2_quarantined(spark, d):
    _, bad = _step_log(spark, d)
    return bad.groupBy("problem").agg(F.count("*").alias("lines"))


_PARTS = "plan_type_bonus speedup_reward rows_signal cost_signal noop_penalty slowdown_penalty raw normalized".split()


@Q(
    "S3_reward",
    LOGS,
    SCORED + f"SELECT {KEY_SQL}, {', '.join(f'CASE WHEN ROUND({p}, 6) = 0 THEN 0e0 ELSE ROUND({p}, 6) END AS {p}' for p in _PARTS)} FROM rewarded WHERE error IS NULL",
)
def s3(spark, d):
    return plain(scored(spark, d).filter("accepted").select(*KEY, "breakdown.*"))


@Q("S4_step_counter", LOGS, SCORED + f"SELECT {KEY_SQL}, step_count, done FROM kept")
def s4(spark, d):
    return plain(scored(spark, d).select(*KEY, "step_count", "done"))


@Q(
    "S5_episode_end",
    LOGS,
    SCORED + "SELECT run_id, episode_id, COUNT(*) AS attempts, bool_or(done) AS finished FROM kept GROUP BY run_id, episode_id",
)
def s5(spark, d):
    rows = scored(spark, d)
    return rows.groupBy(*scoring.EPISODE).agg(F.count("*").alias("attempts"), F.bool_or("done").alias("finished"))


@Q("S6_best_so_far", LOGS, SCORED + f"SELECT {KEY_SQL}, ROUND(best_ms, 6) AS best_ms, best_query FROM kept")
def s6(spark, d):
    return plain(scored(spark, d).select(*KEY, "best_ms", "best_query"))


@Q("S7_revert", LOGS, SCORED + f"SELECT {KEY_SQL}, effective_query FROM kept WHERE action = 'revert'")
def s7(spark, d):
    return plain(scored(spark, d).filter(F.col("action") == "revert").select(*KEY, "effective_query"))


@Q(
    "S8_attempt_history",
    LOGS,
    SCORED
    + f"""SELECT {KEY_SQL}, COALESCE(string_agg(CASE WHEN error IS NULL THEN effective_query END, ' | ') {_UPTO}, '') AS previous_rewrites,
    COALESCE(ROUND(SUM(CASE WHEN error IS NULL THEN reward END) {_UPTO}, 6), 0e0) AS reward_total,
    COUNT(CASE WHEN error IS NULL THEN 1 END) {_UPTO} AS rewards FROM scored""",
)
def s8(spark, d):
    rows = scoring.with_history(scored(spark, d))
    total = F.aggregate("previous_rewards", F.lit(0.0), lambda a, x: a + x)
    return plain(
        rows.select(
            *KEY,
            F.array_join("previous_rewrites", " | ").alias("previous_rewrites"),
            total.alias("reward_total"),
            F.size("previous_rewards").alias("rewards"),
        )
    )


@Q(
    "S9_audit_split",
    LOGS,
    SCORED
    + f"""SELECT {KEY_SQL}, 8e0 * GREATEST(old_seq_scans - new_seq_scans, 0) AS seq_scan_component,
    6e0 * GREATEST(old_nested_loops - new_nested_loops, 0) AS nested_loop_component,
    CASE WHEN ROUND(noop_penalty + slowdown_penalty, 6) = 0 THEN 0e0 ELSE ROUND(noop_penalty + slowdown_penalty, 6) END AS penalties FROM rewarded WHERE error IS NULL""",
)
def s9(spark, d):
    return plain(scoring.audit(scored(spark, d)).select(*KEY, "seq_scan_component", "nested_loop_component", "penalties"))


_IDEAL = """WITH ideal AS (SELECT run_id, episode_id, execution_ms AS old_ms, execution_ms * 1e-1 AS new_ms, base_node_type AS old_node_type,
      base_total_cost AS old_total_cost, base_rows AS old_rows, base_seq_scans AS old_seq_scans, base_nested_loops AS old_nested_loops,
      base_hash_joins AS old_hash_joins, 'Index Only Scan' AS new_node_type, GREATEST(base_total_cost * 1e-1, 1e0) AS new_total_cost,
      GREATEST(CAST(FLOOR(base_rows / 2e2) AS BIGINT), 1) AS new_rows, 0 AS new_seq_scans, 0 AS new_nested_loops,
      base_hash_joins AS new_hash_joins FROM initial_obs),
    gained AS ("""


@Q(
    "S10_potential_gain",
    ("initial_obs",),
    _IDEAL
    + reward_sql("old_ms", "new_ms", "old_", "new_", "0", "ideal")
    + ") SELECT run_id, episode_id, ROUND(new_ms, 6) AS ideal_ms, new_rows AS ideal_rows, ROUND(raw, 6) AS raw, ROUND(normalized, 6) AS normalized FROM gained",
)
def s10(spark, d):
    rows = scoring.potential_gain(standin(spark, d, "initial_obs"))
    return plain(rows.select(*scoring.EPISODE, "ideal_ms", "ideal_rows", "potential.raw", "potential.normalized"))


# Episodes ----------------------------------------------------------------------------

METRICS = (
    SCORED
    + """, seen AS (SELECT run_id, episode_id, COUNT(*) AS n, AVG(reward) AS mean_reward, SUM(reward) AS total,
      COUNT(*) FILTER (error = 'result_changed') AS changed, COUNT(*) FILTER (error = 'syntax_error') AS syntax,
      arg_max(state_ms, step_index) AS final_ms, arg_max(state_seq, step_index) AS final_seq FROM scored GROUP BY run_id, episode_id),
    metrics AS (SELECT COALESCE(i.run_id, s.run_id) AS run_id, COALESCE(i.episode_id, s.episode_id) AS episode_id, COALESCE(mean_reward, 0e0) AS mean_step_reward, COALESCE(total, 0e0) AS episode_total_reward,
      GREATEST(0e0, LEAST(1e0, (execution_ms - COALESCE(final_ms, execution_ms)) / execution_ms)) AS speedup_ratio,
      COALESCE(changed, 0) AS result_changed, COALESCE(syntax, 0) AS syntax_errors,
      CAST(CASE WHEN n IS NULL THEN 0 ELSE GREATEST(base_seq_scans - final_seq, 0) END AS BIGINT) AS seq_scans_removed,
      COALESCE(n, 0) AS episode_length, COALESCE(final_ms, execution_ms) AS final_execution_ms, CAST(COALESCE(task_level, 1) AS BIGINT) AS task_level, i.run_id IS NOT NULL AS has_start
      FROM initial_obs i FULL JOIN seen s ON i.run_id = s.run_id AND i.episode_id = s.episode_id)
    """
)


def metrics(spark, d):
    return episodes.episode_metrics(scored(spark, d), standin(spark, d, "initial_obs"))


@Q(
    "E1_episode_metrics",
    LOGS,
    METRICS
    + """SELECT run_id, episode_id, ROUND(mean_step_reward, 6) AS mean_step_reward, ROUND(speedup_ratio, 6) AS speedup_ratio, result_changed,
    syntax_errors, seq_scans_removed, episode_length, task_level, has_start FROM metrics""",
)
def e1(spark, d):
    return plain(metrics(spark, d).drop("episode_total_reward", "final_execution_ms"))


@Q(
    "E2_episode_log",
    LOGS,
    METRICS
    + """SELECT run_id, episode_id AS episode, run_id AS label, ROUND(episode_total_reward, 9) AS episode_total_reward,
    ROUND(final_execution_ms, 9) AS final_execution_ms, ROUND(speedup_ratio, 9) AS speedup_ratio, syntax_errors AS syntax_penalties,
    result_changed AS result_penalties, task_level FROM metrics""",
)
def e2(spark, d):
    return plain(episodes.episode_log(metrics(spark, d)), 9)


@Q(
    "E3_running_mean_reward",
    LOGS,
    METRICS
    + """SELECT run_id, episode_id AS episode, ROUND(AVG(episode_total_reward) OVER
    (PARTITION BY run_id ORDER BY episode_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running_mean FROM metrics""",
)
def e3(spark, d):
    log = episodes.episode_log(metrics(spark, d)).select("run_id", "episode", "episode_total_reward")
    # read twice, so the replay behind it is not run twice
    return plain(episodes.running_mean_reward(cut_lineage(log)).drop("episode_total_reward"))


_SUMMARY = """, runs AS (SELECT run_id, arg_min(run_id, episode_id) AS label, AVG(episode_total_reward) AS mean_episode_reward,
    AVG(final_execution_ms) AS mean_execution_ms, AVG(speedup_ratio) AS mean_speedup_ratio, AVG(syntax_errors) AS mean_syntax_penalties,
    AVG(result_changed) AS mean_result_changed_penalties, COUNT(*) AS episodes FROM metrics GROUP BY run_id)
    """


@Q(
    "E4_run_summary",
    LOGS,
    METRICS
    + _SUMMARY
    + """SELECT run_id, label, ROUND(mean_episode_reward, 4) AS mean_episode_reward, ROUND(mean_execution_ms, 4) AS mean_execution_ms,
    ROUND(mean_speedup_ratio, 4) AS mean_speedup_ratio, ROUND(mean_syntax_penalties, 4) AS mean_syntax_penalties,
    ROUND(mean_result_changed_penalties, 4) AS mean_result_changed_penalties, episodes FROM runs""",
)
def e4(spark, d):
    return plain(episodes.summarize_runs(episodes.episode_log(metrics(spark, d)), ["run_id"]), 4)


@Q(
    "E5_run_comparison",
    LOGS,
    METRICS
    + _SUMMARY
    + """, long AS (UNPIVOT (SELECT run_id, CAST(episodes AS DOUBLE) AS episodes, mean_episode_reward, mean_execution_ms, mean_speedup_ratio,
      mean_syntax_penalties, mean_result_changed_penalties FROM runs) ON COLUMNS(* EXCLUDE run_id) INTO NAME metric VALUE value),
    wide AS (SELECT metric, MAX(value) FILTER (run_id = 'run-1') AS baseline, MAX(value) FILTER (run_id = 'run-0') AS trained FROM long GROUP BY metric)
    SELECT metric, ROUND(baseline, 4) AS baseline, ROUND(trained, 4) AS trained, ROUND(trained - baseline, 4) AS difference,
    CASE WHEN baseline <> 0 THEN ROUND((trained - baseline) / baseline * 100, 4) END AS percent_change FROM wide""",
)
def e5(spark, d):
    runs = episodes.summarize_runs(episodes.episode_log(metrics(spark, d)), ["run_id"])
    return plain(episodes.compare_runs(runs, F.col("run_id"), "run-1", "run-0"), 4)
