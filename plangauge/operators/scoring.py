"""Scoring a log of rewrite attempts.

All window functions share one partitioning, (run_id, episode_id), so the log
is shuffled once.  An episode is at most ``max_steps`` attempts long, and the
log is cut to those attempts before the shuffle, so no episode can be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plangauge.functions import reward as R
from plangauge.functions.completions import ACTIONS
from plangauge.functions.sqltext import has_no_blocked_word

EPISODE = ["run_id", "episode_id"]
MAX_STEPS = 5
SUGGESTED_WHEN_UNKNOWN = "push_filter"


def outcome() -> Column:
    """The first thing that is wrong with an attempt; null when it is accepted.

    A revert repeats an earlier query, so only its parse flag is checked.
    """
    readable = F.coalesce(F.col("parse_ok"), F.lit(False)) & (
        (F.col("action") == "revert") | has_no_blocked_word(F.col("rewritten_query"))
    )
    return (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "invalid_action")
        .when(~readable, "syntax_error")
        .when(F.coalesce(F.col("timed_out"), F.lit(False)), "timeout")
        .when(F.col("exec_error").isNotNull(), "execution_error")
        .when(~F.col("new_hash").eqNullSafe(F.col("base_hash")), "result_changed")
    )


def judge(attempts: DataFrame, start: DataFrame) -> DataFrame:
    """Attempts next to what is known of their episode's start, with ``has_start``, ``error`` and ``accepted``."""
    rows = attempts.join(start.withColumn("has_start", F.lit(True)), EPISODE, "left").withColumn("has_start", F.coalesce("has_start", F.lit(False)))
    error = outcome()
    rows = rows.withColumn("error", F.when(F.col("has_start") | (error != "result_changed"), error))
    return rows.withColumn("accepted", F.col("has_start") & F.col("error").isNull())


def penalty(error: Column) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for name, value in R.PENALTIES.items():
        chain = chain.when(error == name, F.lit(value))
    return chain


def _plan(prefix: str) -> dict[str, Column]:
    return {name: F.col(f"{prefix}.{name}") for name in R.PLAN_FIELDS}


def score_attempts(attempts: DataFrame, initial: DataFrame, max_steps: int = MAX_STEPS) -> DataFrame:
    """Replay every episode from its log.

    ``attempts``: run_id, episode_id, step_index (0-based, unique per episode), action, rewritten_query,
    parse_ok, timed_out, exec_error, new_ms, new_hash and the plan fields of the attempt.
    ``initial``: run_id, episode_id, task_level, target_ms, original_query, execution_ms, base_hash and the
    plan fields, prefixed ``base_``.

    Rejected attempts change nothing: the state before an attempt is that of the
    last accepted attempt, else the initial one.  Attempts after the first done
    one are left out.

    Attempts of an episode whose first observation is missing stay, with ``has_start`` false.  They keep an error that needs no
    state; whether their result changed, and what they gained, is not known: they are not accepted and, without an error, have no reward.
    """
    log = attempts.filter(F.col("step_index") < max_steps)
    start = initial.select(
        *EPISODE,
        "task_level",
        "target_ms",
        "original_query",
        "base_hash",
        F.col("execution_ms").alias("start_ms"),
        F.struct(*[F.col(f"base_{n}").alias(n) for n in R.PLAN_FIELDS]).alias("start_plan"),
    )
    rows = judge(log, start)
    # an accepted attempt whose plan could not be read keeps the plan before it
    rows = rows.withColumn("_read", F.when(F.col("node_type").isNotNull(), F.struct(*R.PLAN_FIELDS)))

    steps = W.partitionBy(*EPISODE).orderBy("step_index")
    before = steps.rowsBetween(W.unboundedPreceding, -1)
    upto = steps.rowsBetween(W.unboundedPreceding, 0)
    taken_plan = F.when(F.col("accepted"), F.col("_read"))
    taken_ms = F.when(F.col("accepted"), F.col("new_ms"))
    rows = rows.withColumns(
        {
            "old_ms": F.coalesce(F.last(taken_ms, ignorenulls=True).over(before), F.col("start_ms")),
            "old_plan": F.coalesce(F.last(taken_plan, ignorenulls=True).over(before), F.col("start_plan")),
            "state_ms": F.coalesce(F.last(taken_ms, ignorenulls=True).over(upto), F.col("start_ms")),
            "state_plan": F.coalesce(F.last(taken_plan, ignorenulls=True).over(upto), F.col("start_plan")),
            "steps_before": F.count(F.when(F.col("accepted"), 1)).over(before),
            "best_ms_before": F.min(taken_ms).over(before),
            "best_ms": F.min(taken_ms).over(upto),
        }
    )
    rows = rows.withColumn("step_count", F.col("steps_before") + F.col("accepted").cast("long"))
    finished = F.col("accepted") & ((F.col("new_ms") <= F.col("target_ms")) | (F.col("step_count") >= max_steps))
    rows = rows.withColumn("done", F.coalesce(finished, F.lit(False)))
    # The best query text changes when an accepted attempt beats every earlier one; a revert repeats the text it had.
    record = F.col("accepted") & (F.col("best_ms_before").isNull() | (F.col("new_ms") < F.col("best_ms_before")))
    new_best = F.when(record & (F.col("action") != "revert"), F.col("rewritten_query"))
    rows = rows.withColumns(
        {
            "_ended": F.coalesce(F.max("done").over(before), F.lit(False)),
            "best_query_before": F.coalesce(F.last(new_best, ignorenulls=True).over(before), F.col("original_query")),
            "best_query": F.coalesce(F.last(new_best, ignorenulls=True).over(upto), F.col("original_query")),
        }
    )
    rows = rows.filter(~F.col("_ended"))
    rows = rows.withColumn(
        "effective_query",
        F.when(F.col("action") == "revert", F.col("best_query_before")).otherwise(F.col("rewritten_query")),
    )
    rows = rows.withColumn("new_plan", F.coalesce("_read", "old_plan"))
    rows = R.with_reward(rows, F.col("old_ms"), F.col("new_ms"), _plan("old_plan"), _plan("new_plan"), F.col("steps_before"))
    rows = rows.withColumn("breakdown", F.when(F.col("accepted"), F.col("breakdown")))
    rows = rows.withColumn(
        "reward", F.when(F.col("accepted"), F.col("breakdown.normalized")).otherwise(penalty(F.col("error")))
    )
    return rows.drop("_read", "_ended")


def with_history(scored: DataFrame) -> DataFrame:
    """Add the accepted queries and rewards so far, in order (at most ``max_steps`` entries)."""
    upto = W.partitionBy(*EPISODE).orderBy("step_index").rowsBetween(W.unboundedPreceding, 0)
    return scored.withColumns(
        {
            "previous_rewrites": F.collect_list(F.when(F.col("accepted"), F.col("effective_query"))).over(upto),
            "previous_rewards": F.collect_list(F.when(F.col("accepted"), F.col("reward"))).over(upto),
        }
    )


def audit(scored: DataFrame) -> DataFrame:
    """Reward components of the accepted attempts, as the audit shows them."""
    accepted = scored.filter("accepted")
    return accepted.withColumns(R.audit_split(_plan("old_plan"), _plan("new_plan"), "breakdown"))


def potential_gain(initial: DataFrame) -> DataFrame:
    """The reward a query could reach at most: its ideal plan against its initial one."""
    old = {name: F.col(f"base_{name}") for name in R.PLAN_FIELDS}
    plan, ms = R.ideal_plan(old, F.col("execution_ms"))
    staged = initial.withColumns({f"ideal_{name}": column for name, column in plan.items()}).withColumn("ideal_ms", ms)
    new = {name: F.col(f"ideal_{name}") for name in R.PLAN_FIELDS}
    return R.with_reward(staged, F.col("execution_ms"), F.col("ideal_ms"), old, new, F.lit(0), into="potential")
