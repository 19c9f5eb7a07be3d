"""Reward of one rewrite as column arithmetic."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reward weights, no-op penalties by step, divisor, failure penalties.
SPEEDUP_WEIGHT = 15.0
SPEEDUP_STEPS = ((0.5, 5.0), (0.8, 8.0))
SEQ_SCAN_WEIGHT = 8.0
NESTED_LOOP_WEIGHT = 6.0
ROWS_WEIGHT = 5.0
COST_WEIGHT = 3.0
SLOWDOWN_WEIGHT = 10.0
SLOWDOWN_LIMIT = 2.0
NOOP_PENALTIES = (-2.0, -4.0, -6.0, -8.0, -10.0)
NOOP_TOLERANCE = 0.02
DIVISOR = 44.0
PENALTIES = {
    "invalid_action": -15.0,
    "syntax_error": -15.0,
    "timeout": -12.0,
    "execution_error": -15.0,
    "result_changed": -20.0,
}

PLAN_FIELDS = ("node_type", "total_cost", "rows", "seq_scans", "nested_loops", "hash_joins")


def _number(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _clip(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), column))


def _saved(old: Column, new: Column) -> Column:
    """Share of the old value that is gone, within [0, 1]; 0 when there was nothing to save."""
    return F.when(old > 0, _clip((old - new) / old, 0.0, 1.0)).otherwise(F.lit(0.0))


def _removed(old: Mapping[str, Column], new: Mapping[str, Column], name: str) -> Column:
    return F.greatest(_number(old[name]) - _number(new[name]), F.lit(0.0))


def speedup_ratio(old_ms: Column, new_ms: Column) -> Column:
    """Relative gain measured against the new time, within [0, 1]."""
    old, new = _number(old_ms), _number(new_ms)
    return (
        F.when((old > 0) & (new > 0), _clip((old - new) / new, 0.0, 1.0))
        .when((old > 0) & (new == 0), F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def reward_parts(
    old_ms: Column, new_ms: Column, ratio: Column, old: Mapping[str, Column], new: Mapping[str, Column], step: Column
) -> dict[str, Column]:
    """The six named components. ``old`` and ``new`` map plan field names to columns."""
    before, after = _number(old_ms), _number(new_ms)
    speedup = F.lit(SPEEDUP_WEIGHT) * ratio
    for above, extra in SPEEDUP_STEPS:
        speedup = speedup + F.when(ratio > above, F.lit(extra)).otherwise(F.lit(0.0))
    same_plan = F.lit(True)
    for name in ("node_type", "seq_scans", "nested_loops", "hash_joins"):
        same_plan = same_plan & old[name].eqNullSafe(new[name])
    same_time = F.abs(before - after) < before * F.lit(NOOP_TOLERANCE)
    index = F.greatest(F.lit(0), F.least(step.cast("int"), F.lit(len(NOOP_PENALTIES) - 1)))
    noop = F.element_at(F.array(*[F.lit(p) for p in NOOP_PENALTIES]), index + 1)
    slower = F.least((after - before) / before, F.lit(SLOWDOWN_LIMIT)) * F.lit(-SLOWDOWN_WEIGHT)
    return {
        "plan_type_bonus": F.lit(SEQ_SCAN_WEIGHT) * _removed(old, new, "seq_scans")
        + F.lit(NESTED_LOOP_WEIGHT) * _removed(old, new, "nested_loops"),
        "speedup_reward": speedup,
        "rows_signal": F.lit(ROWS_WEIGHT) * _saved(_number(old["rows"]), _number(new["rows"])),
        "cost_signal": F.lit(COST_WEIGHT) * _saved(_number(old["total_cost"]), _number(new["total_cost"])),
        "noop_penalty": F.when(same_plan & same_time, noop).otherwise(F.lit(0.0)),
        "slowdown_penalty": F.when((after > before) & (before > 0), slower).otherwise(F.lit(0.0)),
    }


def with_reward(
    df: DataFrame,
    old_ms: Column,
    new_ms: Column,
    old: Mapping[str, Column],
    new: Mapping[str, Column],
    step: Column,
    into: str = "breakdown",
) -> DataFrame:
    """Add a struct of the six components, ``raw`` (their sum) and ``normalized`` (within [-1, 1]).

    Built in stages, so that no component is written out more than once in the plan.
    """
    rows = df.withColumn("_ratio", speedup_ratio(old_ms, new_ms))
    parts = reward_parts(old_ms, new_ms, F.col("_ratio"), old, new, step)
    rows = rows.withColumns({f"_{name}": column for name, column in parts.items()})
    rows = rows.withColumn("_raw", sum((F.col(f"_{name}") for name in parts), F.lit(0.0)))
    scaled = F.col("_raw") / F.lit(DIVISOR)
    normalized = F.when(F.isnan("_raw") | F.col("_raw").isNull(), F.lit(0.0)).otherwise(_clip(scaled, -1.0, 1.0))
    fields = [F.col(f"_{name}").alias(name) for name in parts]
    whole = F.struct(*fields, F.col("_raw").alias("raw"), normalized.alias("normalized"))
    return rows.withColumn(into, whole).drop("_ratio", "_raw", *[f"_{name}" for name in parts])


def audit_split(old: Mapping[str, Column], new: Mapping[str, Column], breakdown: str) -> dict[str, Column]:
    """Components as the audit shows them: scans, loops, and both penalties together."""
    return {
        "seq_scan_component": F.lit(SEQ_SCAN_WEIGHT) * _removed(old, new, "seq_scans"),
        "nested_loop_component": F.lit(NESTED_LOOP_WEIGHT) * _removed(old, new, "nested_loops"),
        "penalties": F.col(f"{breakdown}.noop_penalty") + F.col(f"{breakdown}.slowdown_penalty"),
    }


def ideal_plan(old: Mapping[str, Column], old_ms: Column) -> tuple[dict[str, Column], Column]:
    """The best plan one could hope for: no scans or loops, a tenth of the cost, 1/200 of the rows, a tenth of the time."""
    seq, loops = _number(old["seq_scans"]), _number(old["nested_loops"])
    cost = _number(old["total_cost"])
    cost = F.when(cost == 0, F.lit(1.0)).otherwise(cost)
    rows = F.floor(_number(old["rows"]) / 200).cast("long")
    plan = {
        "node_type": F.when((seq != 0) | (loops != 0), F.lit("Index Only Scan")).otherwise(
            F.coalesce(old["node_type"], F.lit("Seq Scan"))
        ),
        "total_cost": F.greatest(cost * 0.1, F.lit(1.0)),
        "rows": F.greatest(rows, F.lit(1).cast("long")),
        "seq_scans": F.lit(0),
        "nested_loops": F.lit(0),
        "hash_joins": old["hash_joins"],
    }
    ms = _number(old_ms)
    return plan, F.when(ms > 0, ms * 0.1).otherwise(F.lit(0.1))
