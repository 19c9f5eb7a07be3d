"""Ordered metric series: rolling means, health checks, alerts, alignment.

``history`` has one row per (run_id, step); step is unique within a run.  No
window here is partitioned by run alone over the whole history: checks on the
head or tail of a run first reduce the run to that head or tail, and rolling
means cut a run into bounded chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plangauge.operators.skew import DEFAULT_SPAN, rolling, top_n_per_key, with_position

RUN = ["run_id"]

# Windows, thresholds and action names of the health checks.
CHECK_WINDOW = 50
NOOP_LIMIT = 0.10
NOOP_ACTIONS = ("no_op", "noop", "no-op", "identity")
IMPROVEMENT_LIMIT = 0.30
INFLECTION_WIDTH = 10
INFLECTION_POINTS = 20
INFLECTION_RISE = 1.1
INFLECTION_LAST = 500
INFLECTION_GOAL = 100
ALERT_ROWS = 10
FLAT_ROWS = 20
FLAT_CHANGE = 0.05
CHANGED_LIMIT = 0.1
STUCK_LENGTH = 5
SERIES_LENGTH = 300
# Report metrics; True where lower is better.
REPORT_METRICS = {
    "reward_mean": False,
    "speedup_ratio": False,
    "result_changed": True,
    "syntax_error": True,
    "seq_scans_removed": False,
    "episode_length": True,
}
# Value for a missing metric, and whether padding repeats the last value (else 0).
SERIES_DEFAULTS = {
    "reward_mean": (0.0, True),
    "speedup_ratio": (0.0, True),
    "result_changed": (0.0, False),
    "syntax_error": (0.0, False),
    "seq_scans_removed": (0.0, True),
    "episode_length": (4.0, True),
    "task_level": (1.0, True),
}


def no_nan(column: Column) -> Column:
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def reward_series(history: DataFrame) -> DataFrame:
    """(run_id, step, reward): the first reward column that is present, nulls and NaN left out."""
    names = [n for n in ("reward", "reward_mean", "env_reward") if n in history.columns]
    value = F.coalesce(*[F.col(n) for n in names]).cast("double")
    return history.select(*RUN, "step", value.alias("reward")).filter(F.col("reward").isNotNull() & ~F.isnan("reward"))


def filled(history: DataFrame) -> DataFrame:
    """(run_id, step, the series columns) with the default in place of a null or NaN."""
    values = [F.coalesce(no_nan(F.col(c)), F.lit(default)).alias(c) for c, (default, _) in SERIES_DEFAULTS.items()]
    return history.select(*RUN, "step", *values)


def first_rows(history: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows per run; ``_rank`` counts from the start."""
    return top_n_per_key(history, RUN, [F.col("step").asc()], n, ["step"])


def last_rows(history: DataFrame, n: int) -> DataFrame:
    """Last ``n`` rows per run; ``_rank`` counts from the end."""
    return top_n_per_key(history, RUN, [F.col("step").desc()], n, ["step"])


def rolling_mean(
    history: DataFrame, columns: list[str], width: int, full_only: bool = False, span: int = DEFAULT_SPAN
) -> DataFrame:
    """Causal rolling means over the last ``width`` rows; ``full_only`` leaves out the incomplete windows at the start."""
    placed = with_position(history.select(*RUN, "step", *columns), RUN, "step", span=span)
    rows = rolling(placed, RUN, width, {f"{c}_mean": F.avg(c) for c in columns}, block=span)
    return (rows.filter(F.col("_pos") >= width) if full_only else rows).drop("_pos")


# Head and tail state ---------------------------------------------------------------

HEAD_ROWS = INFLECTION_LAST + INFLECTION_WIDTH - 1


def compact(history: DataFrame) -> DataFrame:
    """The rows of each run that the checks and alerts look at.

    Checks on the compacted history equal checks on the history, also when new
    rows are added to a compacted one later; its size per run is fixed.
    """
    valid = history.filter(no_nan(F.coalesce("reward_mean", "env_reward")).isNotNull())
    parts = [first_rows(valid, HEAD_ROWS), last_rows(valid, INFLECTION_WIDTH), last_rows(history, CHECK_WINDOW)]
    columns = history.columns
    together = parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))
    return together.dropDuplicates([*RUN, "step"])


# Health checks ---------------------------------------------------------------------


def reward_inflection(history: DataFrame) -> DataFrame:
    """First point where the 10-point rolling reward rises by more than 10 percent; passes when it is early.

    The search looks at rolling index 1 to 499, so only the first 509 rewards of
    a run and its last ten are needed.
    """
    rewards = reward_series(history)
    head = first_rows(rewards, HEAD_ROWS)
    frame = W.partitionBy(*RUN).orderBy("_rank").rowsBetween(-(INFLECTION_WIDTH - 1), 0)
    smooth = head.withColumn("_roll", F.avg("reward").over(frame)).filter(F.col("_rank") >= INFLECTION_WIDTH)
    smooth = smooth.withColumn("_at", F.col("_rank") - INFLECTION_WIDTH)
    smooth = smooth.withColumn("_prev", F.lag("_roll").over(W.partitionBy(*RUN).orderBy("_rank")))
    rises = (F.col("_prev") > 0) & (F.col("_roll") > F.lit(INFLECTION_RISE) * F.col("_prev"))
    found = smooth.groupBy(*RUN).agg(
        F.min(F.when(rises, F.col("_at"))).alias("inflection"),
        F.min_by("_prev", F.when(rises, F.col("_at"))).alias("_before"),
        F.min_by("_roll", F.when(rises, F.col("_at"))).alias("_after"),
        F.min_by("_roll", "_at").alias("_first_roll"),
    )
    tail = last_rows(rewards, INFLECTION_WIDTH).groupBy(*RUN).agg(F.avg("reward").alias("_last_roll"))
    ends = rewards.groupBy(*RUN).agg(F.max_by("reward", "step").alias("_end"), F.count("*").alias("points"))
    rows = ends.join(found, RUN, "left").join(tail, RUN, "left")
    enough = F.col("points") >= INFLECTION_POINTS
    seen = enough & F.col("inflection").isNotNull()
    return rows.select(
        *RUN,
        "points",
        F.when(enough, F.col("inflection")).cast("long").alias("inflection"),
        F.when(seen, F.round("_before", 4)).when(enough, F.col("_first_roll")).alias("reward_before"),
        F.when(seen, F.round("_after", 4)).when(enough, F.col("_last_roll")).alias("reward_after"),
        F.when(seen, F.round("_end", 4)).alias("reward_at_end"),
        F.coalesce(seen & (F.col("inflection") < INFLECTION_GOAL), F.lit(False)).alias("pass"),
        F.lit(False).alias("skipped"),
    )


def noop_rate(history: DataFrame, window: int = CHECK_WINDOW) -> DataFrame:
    """Share of no-op rows among the last rows of a run; skipped when no column says anything.

    The divisor is at least 3, also for shorter runs.
    """
    signals = [c for c in ("rewrite_unchanged", "noop", "train_action", "action", "step_action") if c in history.columns]
    actions = [F.col(c) for c in ("train_action", "action", "step_action") if c in signals]
    flags = [F.coalesce(F.col(c) == 1, F.lit(False)) for c in ("rewrite_unchanged", "noop") if c in signals]
    is_noop, has_signal = F.lit(False), F.lit(False)
    for flag in flags:
        is_noop = is_noop | flag
    if actions:
        is_noop = is_noop | F.coalesce(F.lower(F.trim(F.coalesce(*actions))).isin(*NOOP_ACTIONS), F.lit(False))
    for name in signals:
        has_signal = has_signal | F.col(name).isNotNull()
    tail = last_rows(history, window).groupBy(*RUN).agg(
        F.count_if(is_noop).alias("_noop"), F.bool_or(has_signal).alias("_signal"), F.count("*").alias("_rows")
    )
    divisor = F.greatest(F.lit(3), F.least(F.col("_rows"), F.lit(window)))
    rate = F.col("_noop") / divisor
    return tail.select(
        *RUN,
        F.when(F.col("_signal"), F.round(rate, 4)).alias("noop_rate"),
        F.when(F.col("_signal"), rate <= NOOP_LIMIT).alias("pass"),
        (~F.col("_signal")).alias("skipped"),
    )


def improvement_rate(history: DataFrame, window: int = CHECK_WINDOW) -> DataFrame:
    """Share of the last rows of a run that removed a sequential scan; skipped when the metric is absent."""
    removed = no_nan(F.col("seq_scans_removed"))
    tail = last_rows(history, window).groupBy(*RUN).agg(
        F.count_if(F.coalesce(removed > 0, F.lit(False))).alias("_good"),
        F.count("seq_scans_removed").alias("_seen"),
        F.count("*").alias("_rows"),
    )
    divisor = F.greatest(F.lit(3), F.least(F.col("_rows"), F.lit(window)))
    rate, seen = F.col("_good") / divisor, F.col("_seen") > 0
    return tail.select(
        *RUN,
        F.when(seen, F.round(rate, 4)).alias("improvement_rate"),
        F.when(seen, rate >= IMPROVEMENT_LIMIT).alias("pass"),
        (~seen).alias("skipped"),
    )


CHECKS = ("CTE_PRODUCTION", "NOOP_ELIMINATION", "REWARD_INFLECTION", "PLAN_IMPROVEMENTS", "Q5_PERFORMANCE")
# Order in which a failing check decides the advice, with the advice.
ADVICE = (
    ("CTE_PRODUCTION", "Few common table expressions: add a filter-pushdown example to the prompt."),
    ("REWARD_INFLECTION", "Reward is flat: look into the diversity of the completions."),
    ("NOOP_ELIMINATION", "Too many no-op rewrites: check the prompt and the action space."),
    ("PLAN_IMPROVEMENTS", "Plans rarely improve: check that removed scans are logged and rewarded."),
    ("Q5_PERFORMANCE", "The single-query goal is missed: check the curriculum and the completions."),
)
ADVICE_PASS = "All checks pass: go on to the next level."
ADVICE_OTHER = "Review the checks; log the missing metrics where checks are skipped."


def check_rows(name: str, checks: DataFrame) -> DataFrame:
    """One check in the common form (run_id, check, pass, skipped)."""
    return checks.select(*RUN, F.lit(name).alias("check"), F.col("pass"), F.coalesce("skipped", F.lit(False)).alias("skipped"))


def verdict(checks: DataFrame, total: int = len(CHECKS)) -> DataFrame:
    """Overall result per run from its check rows, with counts and advice."""
    failed = ~F.col("skipped") & (F.coalesce(F.col("pass"), F.lit(True)) == F.lit(False))
    position = F.lit(None).cast("int")
    for at, (name, _) in reversed(list(enumerate(ADVICE))):
        position = F.when(F.col("check") == name, F.lit(at)).otherwise(position)
    counts = checks.groupBy(*RUN).agg(
        F.count_if(F.coalesce(F.col("pass"), F.lit(False))).alias("checks_passed"),
        F.count_if(failed).alias("checks_failed"),
        F.count_if(F.col("skipped")).alias("checks_skipped"),
        F.min(F.when(failed, position)).alias("_worst"),
    )
    p, f, k = F.col("checks_passed"), F.col("checks_failed"), F.col("checks_skipped")
    overall = (
        F.when((f == 0) & (p == total) & (k == 0), "PASS")
        .when((f == 0) & (p + k == total) & (k > 0), "PARTIAL")
        .when((f == 0) & (total - k > 0) & (p == total - k), "PASS")
        .when((p >= 3) & (f <= 2) & (p + f + k == total), "PARTIAL")
        .otherwise("FAIL")
    )
    texts = F.array(*[F.lit(text) for _, text in ADVICE])
    rows = counts.withColumn("overall", overall)
    advice = (
        F.when(F.col("overall") == "PASS", ADVICE_PASS)
        .when(F.col("_worst").isNotNull(), F.element_at(texts, F.col("_worst") + 1))
        .otherwise(ADVICE_OTHER)
    )
    return rows.withColumn("recommendation", advice).drop("_worst")


# Reports and alerts ----------------------------------------------------------------


def trend(first_mean: Column, last_mean: Column, points: Column, lower_is_better: Column) -> Column:
    delta = last_mean - first_mean
    better = F.when(lower_is_better, delta < 0).otherwise(delta > 0)
    return (
        F.when(points < 2, "n/a").when(F.abs(delta) < 1e-9, "flat").when(better, "improving").otherwise("worse")
    )


def last_rows_report(history: DataFrame, rows: int = ALERT_ROWS) -> DataFrame:
    """One row per run and metric: the last values e0 (oldest) to e9 (newest), and the trend among them.

    The trend compares the mean of the first three valid values with that of the
    last three (single values when there are fewer than three).
    """
    tail = last_rows(history.select(*RUN, "step", *REPORT_METRICS), rows)
    newest_first = W.partitionBy(*RUN)
    tail = tail.withColumn("_count", F.count("*").over(newest_first)).withColumn("_place", F.col("_count") - F.col("_rank"))
    clean = [no_nan(F.col(m)).alias(m) for m in REPORT_METRICS]
    long = tail.select(*RUN, "_place", *clean).unpivot([*RUN, "_place"], list(REPORT_METRICS), "metric", "value")
    values = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("_place", "value")))), lambda v: v["value"]
    )
    wide = long.groupBy(*RUN, "metric").agg(
        *[F.max(F.when(F.col("_place") == i, F.col("value"))).alias(f"e{i}") for i in range(rows)], values.alias("_values")
    )
    size = F.size("_values")
    taken = F.when(size >= 3, F.lit(3)).otherwise(F.lit(1))

    def mean(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / taken

    lower = F.col("metric").isin(*[m for m, low in REPORT_METRICS.items() if low])
    first = F.when(size > 0, mean(F.slice("_values", 1, taken)))
    last = F.when(size > 0, mean(F.slice("_values", F.when(size > 0, size - taken + 1).otherwise(1), taken)))
    return wide.withColumn("trend", trend(first, last, size, lower)).drop("_values")


def alerts(history: DataFrame) -> DataFrame:
    """Per run: the reward is flat, results were changed, episodes always run to the end."""
    tail = last_rows(history, FLAT_ROWS)
    reward = no_nan(F.col("reward_mean"))
    usable = F.abs(reward) < 1e200
    near = F.col("_rank") <= ALERT_ROWS
    rows = tail.groupBy(*RUN).agg(
        F.count_if(F.coalesce(usable, F.lit(False))).alias("_points"),
        F.max_by(reward, F.when(usable, F.col("_rank"))).alias("_first"),
        F.min_by(reward, F.when(usable, F.col("_rank"))).alias("_last"),
        F.coalesce(F.bool_or(F.when(near, no_nan(F.col("result_changed")) > CHANGED_LIMIT)), F.lit(False)).alias("result_tampering"),
        F.count_if(near & F.coalesce(F.bround(no_nan(F.col("episode_length")), 0) == STUCK_LENGTH, F.lit(False))).alias("_full"),
    )
    moved = F.abs(F.col("_last") - F.col("_first")) / F.greatest(F.abs("_first"), F.lit(1e-9))
    flat = F.coalesce((F.col("_points") >= 2) & (moved <= FLAT_CHANGE), F.lit(False))
    return rows.select(*RUN, flat.alias("reward_flat"), "result_tampering", (F.col("_full") >= ALERT_ROWS).alias("stuck"))


def first_syntax_penalties(history: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows per run with a syntax penalty."""
    return first_rows(history.filter(no_nan(F.col("syntax_error")) > 0), n).withColumnRenamed("_rank", "position")


# Alignment and summary -------------------------------------------------------------


def aligned_series(history: DataFrame, length: int = SERIES_LENGTH) -> DataFrame:
    """Every run as exactly ``length`` rows, episodes 0 to length-1: cut when longer, padded when shorter.

    Padding repeats the last value, or is 0 for penalties; a missing value within the run gets the default.
    """
    head = first_rows(filled(history), length)
    values = head.select(*RUN, (F.col("_rank") - 1).alias("episode"), *SERIES_DEFAULTS)
    grid = head.select(*RUN).distinct().withColumn("episode", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    rows = grid.join(values, [*RUN, "episode"], "left")
    upto = W.partitionBy(*RUN).orderBy("episode").rowsBetween(W.unboundedPreceding, 0)
    padded = [
        (F.last(c, ignorenulls=True).over(upto) if repeat else F.coalesce(F.col(c), F.lit(0.0))).alias(c)
        for c, (_, repeat) in SERIES_DEFAULTS.items()
    ]
    return rows.select(*RUN, "episode", *padded).withColumn("scan_star", F.col("seq_scans_removed") >= 2)


def mark_scan_gains(history: DataFrame, least: float = 2.0) -> DataFrame:
    """Mark the rows where at least two sequential scans were removed."""
    return history.withColumn("scan_star", F.coalesce(no_nan(F.col("seq_scans_removed")) >= least, F.lit(False)))


def series_summary(history: DataFrame, tail: int = 50, smooth: int = 20, spike: float = 3.0) -> DataFrame:
    """Per run: recent means, best reward, penalty totals, the last smoothed reward and the worst penalty spike."""
    clean = filled(history)
    whole = clean.groupBy(*RUN).agg(
        F.max("reward_mean").alias("best_reward"),
        F.sum("syntax_error").alias("syntax_errors"),
        F.sum("result_changed").alias("result_changed"),
        F.max("result_changed").alias("_peak"),
        F.min_by("step", F.struct(-F.col("result_changed"), F.col("step"))).alias("_peak_step"),
        F.count("*").alias("episodes"),
    )
    recent = last_rows(clean, max(tail, 2 * smooth - 1))
    near = F.col("_rank") <= tail
    frame = W.partitionBy(*RUN).orderBy(F.col("_rank").desc()).rowsBetween(-(smooth - 1), 0)
    recent = recent.withColumn("_roll", F.avg("reward_mean").over(frame))
    ends = recent.groupBy(*RUN).agg(
        F.avg(F.when(near, F.col("reward_mean"))).alias("final_mean_reward"),
        F.avg(F.when(near, F.col("seq_scans_removed"))).alias("mean_scans_removed"),
        F.avg(F.when(near, F.col("episode_length"))).alias("mean_episode_length"),
        F.avg(F.when(F.col("_rank") <= smooth, F.col("_roll"))).alias("final_smoothed_reward"),
    )
    spiked = F.floor("_peak") > spike
    return (
        whole.join(ends, RUN)
        .withColumn("peak_penalty", F.when(spiked, F.col("_peak")))
        .withColumn("peak_step", F.when(spiked, F.col("_peak_step")))
        .drop("_peak", "_peak_step")
    )
