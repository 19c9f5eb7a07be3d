"""From scored attempts to episodes, runs and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.functions.sqltext import has_cte
from plangauge.operators.scoring import EPISODE
from plangauge.operators.skew import DEFAULT_SPAN, top_n_per_key, with_prefix

# The compared metrics and how many decimals they are shown with.
RUN_METRICS = (
    "episodes",
    "mean_episode_reward",
    "mean_execution_ms",
    "mean_speedup_ratio",
    "mean_syntax_penalties",
    "mean_result_changed_penalties",
)


def _no_nan(name: str) -> Column:
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def episode_metrics(scored: DataFrame, initial: DataFrame) -> DataFrame:
    """One row per started episode, also for those without attempts (all zeros, with their level).

    Episodes of which only attempts were logged have ``has_start`` false and no times or gains.  ``scored`` is already partitioned by
    episode, so the grouping adds no shuffle.
    """
    last = F.col("step_index")
    seen = scored.groupBy(*EPISODE).agg(
        F.count("*").alias("_length"),
        F.avg("reward").alias("_mean"),
        F.sum("reward").alias("_total"),
        F.count_if(F.col("error") == "result_changed").alias("_changed"),
        F.count_if(F.col("error") == "syntax_error").alias("_syntax"),
        F.max_by("state_ms", last).alias("_final_ms"),
        F.max_by("state_plan.seq_scans", last).alias("_final_seq"),
    )
    rows = initial.withColumn("has_start", F.lit(True)).join(seen, EPISODE, "full").withColumn("has_start", F.coalesce("has_start", F.lit(False)))
    base = F.col("execution_ms")
    final = F.coalesce(F.col("_final_ms"), base)
    gain = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (base - final) / base))
    zero = F.lit(0).cast("long")
    removed = F.coalesce(F.col("base_seq_scans"), F.lit(0)) - F.coalesce(F.col("_final_seq"), F.lit(0))
    return rows.select(
        *EPISODE,
        F.coalesce("_mean", F.lit(0.0)).alias("mean_step_reward"),
        F.coalesce("_total", F.lit(0.0)).alias("episode_total_reward"),
        F.when(F.col("_length").isNull() | (base <= 0), F.lit(0.0)).otherwise(gain).alias("speedup_ratio"),
        F.coalesce("_changed", zero).alias("result_changed"),
        F.coalesce("_syntax", zero).alias("syntax_errors"),
        F.when(F.col("_length").isNull() | ~F.col("has_start"), F.lit(0)).otherwise(F.greatest(F.lit(0), removed)).cast("long").alias("seq_scans_removed"),
        F.coalesce("_length", zero).alias("episode_length"),
        final.alias("final_execution_ms"),
        F.coalesce("task_level", F.lit(1)).alias("task_level"),
        "has_start",
    )


def episode_log(metrics: DataFrame, label: Column | None = None) -> DataFrame:
    """The row that is logged per episode."""
    return metrics.select(
        "run_id",
        F.col("episode_id").alias("episode"),
        (F.col("run_id") if label is None else label).alias("label"),
        "episode_total_reward",
        "final_execution_ms",
        "speedup_ratio",
        F.col("syntax_errors").alias("syntax_penalties"),
        F.col("result_changed").alias("result_penalties"),
        "task_level",
    )


def running_mean_reward(episodes: DataFrame, span: int = DEFAULT_SPAN) -> DataFrame:
    """Mean of all episode totals of the run so far.

    Uses chunk totals instead of one window per run, so a run of any length is spread over many tasks.
    """
    # sums of decimals do not depend on the order in which chunks arrive
    totals = {"_sum": F.col("episode_total_reward").cast("decimal(28,9)"), "_count": F.lit(1).cast("long")}
    rows = with_prefix(episodes, ["run_id"], "episode", totals, span)
    return rows.withColumn("running_mean", F.col("_sum").cast("double") / F.col("_count")).drop("_sum", "_count")


def summarize_runs(episodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Label of the first episode, five means and the number of episodes.

    Without keys the whole log is one run, and an empty log gives label "empty" and zeros.
    """
    keys = keys or []
    nothing = F.lit("empty") if not keys else F.lit("run")

    def mean(name: str) -> Column:
        return F.coalesce(F.avg(name), F.lit(0.0))

    label = F.coalesce(F.min_by(F.coalesce("label", F.lit("run")), "episode"), nothing)
    return episodes.groupBy(*keys).agg(
        label.alias("label"),
        mean("episode_total_reward").alias("mean_episode_reward"),
        mean("final_execution_ms").alias("mean_execution_ms"),
        mean("speedup_ratio").alias("mean_speedup_ratio"),
        mean("syntax_penalties").alias("mean_syntax_penalties"),
        mean("result_penalties").alias("mean_result_changed_penalties"),
        F.count("*").alias("episodes"),
    )


def compare_runs(summaries: DataFrame, run: Column, baseline: str, trained: str) -> DataFrame:
    """One row per metric: both values, their difference and the change in percent (null when the baseline is 0)."""
    two = summaries.withColumn("_run", run).filter(F.col("_run").isin(baseline, trained))
    values = two.select("_run", *[F.col(m).cast("double").alias(m) for m in RUN_METRICS])
    long = values.unpivot(["_run"], list(RUN_METRICS), "metric", "value")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("_run") == baseline, F.col("value"))).alias("baseline"),
        F.max(F.when(F.col("_run") == trained, F.col("value"))).alias("trained"),
    )
    change = F.col("trained") - F.col("baseline")
    return wide.withColumn("difference", change).withColumn(
        "percent_change", F.when(F.col("baseline") != 0, change / F.col("baseline") * 100)
    )


def cte_share(texts: DataFrame, text: str = "text", threshold: float = 0.40, keys: list[str] | None = None) -> DataFrame:
    """Share of texts with a WITH clause, and whether it reaches the threshold."""
    share = F.coalesce(F.avg(has_cte(F.col(text)).cast("int")), F.lit(0.0))
    return texts.groupBy(*(keys or [])).agg(share.alias("cte_rate"), F.count("*").alias("samples_checked")).withColumn(
        "pass", F.col("cte_rate") >= threshold
    )


def level_success(history: DataFrame, keys: list[str] | None = None, level: int = 1, gate: float = 0.30) -> DataFrame:
    """Share of entries of a level with a positive reward; the gate closes below the limit."""
    rows = history.filter(F.col("task_level") == level)
    return (
        rows.groupBy(*(keys or []))
        .agg(F.avg(F.coalesce(_no_nan("reward_mean") > 0, F.lit(False)).cast("int")).alias("success_rate"), F.count("*").alias("entries"))
        .withColumn("gating", F.col("success_rate") < gate)
    )


def highest_reward(history: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greatest value over every numeric column whose name contains "reward", with the number of rows."""
    numeric = ("double", "float", "int", "bigint", "decimal")
    names = [n for n, kind in history.dtypes if "reward" in n.lower() and kind.startswith(numeric)]
    clean = [F.max(_no_nan(n)) for n in names]
    best = F.greatest(F.lit(0.0), *clean) if clean else F.lit(0.0)
    return history.agg(best.alias("max_reward_seen"), F.count("*").alias("episodes_logged")).withColumn(
        "ok", F.col("max_reward_seen") > threshold
    )


# Task selection -------------------------------------------------------------------


def tasks_for_levels(tasks: DataFrame, *levels: int) -> DataFrame:
    return tasks.filter(F.col("level").isin(*levels))


def _draw(purpose: str, n: Column) -> Column:
    """A number from 0 to n - 1 from the md5 of the seed and a purpose."""
    digest = F.md5(F.concat(F.col("seed").cast("string"), F.lit(f":{purpose}")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), n)


def assign_tasks(
    resets: DataFrame, tasks: list[tuple[str, int]], first: int = 200, unlocked: int = 3, gating: bool = True
) -> DataFrame:
    """Give every reset (run_id, reset_index, seed) a level and a task.

    The first ``first`` resets of a run get level 1, later ones a level between
    1 and ``unlocked`` (at most 3) drawn from the seed.  Without gating every
    reset has level 1.  The task is drawn from the seed among the tasks of the
    level, or among all tasks when the level has none.  Draws are hashes of the
    seed, so they repeat, and they are even, but they are not the numbers of any
    particular generator.
    """
    top = min(3, max(1, unlocked))
    if gating:
        early = top_n_per_key(resets, ["run_id"], [F.col("reset_index").asc()], first, ["reset_index"])
        limits = early.groupBy("run_id").agg(F.max("reset_index").alias("_limit"))
        rows = resets.join(limits, "run_id")  # a hot run is split by adaptive execution
        drawn = _draw("level", F.lit(top)) + 1
        level = F.when(F.col("reset_index") <= F.col("_limit"), F.lit(1)).otherwise(drawn).cast("int")
        rows = rows.withColumn("task_level", level).drop("_limit")
    else:
        rows = resets.withColumn("task_level", F.lit(1))
    # ids per level as a literal map; level 0 stands for "all"
    by_level = {0: [t for t, _ in tasks]}
    for task, task_level in tasks:
        by_level.setdefault(task_level, []).append(task)
    pairs = [x for level, ids in by_level.items() for x in (F.lit(level), F.array(*[F.lit(i) for i in ids]))]
    choices = F.create_map(*pairs)
    usable = F.coalesce(F.try_element_at(choices, F.col("task_level")), F.try_element_at(choices, F.lit(0)))
    at = _draw("task", F.size(usable)).cast("int") + 1
    return rows.withColumn("task_id", F.element_at(usable, at))
