"""The nested log of rewrite attempts: one JSON entry a step, or one trajectory a line.

An entry holds ``obs_before``, ``action``, ``rewritten_query``, ``observation``, ``reward``, ``done`` and ``info``; the ids ``run_id``,
``episode_id`` and ``step_index`` name it.  A line is an entry, or an object with ``run_id``, ``episode_id`` and the entries of an episode in
``trajectory``, numbered by their place.  Two older forms are read too: ``action`` as an object with the query inside, and ``observation``
as the state *before* the step where there is no ``obs_before``.

Lines are parsed once, to VARIANT, so entries may carry any further fields and plans of any depth.  What cannot be used is not lost
and does not stop the job: it comes back as quarantined rows with the reason.  Everything here is a narrow transformation of the lines
except :func:`initial_observations`, whose grouping is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.functions.reward import PLAN_FIELDS

EPISODE = ("run_id", "episode_id")
# The fields of an observation and of a stored plan that are read, with their types.
OBSERVATION = {
    "original_query": "string", "execution_ms": "double", "result_hash": "string", "step_count": "int", "task_level": "int",
    "bottleneck_diagnosis": "string", "target_ms": "double", "previous_rewrites": "array<string>", "previous_rewards": "array<double>", "suggested_actions": "array<string>",
}
PLAN = dict(zip(PLAN_FIELDS, ("string", "double", "long", "int", "int", "int")))
INFO = {"error": "string", "message": "string", "new_ms": "double", "best_ms": "double", "step_count": "int"}


def _get(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def _fields(value: Column, fields: Mapping[str, str], under: str = "$") -> list[Column]:
    return [_get(value, f"{under}.{name}", kind).alias(name) for name, kind in fields.items()]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a log with the file they come from; blank ones are skipped, a missing path gives none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], "line string, file string")
        raise
    return lines.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")).filter(F.trim("line") != "")


def parse(lines: DataFrame) -> DataFrame:
    """One row for each entry, or for each line without any, with ``problem`` null where the entry can be used."""
    text = F.trim("line")
    # the parser stops at the end of a value: what is behind it shows a line that was cut or overwritten
    read = F.when(text.startswith("{") & text.endswith("}"), F.try_parse_json("line"))
    parsed = lines.withColumn("_line", read)
    steps = _get(F.col("_line"), "$.trajectory", "array<variant>")
    no_position = F.lit(None).cast("int")
    entries = F.when(steps.isNotNull(), F.transform(steps, lambda e, i: F.struct(e.alias("entry"), i.cast("int").alias("place")))).otherwise(
        F.array(F.struct(F.col("_line").alias("entry"), no_position.alias("place")))
    )
    one = parsed.withColumn("_e", F.explode_outer(entries))
    entry, place = F.col("_e.entry"), F.col("_e.place")
    before = F.coalesce(_get(entry, "$.obs_before", "variant"), _get(entry, "$.observation", "variant"))
    after = F.when(_get(entry, "$.obs_before", "variant").isNotNull(), _get(entry, "$.observation", "variant"))
    one = one.select(
        "line",
        "file",
        *[F.coalesce(_get(F.col("_line"), f"$.{c}", kind), _get(entry, f"$.{c}", kind)).alias(c) for c, kind in (("run_id", "string"), ("episode_id", "long"))],
        F.coalesce(_get(entry, "$.step_index", "int"), place).alias("step_index"),
        F.coalesce(_get(entry, "$.action.action", "string"), _get(entry, "$.action", "string")).alias("action"),
        F.coalesce(_get(entry, "$.action.rewritten_query", "string"), _get(entry, "$.rewritten_query", "string")).alias("rewritten_query"),
        _get(entry, "$.reward", "double").alias("reward"),
        _get(entry, "$.done", "boolean").alias("done"),
        F.col("_line").alias("_line"),
        entry.alias("_entry"),
        before.alias("_before"),
        after.alias("_after"),
        _get(entry, "$.info", "variant").alias("_info"),
    )
    problem = (
        F.when(F.col("_line").isNull(), "not a JSON object")
        .when(~_is_object(F.col("_entry")), "an entry is not an object")
        .when(F.col("run_id").isNull() | F.col("episode_id").isNull() | F.col("step_index").isNull(), "no id")
        .when(F.col("step_index") < 0, "negative step")
        .when(F.col("action").isNull(), "no action")
        .when(~_is_object(F.col("_before")), "no observation before the step")
        .when(~_is_object(F.col("_info")), "no info")
    )
    return one.withColumn("problem", problem)


def quarantined(parsed: DataFrame) -> DataFrame:
    """file, line, problem: what :func:`entries` leaves out, once for each entry that cannot be used."""
    return parsed.filter("problem is not null").select("file", "line", "problem")


def entries(parsed: DataFrame) -> DataFrame:
    """One typed row for each usable entry: ids, action, both observations with their plans, reward, done and info."""

    def observation(value: str) -> Column:
        plan = F.struct(*_fields(F.col(value), PLAN, "$.explain_plan"))
        return F.when(F.col(value).isNotNull(), F.struct(*_fields(F.col(value), OBSERVATION), plan.alias("plan")))

    return parsed.filter("problem is null").select(
        *EPISODE,
        "step_index",
        "action",
        "rewritten_query",
        observation("_before").alias("obs_before"),
        observation("_after").alias("observation"),
        "reward",
        "done",
        F.struct(*_fields(F.col("_info"), INFO), F.to_json(_get(F.col("_info"), "$.reward_breakdown", "variant")).alias("reward_breakdown")).alias("info"),
    )


def attempts(rows: DataFrame) -> DataFrame:
    """The flat attempt log that :func:`plangauge.operators.scoring.score_attempts` replays.

    An accepted step is measured by the observation behind it.  The log does not hold the hash of a changed result: it is null, which differs
    from every hash.  The state of a rejected step is the one before it, so its plan and time are not taken for the attempt's.
    """
    error, plan = F.col("info.error"), F.col("observation.plan")
    accepted = error.isNull()
    return rows.select(
        *EPISODE,
        "step_index",
        "action",
        "rewritten_query",
        (~error.eqNullSafe("syntax_error")).alias("parse_ok"),
        error.eqNullSafe("timeout").alias("timed_out"),
        F.when(error == "execution_error", F.coalesce("info.message", F.lit(""))).alias("exec_error"),
        F.when(accepted, F.coalesce("info.new_ms", "observation.execution_ms")).alias("new_ms"),
        F.when(~error.eqNullSafe("result_changed"), F.coalesce("observation.result_hash", "obs_before.result_hash")).alias("new_hash"),
        *[F.when(accepted, plan[name]).alias(name) for name in PLAN_FIELDS],
    )


def initial_observations(rows: DataFrame) -> DataFrame:
    """What an episode starts from: the observation before its step 0; episodes whose step 0 is missing have none."""
    first = rows.filter("step_index = 0").groupBy(*EPISODE).agg(F.min_by("obs_before", F.to_json("obs_before")).alias("_o"))
    return first.select(
        *EPISODE,
        *[F.col(f"_o.{name}").alias(name) for name in ("task_level", "target_ms", "original_query", "execution_ms")],
        F.col("_o.result_hash").alias("base_hash"),
        *[F.col(f"_o.plan.{name}").alias(f"base_{name}") for name in PLAN_FIELDS],
    )


def read_step_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Typed entries, and the quarantined lines."""
    parsed = parse(read_lines(spark, path))
    return entries(parsed), quarantined(parsed)


def disagreements(rows: DataFrame, scored: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Entries whose logged reward or end differs from what a replay of the log gives; only ids and the two values."""
    logged = rows.select(*EPISODE, "step_index", F.col("reward").alias("logged_reward"), F.col("done").alias("logged_done"))
    replayed = scored.select(*EPISODE, "step_index", F.col("reward").alias("replayed_reward"), F.col("done").alias("replayed_done"))
    both = logged.join(replayed, [*EPISODE, "step_index"])
    same = F.coalesce(F.abs(F.col("logged_reward") - F.col("replayed_reward")) <= tolerance, F.col("logged_reward").eqNullSafe(F.col("replayed_reward")))
    return both.filter(~same | ~F.col("logged_done").eqNullSafe(F.col("replayed_done")))


def _observation(row: Mapping[str, Column], plan: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in row.items()], plan.alias("explain_plan"))


def to_step_log(scored: DataFrame) -> DataFrame:
    """Scored attempts as log lines (``value``); a reader replays them to the same scores.

    Takes the rows of :func:`plangauge.operators.scoring.with_history`, which carry the state on both sides of each step.
    """
    count_before, count = F.col("steps_before").cast("int"), F.col("step_count").cast("int")
    fixed = {"original_query": F.col("original_query"), "result_hash": F.col("base_hash"), "task_level": F.col("task_level"), "target_ms": F.col("target_ms")}
    lists = {"previous_rewrites": "previous_rewrites", "previous_rewards": "previous_rewards"}
    # before an accepted step the lists lack its own entry
    earlier = {n: F.when(F.col("accepted"), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(F.col(c)) for n, c in lists.items()}
    before = _observation({**fixed, "execution_ms": F.col("old_ms"), "step_count": count_before, **earlier}, F.col("old_plan"))
    after = _observation({**fixed, "execution_ms": F.col("state_ms"), "step_count": count, **{n: F.col(c) for n, c in lists.items()}}, F.col("state_plan"))
    info = F.when(
        F.col("accepted"),
        F.to_json(F.struct(F.col("breakdown").alias("reward_breakdown"), "new_ms", "best_ms", count.alias("step_count"))),
    ).otherwise(F.to_json(F.struct("error", F.coalesce("exec_error", "error").alias("message"))))
    entry = F.struct(
        *EPISODE, "step_index", before.alias("obs_before"), "action", "rewritten_query", after.alias("observation"), "reward", "done", F.parse_json(info).alias("info")
    )
    return scored.select(F.to_json(entry).alias("value"))


def write_step_log(scored: DataFrame, path: str) -> None:
    """One entry a line, replacing what is there."""
    to_step_log(scored).write.mode("overwrite").text(path)
