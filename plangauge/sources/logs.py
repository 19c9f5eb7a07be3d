"""Log tables: canonical schemas, JSON-lines reading and writing, run selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from plangauge.operators.skew import top_n_per_key


_KINDS = {"INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType()}


def _columns(text: str) -> T.StructType:
    """A schema from "name TYPE, ..."; works before there is a session."""
    pairs = [item.split() for item in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in pairs])


# Canonical schemas of the log tables.
EPISODES = _columns(
    "episode INT, label STRING, episode_total_reward DOUBLE, final_execution_ms DOUBLE, speedup_ratio DOUBLE, "
    "syntax_penalties INT, result_penalties INT, task_level INT"
)
HISTORY = _columns(
    "run_id STRING, step BIGINT, reward_mean DOUBLE, env_reward DOUBLE, speedup_ratio DOUBLE, result_changed DOUBLE, "
    "syntax_error DOUBLE, seq_scans_removed DOUBLE, episode_length DOUBLE, task_level DOUBLE, action STRING, "
    "train_action STRING, step_action STRING, rewrite_unchanged INT, noop INT"
)
# The names under which trackers log these columns.
TRACKED = {
    "step": "_step",
    "reward_mean": "reward/mean",
    "env_reward": "env/reward",
    "speedup_ratio": "reward/speedup_ratio",
    "result_changed": "penalty/result_changed",
    "syntax_error": "penalty/syntax_error",
    "seq_scans_removed": "plan/seq_scans_removed",
    "train_action": "train/action",
    "step_action": "step/action",
    "rewrite_unchanged": "train/rewrite_unchanged",
}
TIMINGS = _columns("query_id STRING, variant STRING, rep INT, ms DOUBLE, result_hash STRING")
PLANS = _columns("plan_id BIGINT, plan_json STRING")
COMPLETIONS = _columns("prompt_id BIGINT, sample_id INT, text STRING")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON object per line. Blank lines are skipped, a bad line raises, a missing path gives no rows."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines, one file per partition, replacing what is there; types JSON lacks become text."""
    as_text = (T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)
    columns = [
        F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, as_text) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_history(
    spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "json", cap: int | None = None
) -> DataFrame:
    """Metric history with only the wanted columns, logged under our names or a tracker's (which wins).

    ``cap`` keeps the first rows of each run by step.
    """
    tracked = [T.StructField(name, HISTORY[column].dataType) for column, name in TRACKED.items()]
    df = spark.read.schema(T.StructType([*HISTORY.fields, *tracked])).format(fmt).load(path)
    wanted = dict.fromkeys(["run_id", "step", *(columns or HISTORY.names)])
    df = df.select(*[F.coalesce(F.col(f"`{TRACKED[c]}`"), F.col(c)).alias(c) if c in TRACKED else F.col(c) for c in wanted])
    if cap is not None:
        df = top_n_per_key(df, ["run_id"], [F.col("step").asc()], cap, salt_by=["step"]).drop("_rank")
    return df


def write_benchmark(rows: DataFrame, summarize: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Per-query rows and their one-row summary, side by side; the summary is taken from the rows as written."""
    rows.write.mode("overwrite").json(f"{path}/queries")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{path}/queries")
    summarize(written).write.mode("overwrite").json(f"{path}/summary")


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder with one file per checkpoint step, written by many tasks; rerunning a step replaces only that step."""
    # the number is given: reports are small in bytes, and would be put together in a task that writes all folders one by one
    session = reports.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    reports.repartition(tasks, "global_step").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("global_step").json(path)


def newest_run(runs: DataFrame, created: Column | None = None) -> DataFrame:
    """Per project, the run with the greatest creation mark; a missing mark counts as empty text."""
    mark = F.coalesce(F.col("created_at") if created is None else created, F.lit(""))
    return runs.groupBy("project").agg(
        F.max_by("run_id", F.struct(mark, F.col("run_id"))).alias("run_id"), F.max(mark).alias("created_at")
    )
