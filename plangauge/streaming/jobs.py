"""Structured Streaming jobs over arriving attempt and metric files.

Outputs are versioned by micro-batch and written to a folder, so a retried
batch replaces its own output and nothing passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plangauge.operators import series
from plangauge.streaming.versions import Folder


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
    name_pattern: str | None = None,
) -> DataFrame:
    """Files arriving in a folder, with a declared schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if name_pattern:
        reader = reader.option("pathGlobFilter", name_pattern)
    return reader.load(path)


def event_time(df: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A zoned event time with a watermark; rows later than the delay are dropped by the stateful operators."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


COMPACT_EVERY = 20


def start_versioned(
    changes: DataFrame, folder: str, available_now: bool = True, every: str = "1 minute", keys: list[str] | None = None, compact_every: int = COMPACT_EVERY
) -> StreamingQuery:
    """Run an update-mode query; every batch writes the rows that changed.

    With ``keys``, every ``compact_every`` batches the newest rows are put into one snapshot (:mod:`plangauge.streaming.versions`).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = Folder(batch.sparkSession, folder)
        kept.write(batch, batch_id)
        if keys and batch_id % compact_every == compact_every - 1:
            kept.compact(keys)

    writer = changes.writeStream.outputMode("update").foreachBatch(write)
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest_versions(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest version of every key written by :func:`start_versioned`: one snapshot and the batches behind it are read."""
    return Folder(spark, folder).latest(keys)


# ST1 ---------------------------------------------------------------------------------


def live_episode_totals(steps: DataFrame, gap: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Totals per episode while it runs: an episode ends when it is quiet for ``gap``.

    Expects run_id, episode_id, step_index, ts, reward, new_ms, error.  The final time is that of the last
    step; of steps at the same time the one with the greater index.  Spark writes session windows once they
    are closed; there is no update mode for them.
    """
    timed = event_time(steps, delay=delay)
    return (
        timed.groupBy("run_id", "episode_id", F.session_window("ts", gap).alias("session"))
        .agg(
            F.count("*").alias("episode_length"),
            F.sum("reward").alias("episode_total_reward"),
            F.max_by("new_ms", F.struct("ts", "step_index")).alias("final_execution_ms"),
            F.count_if(F.col("error") == "syntax_error").alias("syntax_penalties"),
            F.count_if(F.col("error") == "result_changed").alias("result_penalties"),
        )
        .withColumn("session_start", F.col("session.start"))
        .withColumn("session_end", F.col("session.end"))
        .drop("session")
    )


def start_append(rows: DataFrame, folder: str, available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
    """Write finished rows once, as Parquet."""
    writer = rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/data")
    writer = writer.option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


# ST2 ---------------------------------------------------------------------------------


def health_report(history: DataFrame) -> DataFrame:
    """Inflection, no-op and improvement checks with alerts, one row per run."""
    inflection = series.reward_inflection(history).select("run_id", "points", "inflection", F.col("pass").alias("inflection_pass"))
    noop = series.noop_rate(history).select("run_id", "noop_rate", F.col("pass").alias("noop_pass"))
    plans = series.improvement_rate(history).select("run_id", "improvement_rate", F.col("pass").alias("improvement_pass"))
    base = history.groupBy("run_id").agg(F.max("step").alias("global_step"))
    out = base.join(inflection.drop("points"), "run_id", "left")
    for part in (noop, plans, series.alerts(history)):
        out = out.join(part, "run_id", "left")
    return out


def start_health_checks(
    history: DataFrame, folder: str, available_now: bool = True, every: str = "1 minute", keep_reports: int | None = None
) -> StreamingQuery:
    """Recompute the checks after every micro-batch and write a report.

    Only the rows the checks look at are carried from batch to batch: the state
    per run has a fixed size, so a batch costs as much late in a run as early, and two states are all
    that is stored, next to the reports: all of them, or those of the last ``keep_reports`` batches.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = Folder(spark, folder)
        known = batch
        if batch_id > 0:
            known = spark.read.schema(batch.schema).parquet(f"{folder}/state/batch={batch_id - 1}").unionByName(batch)
        series.compact(known).write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        state = spark.read.schema(batch.schema).parquet(f"{folder}/state/batch={batch_id}")
        health_report(state).write.mode("overwrite").parquet(f"{folder}/reports/batch={batch_id}")
        kept.forget("state", batch_id - 1)  # a retry needs the state before it
        if keep_reports:
            kept.forget("reports", batch_id - keep_reports + 1)

    writer = history.writeStream.outputMode("append").foreachBatch(check).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def latest_report(spark: SparkSession, folder: str) -> DataFrame:
    """The report of the newest batch."""
    return spark.read.parquet(f"{folder}/reports/batch={Folder(spark, folder).last('reports')}")


# ST3 ---------------------------------------------------------------------------------


def penalty_windows(steps: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Attempts and penalties per action in tumbling (no slide) or sliding windows. Expects ts, action, error."""
    timed = event_time(steps, delay=delay)
    window: Column = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (
        timed.groupBy(window.alias("_w"), "action")
        .agg(F.count("*").alias("attempts"), F.count("error").alias("penalties"))
        .select(
            F.col("_w.start").alias("window_start"),
            F.col("_w.end").alias("window_end"),
            "action",
            "attempts",
            "penalties",
            (F.col("penalties") / F.col("attempts")).alias("penalty_rate"),
        )
    )
