"""Timing logs: medians, speedups, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.operators.skew import exact_median

# Floor of a trained time, benchmark rule, limits of the single-query gate in ms.
MS_FLOOR = 1e-6
PASS_RATIO = 2.0
PASS_QUERIES = 3
GATE_MS = 1000.0
GATE_TARGET_MS = 500.0
GATE_STRETCH_MS = 310.0


def median_timings(timings: DataFrame, *also: Column) -> DataFrame:
    """Exact median time per query and variant, found by counting near the middle; ``also`` are more aggregates."""
    return exact_median(timings, ["query_id", "variant"], "ms", *also).withColumnsRenamed({"median": "median_ms", "n": "repetitions"})


def benchmark_rows(medians: DataFrame) -> DataFrame:
    """One row per query: the three medians, both hash flags and the speedup untrained/trained."""

    def of(variant: str, name: str) -> Column:
        return F.max(F.when(F.col("variant") == variant, F.col(name)))

    rows = medians.groupBy("query_id").agg(
        of("baseline", "median_ms").alias("baseline_ms"),
        of("untrained", "median_ms").alias("untrained_ms"),
        of("trained", "median_ms").alias("trained_ms"),
        F.coalesce(of("untrained", "hash_match"), F.lit(False)).alias("hash_match_untrained"),
        F.coalesce(of("trained", "hash_match"), F.lit(False)).alias("hash_match_trained"),
    )
    return rows.withColumn("speedup", speedup(F.col("untrained_ms"), F.col("trained_ms")))


def speedup(untrained: Column, trained: Column) -> Column:
    """Untrained over trained time; null when either is missing or the trained time is not positive."""
    u, t = F.nanvl(untrained, F.lit(None).cast("double")), F.nanvl(trained, F.lit(None).cast("double"))
    return F.when(t > 0, u / F.greatest(t, F.lit(MS_FLOOR)))


def benchmark_verdict(rows: DataFrame, ratio: float = PASS_RATIO, needed: int = PASS_QUERIES) -> DataFrame:
    """Mean speedup, number of queries that pass, and whether enough of them do."""
    passing = (
        (F.col("speedup") >= ratio)
        & (F.col("untrained_ms") > 0)
        & F.col("hash_match_untrained")
        & F.col("hash_match_trained")
    )
    return rows.agg(
        F.coalesce(F.avg(F.when(F.col("speedup") > 0, F.col("speedup"))), F.lit(0.0)).alias("avg_speedup"),
        F.count_if(passing).alias("count_passing"),
        F.count("*").alias("queries"),
    ).withColumn("passed", F.col("count_passing") >= needed)


def best_speedup(rows: DataFrame, ordinal: str = "query_id") -> DataFrame:
    """Greatest speedup and its query; the first query by ``ordinal`` wins a tie."""
    best = rows.filter(F.col("speedup") > 0)
    top = best.agg(F.max("speedup").alias("best_speedup"), F.min_by("query_id", F.struct(-F.col("speedup"), F.col(ordinal))).alias("query_id"))
    text = F.format_string("%.1fx on %s", F.bround("best_speedup", 1), F.col("query_id"))
    return top.withColumn("summary", F.when(F.col("best_speedup").isNotNull(), text).otherwise(F.lit(""))).withColumn(
        "best_speedup", F.coalesce("best_speedup", F.lit(0.0))
    )


def single_query_gate(
    rows: DataFrame, cap: float = GATE_MS, target: float = GATE_TARGET_MS, stretch: float = GATE_STRETCH_MS
) -> DataFrame:
    """Per query: the rewrite keeps the result and its median time is within the cap, the target, the stretch goal."""
    same, ms = F.col("hash_match_trained"), F.col("trained_ms")

    def within(limit: float) -> Column:
        return F.coalesce(same & (ms <= limit), F.lit(False))

    return rows.select(
        "query_id",
        F.col("baseline_ms").alias("original_ms"),
        F.col("trained_ms").alias("rewritten_ms"),
        F.when(ms > 0, F.col("baseline_ms") / ms).otherwise(F.lit(0.0)).alias("speedup"),
        same.alias("hash_verified"),
        within(cap).alias("pass"),
        within(target).alias("meets_target"),
        within(stretch).alias("meets_stretch"),
    )


def benchmark(timings: DataFrame, baselines: DataFrame) -> DataFrame:
    """Timings and baseline hashes to benchmark rows.

    The hashes of a query and variant are all equal exactly if the least is the greatest and none or all are
    null, so they come out of the aggregation that brackets the medians; a query without a baseline does not match.
    """
    name = F.col("result_hash")
    hashes = [F.min(name).alias("_least"), F.max(name).alias("_most"), F.count_if(name.isNull()).alias("_nulls"), F.count("*").alias("_all")]
    found = median_timings(timings, *hashes).join(baselines.select("query_id", "base_hash", F.lit(True).alias("_known")), "query_id", "left")
    uniform = F.col("_least").eqNullSafe(F.col("_most")) & ((F.col("_nulls") == 0) | (F.col("_nulls") == F.col("_all")))
    match = F.col("_known") & uniform & F.col("_least").eqNullSafe(F.col("base_hash"))
    return benchmark_rows(found.withColumn("hash_match", match))
