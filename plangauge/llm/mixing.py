"""Mixing sources to target weights along a curriculum, in DataFrame functions only.

A source's demand over training time t in [0, 1] is its target times the integral
of its weight schedule ``1 + slope * (2 t - 1)``.  Its documents, in an order
drawn by a hash of the id, fill that demand pass after pass; the place where a
document starts is turned into a training position by inverting the integral.

A null text counts 0 words, and documents without words are never taken.  A
null source is a source of its own and comes last.  Repeated rows are separate
documents; equal ids are ordered by size.  Sources are few (the mixture's
components): one row per source passes through one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plangauge.llm.common import WORD

MAX_PASSES = 3
SLOPES = (0.6, 0.0, -0.6)


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str) -> Column:
    """Order of documents within a source: md5 of the id as text."""
    return F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), passes: int = MAX_PASSES) -> DataFrame:
    """source, rank, source_size, target of every source.

    Shares by weight, held at ``passes`` times the source, the excess reshared by weight until none is above:
    there is one level such that a source gets ``min(passes * size, level * weight)``.  Sources sorted by
    ``size / weight`` are held up to the first whose limit is above the level of those that remain.
    """
    every = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(every) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * passes)
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    everything = W.partitionBy()
    total = F.sum("source_size").over(everything)
    held = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weights_left = F.sum("weight").over(by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing))
    leveled = ranked.withColumn("level", (total - held) / weights_left)
    open_ = F.col("limit") / F.col("weight") >= F.col("level")
    leveled = leveled.withColumn("final", F.min(F.when(open_, F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(everything)["level"])
    target = F.least(F.col("limit").cast("double"), F.col("final") * F.col("weight"))
    return leveled.select("source", "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _invert(u: Column, slope: Column) -> Column:
    """t with ``t + slope * (t^2 - t) = u`` for slopes in [-1, 1]."""
    half = 1 - slope
    return F.when(F.abs(slope) < 1e-9, u).otherwise((-half + F.sqrt(half * half + 4 * slope * u)) / (2 * slope))


def mix(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", cycle: tuple[int, ...] = (1, 2, 3),
    slopes: tuple[float, ...] = SLOPES, passes: int = MAX_PASSES, order_digits: int = 3, size: Column | None = None,
) -> DataFrame:
    """Columns of ``df`` plus (or, if there is one, with a new) struct ``mix`` (size, source_size, target, taken, plays).

    ``plays`` lists each use of the document: ``position`` in [0, 1) and ``words`` taken.  Only the last
    document of a source is cut short.  The running size within a source is found in two steps, totals by the
    first ``order_digits`` hex digits of the drawn order, then inside each such piece, so a hot source
    is spread over ``16 ** order_digits`` pieces.  ``size`` gives the words of a document, so that rows can be mixed
    without their texts.
    """
    sized = n_words(text) if size is None else size.cast("long")
    carried = [F.col(f"`{c}`") for c in df.columns if c != "mix"]
    whole = df.select(F.struct(*carried).alias("row"), sized.alias("size"), F.col(f"`{source}`").alias("source"), draw(id_col).alias("draw"))
    whole = whole.withColumn("piece", F.substring("draw", 1, order_digits))
    pieces = whole.groupBy("source", "piece").agg(F.sum("size").alias("piece_size"))
    before = W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = pieces.withColumn("piece_start", F.coalesce(F.sum("piece_size").over(before), F.lit(0)))
    targets = source_targets(pieces.groupBy("source").agg(F.sum("piece_size").alias("source_size")), cycle, passes)
    targets = targets.withColumnRenamed("source", "of_source")
    pieces = pieces.withColumnRenamed("piece", "of_piece")
    places = pieces.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).select("of_source", "of_piece", "piece_start", "source_size", "target", "rank")
    inside = W.partitionBy("source", "piece").orderBy("draw", "size").rowsBetween(W.unboundedPreceding, -1)
    run = whole.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    run = run.join(places, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("piece") == F.col("of_piece")))
    wanted = F.round("target").cast("long")
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    run = run.withColumn("at", F.col("before") + F.col("piece_start")).withColumn("wanted", wanted).withColumn("slope", slope)

    def play(k: Column) -> Column:
        start = F.col("at") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("wanted") - start))
        return F.struct(_invert(F.try_divide(start, F.col("wanted")), F.col("slope")).alias("position"), words.cast("long").alias("words"))

    plays = F.filter(F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), play), lambda p: p["words"] > 0)
    run = run.withColumn("plays", plays)
    taken = F.aggregate("plays", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    mixed = F.struct("size", "source_size", "target", taken.alias("taken"), "plays")
    return run.select("row.*", mixed.alias("mix"))


def in_training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per use of a document, range-sorted by training position; adds ``position`` and ``words``, in place of columns of these names.

    A use cut to less than half of its document is left out, any other is whole.
    """
    own = [c for c in mixed.columns if c not in ("mix", "position", "words")]
    plays = mixed.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col("mix.size").alias("size"), F.explode("mix.plays").alias("play"))
    rows = plays.filter(2 * F.col("play.words") >= F.col("size")).select("row.*", F.col("play.position").alias("position"), F.col("size").alias("words"))
    ranged = rows.repartitionByRange(partitions, "position") if partitions else rows.repartitionByRange("position")
    return ranged.sortWithinPartitions("position")
