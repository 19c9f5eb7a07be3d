"""Building blocks that keep one hot key from landing in one task.

Windows partitioned by a key put the whole key in one task.  The helpers here
cut a key into bounded pieces first and stitch the pieces with small totals.
Key columns must not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DEFAULT_SALTS = 32
DEFAULT_SPAN = 1_000_000

# Histograms in which a median is looked for: bins of each key, and how often the middle bin is divided again.
BINS = 1024
ROUNDS = 2


def top_n_per_key(
    df: DataFrame, keys: list[str], order: list[Column], n: int, salt_by: list[str], salts: int = DEFAULT_SALTS
) -> DataFrame:
    """First ``n`` rows of each key, numbered from 1 in ``_rank``.

    Three stages: per (key, fine salt), per (key, coarse salt), per key; a coarse salt unites ``salts``
    fine ones.  Spark also limits each group before every shuffle (WindowGroupLimit; the session allows
    it for large ``n``, see :mod:`plangauge.session`), so a task of the later stages sees at most
    ``salts * n`` rows of a key.
    """
    fine = F.pmod(F.xxhash64(*salt_by), F.lit(salts * salts))
    some = df.withColumn("_fine", fine).withColumn("_coarse", F.pmod(F.col("_fine"), F.lit(salts)))
    for group in ([*keys, "_coarse", "_fine"], [*keys, "_coarse"], keys):
        place = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        some = some.withColumn("_rank", place).filter(F.col("_rank") <= n)
    return some.drop("_fine", "_coarse")


def with_prefix(
    df: DataFrame, keys: list[str], order: str, sums: dict[str, Column], span: int = DEFAULT_SPAN
) -> DataFrame:
    """Add running totals per key, in order of a unique integer column.

    ``sums`` maps a new column to the expression that is totalled up to and
    including the row.  A chunk covers ``span`` values of the order column, so it holds at most ``span``
    rows of a key; a region covers ``DEFAULT_SPAN`` chunks.  Chunk totals are map-side combined, and
    their running totals are taken per region, so however sparse the values are, no window sees more
    than ``DEFAULT_SPAN`` chunks of a key, or more regions than 64-bit numbers have.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(span)).cast("long"))
    region = F.floor(F.col("_chunk") / F.lit(DEFAULT_SPAN)).cast("long")
    totals = chunked.groupBy(*keys, "_chunk").agg(*[F.sum(e).alias(f"_t_{n}") for n, e in sums.items()])
    totals = totals.withColumn("_region", region)

    def earlier(rows: DataFrame, within: list[str], by: str, mark: str) -> DataFrame:
        before = W.partitionBy(*within).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        running = [F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"{mark}{n}") for n in sums]
        return rows.select(*keys, *dict.fromkeys([by, "_region"]), *running)

    regions = totals.groupBy(*keys, "_region").agg(*[F.sum(f"_t_{n}").alias(f"_t_{n}") for n in sums])
    starts = earlier(totals, [*keys, "_region"], "_chunk", "_o_").join(earlier(regions, keys, "_region", "_r_"), [*keys, "_region"])
    inside = W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    joined = chunked.join(starts.drop("_region"), [*keys, "_chunk"])
    for name, expression in sums.items():
        total = F.col(f"_r_{name}") + F.col(f"_o_{name}") + F.coalesce(F.sum(expression).over(inside), F.lit(0))
        joined = joined.withColumn(name, total)
    return joined.drop("_chunk", *[f"{mark}{n}" for n in sums for mark in ("_o_", "_r_")])


def with_position(df: DataFrame, keys: list[str], order: str, name: str = "_pos", span: int = DEFAULT_SPAN) -> DataFrame:
    """Dense position per key, from 1, in order of a unique integer column."""
    return with_prefix(df, keys, order, {name: F.lit(1).cast("long")}, span)


def rolling(
    positioned: DataFrame, keys: list[str], width: int, outputs: dict[str, Column], pos: str = "_pos", block: int | None = None
) -> DataFrame:
    """Aggregates over the last ``width`` rows of a key, row by row.

    Rows are cut into blocks of ``block`` positions; the last ``width - 1`` rows
    of a block are also sent to the next block as context and dropped after use.
    """
    block = max(block or DEFAULT_SPAN, width)
    index = F.col(pos) - 1
    home = F.floor(index / F.lit(block)).cast("long")
    edge = F.pmod(index, F.lit(block)) >= block - (width - 1)
    places = F.when(
        edge,
        F.array(F.struct(home.alias("b"), F.lit(False).alias("h")), F.struct((home + 1).alias("b"), F.lit(True).alias("h"))),
    ).otherwise(F.array(F.struct(home.alias("b"), F.lit(False).alias("h"))))
    spread = positioned.withColumn("_place", F.explode(places))
    spread = spread.withColumn("_block", F.col("_place.b")).withColumn("_halo", F.col("_place.h")).drop("_place")
    frame = W.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(-(width - 1), 0)
    spread = spread.withColumns({name: expression.over(frame) for name, expression in outputs.items()})
    return spread.filter(~F.col("_halo")).drop("_block", "_halo")


def _with_ranges(counts: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The counts that lie within the range of their key.

    The ranges, one row a key, are first dealt by more than the key.  The join then shuffles both sides itself, which ends the stage that
    made the ranges, and only a join that reads two shuffles can divide the counts of a hot key among tasks.
    """
    return counts.join(ranges.repartition(*keys, "_low"), keys).filter(F.col("_v").between(F.col("_low"), F.col("_high")))


def _narrowed(counts: DataFrame, ranges: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """``ranges`` with the least range around both middle ranks that a histogram of ``bins`` bins shows.

    Bins divide the range of each key by value; what is shuffled for a key, and what the running total over its bins
    sees, is at most ``bins`` rows.  The range ends at values that occur, so it shrinks however unevenly the values lie.
    """
    inside = _with_ranges(counts, ranges, keys)
    share = F.nanvl((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")), F.lit(0.0))
    place = F.when(F.col("_v") >= F.col("_high"), F.lit(bins - 1)).when(F.col("_v") <= F.col("_low"), F.lit(0))
    place = place.otherwise(F.least(F.lit(bins - 1), F.floor(share * bins).cast("int")))
    binned = inside.groupBy(*keys, place.alias("_bin")).agg(
        F.sum("_c").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.max("_a").alias("_a"), F.max("_b").alias("_b")
    )
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    placed = binned.withColumn("_before", upto - F.col("_c"))
    holds = {r: (F.col("_before") <= F.col(r)) & (F.col(r) < F.col("_before") + F.col("_c")) for r in ("_a", "_b")}
    low, high, before = (F.max(F.when(holds[r], F.col(c))) for r, c in (("_a", "_least"), ("_b", "_most"), ("_a", "_before")))
    return placed.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"), (F.max("_a") - before).alias("_a"), (F.max("_b") - before).alias("_b"))


def _dealt(df: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of all rows, dealt over tasks by their whole content.

    A file can be read in parts no smaller than its row groups, and what a task counts before a shuffle grows with them; after this
    one it grows with what a task reads of a shuffle.
    """
    return df.select(*columns, F.xxhash64(*df.columns).alias("_deal")).repartition("_deal").drop("_deal")


def median_candidates(df: DataFrame, keys: list[str], value: str, bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """``keys``, ``_v``, ``_c`` (how often), ``_a`` and ``_b``: the values around the middle, with the middle ranks among them.

    All values are counted once, dealt by key *and* value, so a hot key fills many tasks evenly; rounds of histograms then read these
    counts again, not the rows.  Of a key with n different values about ``n / bins ** rounds`` are left if they
    lie evenly within what is left of the range.  NaN counts as infinity.
    """
    clean = _dealt(df, *map(F.col, keys), F.nanvl(F.col(value).cast("double"), F.lit(float("inf"))).alias("_v")).filter(F.col("_v").isNotNull())
    counts = clean.groupBy(*keys, "_v").agg(F.count("*").alias("_c"))
    n = F.sum("_c")
    ranges = counts.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.floor((n - 1) / 2).alias("_a"), F.floor(n / 2).alias("_b"))
    for _ in range(rounds):
        ranges = _narrowed(counts, ranges, keys, bins)
    return _with_ranges(counts, ranges, keys).drop("_low", "_high")


def exact_median(df: DataFrame, keys: list[str], value: str, *also: Column, bins: int = BINS, rounds: int = ROUNDS) -> DataFrame:
    """Median of ``value`` per key: columns ``keys + [median, n]`` and the aggregates ``also``.

    Selection by distributed histograms (:func:`median_candidates`): one algorithm for keys of every size, no sketch, and
    no task that sees a key whole.  Keys whose values are all null have no median.
    """
    near = median_candidates(df, keys, value, bins, rounds)
    upto = F.sum("_c").over(W.partitionBy(*keys).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    counted = near.withColumn("_upto", upto)
    left, right = (F.min(F.when(F.col("_upto") > F.col(r), F.col("_v"))) for r in ("_a", "_b"))
    middle = counted.groupBy(*keys).agg(((left + right) / 2).alias("median"))
    stats = _dealt(df, *map(F.col, df.columns)).groupBy(*keys).agg(F.count(value).alias("n"), *also)
    return stats.join(middle, keys, "left")
