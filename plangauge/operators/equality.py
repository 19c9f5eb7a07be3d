"""Result equality without collecting results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plangauge.session import cut_lineage


def row_digest(columns: list[Column]) -> Column:
    """MD5 of the values as text."""
    return F.md5(row_text(columns))


def row_text(columns: list[Column]) -> Column:
    """The values as one text; nulls and empty text differ, and neighbours cannot run together."""
    rendered = []
    for column in columns:
        text = column.cast("string")
        rendered.append(F.when(column.isNull(), F.lit("~")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text)))
    return F.concat_ws("|", *rendered)


def _digest_of(df: DataFrame) -> Column:
    return row_digest(_comparable(df))


def _comparable(df: DataFrame) -> list[Column]:
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            column = F.to_json(column)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.when(column == 0, F.lit(0.0)).otherwise(column)  # -0.0 and 0.0 are the same value
        columns.append(column)
    return columns


def _halves(digest: Column) -> list[Column]:
    # 15 hex digits are 60 bits: about 10^19 rows fit the decimal sum
    return [F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(20,0)") for start in (1, 16)]


def _aggregate(rows: DataFrame, digest: str = "_digest") -> DataFrame:
    first, second = _halves(F.col(digest))
    zero = F.lit(0).cast("decimal(38,0)")
    return rows.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(first).cast("decimal(38,0)"), zero).alias("sum_a"),
        F.coalesce(F.sum(second).cast("decimal(38,0)"), zero).alias("sum_b"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (row_count, sum_a, sum_b): equal for equal multisets of rows, in any order.

    Sums, not exclusive-or: a pair of equal rows must not cancel out.
    """
    return _aggregate(df.select(_digest_of(df).alias("_digest")))


def ordered_fingerprint(df: DataFrame, order: list[Column]) -> DataFrame:
    """As :func:`fingerprint`, but every row also carries its position in the given order.

    The sort is a distributed range sort; positions come from the row number
    inside each partition plus the sizes of the partitions before it.  Ties are
    put in digest order.  The sorted digests are checkpointed because they are
    read twice and both reads must see the same partitions.
    """
    keyed = df.withColumn("_digest", _digest_of(df))
    ranked = keyed.orderBy(*order, "_digest").select("_digest", F.monotonically_increasing_id().alias("_id"))
    fixed = cut_lineage(ranked).select(
        "_digest", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_index")
    )
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))  # one row per partition
    starts = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start")
    )
    placed = fixed.join(F.broadcast(starts), "_part")
    position = (F.col("_start") + F.col("_index")).cast("string")
    return _aggregate(placed.select(F.md5(F.concat_ws("|", position, F.col("_digest"))).alias("_digest")))


def _same_columns(a: DataFrame, b: DataFrame) -> None:
    left = [(f.name, f.dataType) for f in a.schema.fields]
    right = [(f.name, f.dataType) for f in b.schema.fields]
    if left != right:
        raise ValueError(f"schemas differ: {left} and {right}")


def compare_fingerprints(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row from two one-row fingerprints: counts of both sides and whether they agree."""
    both = a.withColumn("_side", F.lit("a")).unionByName(b.withColumn("_side", F.lit("b")))

    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(name)))

    agree = [of("a", n).eqNullSafe(of("b", n)) for n in ("row_count", "sum_a", "sum_b")]
    return both.agg(
        of("a", "row_count").alias("rows_before"),
        of("b", "row_count").alias("rows_after"),
        (agree[0] & agree[1] & agree[2]).alias("same_result"),
    )


def same_result(a: DataFrame, b: DataFrame) -> DataFrame:
    """Do two queries return the same multiset of rows? (rows_before, rows_after, same_result)"""
    _same_columns(a, b)
    return compare_fingerprints(fingerprint(a), fingerprint(b))


def changed_results(attempts: DataFrame, baselines: DataFrame, key: list[str]) -> DataFrame:
    """Mark logged attempts whose result hash differs from the hash of their episode.

    Every attempt stays: one without a baseline has ``has_baseline`` false and ``result_changed`` null.
    """
    known = baselines.select(*key, "base_hash", F.lit(True).alias("has_baseline"))
    joined = attempts.join(known, key, "left").withColumn("has_baseline", F.coalesce("has_baseline", F.lit(False)))
    differs = ~F.col("new_hash").eqNullSafe(F.col("base_hash"))
    return joined.withColumn("result_changed", F.when(F.col("has_baseline"), differs))


def differing_rows(a: DataFrame, b: DataFrame, n: int | None = 5) -> DataFrame:
    """Rows of one side that the other lacks, by multiplicity; at most ``n`` shown per side (None: all)."""
    _same_columns(a, b)

    def side(name: str, rows: DataFrame) -> DataFrame:
        shown = rows if n is None else rows.orderBy(*rows.columns).limit(n)
        return shown.withColumn("side", F.lit(name))

    return side("only_before", a.exceptAll(b)).unionByName(side("only_after", b.exceptAll(a)))


# The sketch of a difference: an invertible Bloom lookup table ------------------------

PARTS = 4
PART_BITS = 31
TABLES = 3
CELLS = 8192
PRIME = (1 << PART_BITS) - 1


def _parts(df: DataFrame) -> list[Column]:
    """Four numbers of 31 bits from two hashes of a row's text."""
    text = row_text(_comparable(df))
    hashes = [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]
    return [F.shiftrightunsigned(h, by).bitwiseAND(F.lit(PRIME)).alias(f"_p{2 * k + i}") for k, h in enumerate(hashes) for i, by in enumerate((0, 32))]


def _check(parts: list) -> object:
    """Not linear in the parts, so that sums of several rows do not look like one row; the same for columns and numbers."""
    return (parts[0] * parts[1]) % PRIME


def difference_sketch(a: DataFrame, b: DataFrame, cells: int = CELLS) -> DataFrame:
    """cell, n, p0 .. p3, check: sums over rows of ``a`` less sums over rows of ``b``, where they are not all zero.

    A row falls into one cell of each of three tables.  Sums are formed map-side, so a task sends at most ``3 * cells`` rows,
    however many it reads; equal rows of both sides cancel out, whatever their order or number.
    """
    names = [f"_p{k}" for k in range(PARTS)]

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*_parts(df)).withColumn("_check", _check([F.col(n) for n in names])).withColumn("_n", F.lit(sign).cast("long"))

    both = signed(a, 1).unionByName(signed(b, -1))
    places = F.explode(F.array(*[F.pmod(F.col(f"_p{k}"), F.lit(cells)) + k * cells for k in range(TABLES)]))
    sums = {"n": F.col("_n")} | {f"p{k}": F.col(f"_p{k}") * F.col("_n") for k in range(PARTS)} | {"check": F.col("_check") * F.col("_n")}
    summed = both.select(*names, "_check", "_n", places.alias("cell")).groupBy("cell").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return summed.filter(" or ".join(f"{n} <> 0" for n in sums))


def peel(cells_found: dict[int, list[int]], cells: int = CELLS) -> dict[tuple[int, ...], int] | None:
    """The rows of a difference by their parts, with how often one side has them more; None if the sketch is too full to tell.

    A cell that holds one kind of row names it: its sums are multiples of that row's numbers.  Taking the row out of its other
    cells leaves more such cells.
    """
    left, found = {c: list(v) for c, v in cells_found.items()}, {}
    waiting = list(left)
    while waiting:
        at = waiting.pop()
        n, *sums = left.get(at, [0])
        if not n or any(s % n for s in sums):
            continue
        *parts, check = [s // n for s in sums]
        if not all(0 <= p <= PRIME for p in parts) or _check(parts) != check or parts[at // cells] % cells != at % cells:
            continue
        found[tuple(parts)] = found.get(tuple(parts), 0) + n
        for k in range(TABLES):
            cell = k * cells + parts[k] % cells
            rest = [x - y for x, y in zip(left.get(cell, [0] * (PARTS + 2)), [n, *(n * p for p in parts), n * check])]
            if any(rest):
                left[cell] = rest
                waiting.append(cell)
            else:
                left.pop(cell, None)
        if len(found) > TABLES * cells:
            return None
    return None if left else {p: n for p, n in found.items() if n}


def few_differing_rows(a: DataFrame, b: DataFrame, n: int | None = 5, cells: int = CELLS) -> DataFrame:
    """As :func:`differing_rows`, for large results that hardly differ: neither side is shuffled.

    A sketch of bounded size tells which rows differ, a second read fetches only those, and these are compared exactly.  Up to
    about ``2.4 * cells`` different rows can be told; where more differ, both sides are compared in whole.  Runs one job while the query is built.
    """
    _same_columns(a, b)
    rows = difference_sketch(a, b, cells).collect()  # at most three times ``cells``
    told = peel({r["cell"]: [r["n"], *(r[f"p{k}"] for k in range(PARTS)), r["check"]] for r in rows}, cells)
    if told is None:
        return differing_rows(a, b, n)
    wanted = a.sparkSession.createDataFrame(list(told), ", ".join(f"_p{k} long" for k in range(PARTS)))

    def fetch(df: DataFrame) -> DataFrame:
        names = [f"_p{k}" for k in range(PARTS)]
        kept = df.withColumns(dict(zip(names, _parts(df)))).join(F.broadcast(wanted), names, "left_semi")
        return kept.drop(*names)

    return differing_rows(fetch(a), fetch(b), n)


def all_repetitions_match(timings: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per query and variant: does every repetition have the baseline hash of the query?

    Hashes are counted per distinct value before the join, so a query with very
    many repetitions arrives as a handful of rows.
    """
    hashes = timings.groupBy("query_id", "variant", "result_hash").agg(F.count("*").alias("_n"))
    joined = hashes.join(baselines.select("query_id", "base_hash"), "query_id")
    return joined.groupBy("query_id", "variant").agg(
        F.bool_and(F.col("result_hash").eqNullSafe(F.col("base_hash"))).alias("hash_match"), F.sum("_n").alias("repetitions")
    )
