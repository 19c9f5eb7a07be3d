"""Layouts of stored tables: rows of two tables that join lie together, and scans skip what filters on several columns leave out.

*Co-located* tables are bucketed and sorted by the join key.  Two of them with the same number of buckets join bucket by bucket: no row is
shuffled, in any query, however often it runs.  *Z-ordered* tables are sorted along a curve that takes the leading bits of several
columns in turn, so every file and row group covers a narrow range of each of them and not of the first alone; the Parquet statistics
then let a scan skip row groups by a filter on any of the columns.

Writing costs one shuffle; both pay for tables that are read often.  Tables go to the warehouse or to a folder that is named, never to a local one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64
BITS = 16
ROWS_A_FILE = 5_000_000


def write_colocated(df: DataFrame, table: str, key: str, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Save as a bucketed, sorted table and read it back.  One file for each bucket, so a hot key makes one large file; its rows stay splittable in scans without a join."""
    dealt = df.repartition(buckets, key).sortWithinPartitions(key)
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


@dataclass(frozen=True)
class Scale:
    """The range of a column, for its place among ``2 ** BITS`` equal steps."""

    column: str
    low: float
    high: float


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    raise TypeError(f"{name}: dates, times and numbers can be ordered along a curve, {kind.simpleString()} cannot")


def scales(df: DataFrame, columns: list[str]) -> list[Scale]:
    """Ranges of the columns, from one pass that gives one row."""
    row = df.agg(*[f(_number(df, c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("low", F.min), ("high", F.max))]).first()
    return [Scale(c, row[f"low{i}"] or 0.0, row[f"high{i}"] or 0.0) for i, c in enumerate(columns)]


def curve_position(df: DataFrame, ranges: list[Scale], bits: int = BITS) -> Column:
    """Bits of the columns' steps in turn, the leading bit of the first column foremost; nulls count as least."""
    if bits * len(ranges) > 62:
        raise ValueError(f"{len(ranges)} columns of {bits} bits do not fit a long")
    steps = []
    for r in ranges:
        share = (_number(df, r.column) - F.lit(r.low)) / F.lit(max(r.high - r.low, 1e-300))
        steps.append(F.coalesce(F.least(F.lit((1 << bits) - 1), F.greatest(F.lit(0), F.floor(F.nanvl(share, F.lit(1.0)) * (1 << bits)))), F.lit(0)).cast("long"))
    out = F.lit(0).cast("long")
    for k in range(bits - 1, -1, -1):
        for step in steps:
            out = F.shiftleft(out, 1).bitwiseOR(F.shiftright(step, k).bitwiseAND(F.lit(1).cast("long")))
    return out


def write_zordered(df: DataFrame, path: str, columns: list[str], files: int | None = None, row_group_bytes: int | None = None, bits: int = BITS) -> DataFrame:
    """Write to ``path`` along the curve of ``columns`` and read back.

    ``files`` follows the rows unless given; ``row_group_bytes`` sets how finely a file can be skipped.  Ties, and equal positions of a
    hot value, are dealt over files by a hash of the row, so no file holds more than its share.
    """
    placed = df.withColumn("_curve", curve_position(df, scales(df, columns), bits)).withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    files = files or max(1, -(-df.count() // ROWS_A_FILE))
    ordered = placed.repartitionByRange(files, "_curve", "_tie").sortWithinPartitions("_curve").drop("_curve", "_tie")
    writer = ordered.write.mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.block.size.row.check.min", 100)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
