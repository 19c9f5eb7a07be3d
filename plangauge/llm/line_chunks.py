"""Line dedup by content-defined chunks of lines, in DataFrame functions only.

A hash rolls over the hashes of three lines and closes a chunk where it is 0
modulo ``modulus``; equal passages are therefore cut alike wherever they stand.  A
chunk of two or more lines that occurs elsewhere is removed, except at its first
place (smallest id, then first line), once its bytes are found equal to those of the first.

Nulls and empty texts have no lines that can be removed and come back as they
are.  Rows with a null id sort first.  Rows that share an id are told apart by the
hash of their text; rows equal in both are one place and come back alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import keep

ROLL = 3
MODULUS = 3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, even when used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunk_starts(hashes: Column, modulus: int = MODULUS) -> Column:
    """Index (from 0) of the first line of each chunk."""

    def closes(i: Column) -> Column:  # line i (from 0) ends a chunk
        rolled = sum((F.coalesce(F.get(hashes, i - back), F.lit(0)) * (31**back) for back in range(ROLL)), F.lit(0))
        return F.pmod(rolled, F.lit(modulus)) == 0

    later = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: (i > 0) & closes(i - 1))
    return F.concat(F.array(F.lit(0)), later)


def chunks(text: str, modulus: int = MODULUS) -> Column:
    """Array of struct(n_lines, body); lines joined by line feeds give the text back."""

    def cut(lines: Column) -> Column:
        def over(starts: Column) -> Column:
            ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(lines)))
            return F.transform(
                F.arrays_zip(starts.alias("a"), ends.alias("b")),
                lambda s: F.struct((s["b"] - s["a"]).alias("n_lines"), F.array_join(F.slice(lines, s["a"] + 1, s["b"] - s["a"]), "\n").alias("body")),
            )

        return let(let(F.transform(lines, line_hash), lambda h: chunk_starts(h, modulus)), over)

    return let(F.split(F.col(text), "\n"), cut)


def repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = MODULUS, min_lines: int = 2) -> DataFrame:
    """Chunks to remove: doc_id, text_hash, chunk (index from 0), n_lines.

    Hashes are counted first (combined before the shuffle); bodies are shuffled once to meet the hashes
    that occur at two places or more, and compared with the body at the first place.
    """
    parts = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(chunks(text, modulus)).alias("chunk", "part"))
    parts = parts.filter(F.col("part.n_lines") >= min_lines)
    place = F.struct("doc_id", "text_hash", "chunk").alias("place")
    parts = parts.select(place, F.col("part.n_lines").alias("n_lines"), F.xxhash64("part.body").alias("hash"), F.col("part.body").alias("body"))
    counts = parts.groupBy("hash").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    counts = counts.filter(~F.col("first").eqNullSafe(F.col("last"))).select("hash", "first")
    counts = keep(counts, "repeated-chunks")  # a stored side lets adaptive execution split a hot hash of the other
    found = keep(parts.join(counts.hint("merge"), "hash"), "line-chunks")
    is_first = F.col("place").eqNullSafe(F.col("first"))
    firsts = keep(found.filter(is_first).groupBy("hash").agg(F.max("body").alias("first_body")), "first-chunks")
    others = found.filter(~is_first).join(firsts.hint("merge"), "hash").filter(F.col("body") == F.col("first_body"))
    return others.select("place.*", "n_lines")


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text: str = "text", modulus: int = MODULUS, min_lines: int = 2) -> DataFrame:
    """Columns of ``df`` plus a struct ``line_chunks`` (n_lines, n_removed, text without the removed chunks)."""
    gone = repeated(df, id_col, text, modulus, min_lines)
    gone = gone.distinct().groupBy("doc_id", "text_hash").agg(F.collect_set("chunk").alias("gone"), F.sum("n_lines").alias("n_removed"))
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "line_chunks"]).alias("row"))
    row_id, row_text = F.col(f"row.`{id_col}`"), F.col(f"row.`{text}`")
    own = own.withColumn("own_hash", F.xxhash64(row_text))
    joined = own.join(gone.hint("merge"), row_id.eqNullSafe(F.col("doc_id")) & (F.col("own_hash") == F.col("text_hash")), "left")

    def kept(parts: Column) -> Column:
        left = F.filter(parts, lambda part, i: ~F.array_contains("gone", i))
        return F.array_join(F.transform(left, lambda part: part["body"]), "\n")

    rest = F.when(F.col("gone").isNull(), row_text).otherwise(let(chunks(f"row.`{text}`", modulus), kept))
    done = F.struct(
        F.coalesce(F.size(F.split(row_text, "\n")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        rest.alias("text"),
    )
    return joined.select("row.*", done.alias("line_chunks"))
