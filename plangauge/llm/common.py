"""Shared pieces: word splitting, folds, Arrow batches and tables in the shared folder."""

from __future__ import annotations

import gc
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.session import new_work_dir

# Fixed value: a word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` splits at exactly the six characters outside :data:`WORD`."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def fold(doc_id, parts: int) -> int:
    """crc32 of the id as text, modulo ``parts``."""
    return zlib.crc32(str(doc_id).encode()) % parts


def fold_column(doc_id: str, parts: int) -> Column:
    """:func:`fold` as a column; null ids count as fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Kept:
    """A table written to the shared folder and read back: lineage ends there and lost executors cost nothing."""

    def __init__(self, df: DataFrame, purpose: str):
        self.spark, self.path = df.sparkSession, new_work_dir(df.sparkSession, purpose)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        release(self.spark)

    def drop(self) -> None:
        """Delete the table, once everything made from it is kept itself."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """A :class:`Kept` table that stays."""
    return Kept(df, purpose).df


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[..., Iterable[tuple]]], slice_rows: int = 512) -> DataFrame:
    """Rows to rows in Arrow batches.

    ``make()`` runs once per task and gives a function that takes the columns of
    a small slice as lists and yields output tuples, in the order of ``schema``.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                part = batch.slice(at, slice_rows)
                out = list(work(*[part.column(i).to_pylist() for i in range(len(names))]))
                if out:
                    columns = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types)], names=fields)

    from pyspark.sql.pandas.types import to_arrow_schema

    target = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(target)
    fields, types = arrow.names, arrow.types
    return df.mapInArrow(run, target)


class WordHashes(dict):
    """64-bit hash of each word, remembered for the words of one task up to ``limit`` of them."""

    limit = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
