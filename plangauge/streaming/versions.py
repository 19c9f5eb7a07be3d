"""Rows versioned by micro-batch, with compaction: a reader meets one snapshot and the batches behind it.

A folder holds ``data/batch=N``, the rows that batch N changed; ``snapshots/S``, the newest row of every key up to some batch; and
``manifests/N``, one small file for each snapshot in use, whose highest number counts.  Compaction writes a snapshot, then its
manifest, which is moved into place under its final name and so is there wholly or not at all.  Only then are batches and snapshots
deleted that no manifest but older ones needs; the one before the newest stays, for readers that have begun.  A job that dies between any
two of these steps leaves a folder that reads the same, and a later compaction takes the rest away.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEEP = 2


class Folder:
    """Files of one versioned output, in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str) -> list[str]:
        place = self._at(name)
        return [s.getPath().getName() for s in self._files.listStatus(place)] if self._files.exists(place) else []

    def _done(self, name: str) -> bool:
        return self._files.exists(self._at(f"{name}/_SUCCESS"))

    def batches(self) -> list[int]:
        """Batches that were written to the end."""
        numbers = [int(n.removeprefix("batch=")) for n in self._names("data") if n.startswith("batch=")]
        return sorted(n for n in numbers if self._done(f"data/batch={n}"))

    def manifests(self) -> list[int]:
        return sorted(int(n) for n in self._names("manifests") if n.isdigit())

    def _manifest(self, number: int) -> dict:
        stream = self._files.open(self._at(f"manifests/{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> dict | None:
        """The snapshot in use: its name, and the last batch that is in it."""
        numbers = self.manifests()
        return self._manifest(numbers[-1]) if numbers else None

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Rows that a batch changed; a retry replaces its own, and one that a snapshot holds is not written again."""
        known = self.newest()
        if known is None or batch_id > known["upto"]:
            batch.write.mode("overwrite").parquet(f"{self.path}/data/batch={batch_id}")

    def live(self) -> tuple[dict | None, list[int]]:
        """What a reader needs: the snapshot in use and the batches behind it."""
        known = self.newest()
        return known, [n for n in self.batches() if known is None or n > known["upto"]]

    def rows(self, schema: T.StructType | None = None) -> DataFrame | None:
        """All live rows with the batch they come from; those of a snapshot come from the batch that it reaches to."""
        known, open_batches = self.live()
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        parts = [reader.parquet(f"{self.path}/data/batch={n}").withColumn("batch", F.lit(n)) for n in open_batches]
        if known:
            parts.insert(0, reader.parquet(f"{self.path}/snapshots/{known['snapshot']}").withColumn("batch", F.lit(known["upto"])))
        if not parts:
            return None
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def latest(self, keys: list[str], schema: T.StructType | None = None) -> DataFrame:
        """The newest row of every key."""
        rows = self.rows(schema)
        if rows is None:
            if schema is None:
                raise ValueError(f"nothing was written to {self.path} yet, and no schema is given")
            return self.spark.createDataFrame([], schema)
        values = [c for c in rows.columns if c not in keys and c != "batch"]
        newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        return newest.select(*keys, "_v.*")

    def compact(self, keys: list[str]) -> bool:
        """Put all live rows into one snapshot and switch to it; False if there is nothing to put together."""
        known, open_batches = self.live()
        if not open_batches:
            return False
        name, upto = f"{open_batches[-1]}-{uuid.uuid4().hex}", open_batches[-1]
        self.latest(keys).write.parquet(f"{self.path}/snapshots/{name}")
        self._switch(upto, name)
        self.clean()
        return True

    def _switch(self, upto: int, snapshot: str) -> None:
        draft = self._at(f"manifests/draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps({"upto": upto, "snapshot": snapshot}).encode()))
        stream.close()
        if not self._files.rename(draft, self._at(f"manifests/{upto}")):
            raise OSError(f"manifest {upto} of {self.path} is there already")

    def clean(self, keep: int = KEEP) -> None:
        """Delete what only manifests before the last ``keep`` need, and what no manifest names."""
        numbers = self.manifests()
        if not numbers:
            return
        needed = [self._manifest(n) for n in numbers[-keep:]]
        # readers of the oldest manifest that stays need the batches behind it
        first = needed[0]["upto"] if len(numbers) >= keep else -1
        gone = [f"data/batch={n}" for n in self.batches() if n <= first]
        gone += [f"snapshots/{n}" for n in self._names("snapshots") if n not in {m["snapshot"] for m in needed}]
        gone += [f"manifests/{n}" for n in numbers[:-keep]] + [f"manifests/{n}" for n in self._names("manifests") if n.startswith("draft-")]
        for name in gone:
            self._files.delete(self._at(name), True)

    def forget(self, folder: str, before: int) -> None:
        """Delete numbered sub-folders ``batch=N`` with N below ``before``."""
        for name in self._names(folder):
            if name.startswith("batch=") and int(name.removeprefix("batch=")) < before:
                self._files.delete(self._at(f"{folder}/{name}"), True)

    def last(self, folder: str) -> int | None:
        """The highest N of sub-folders ``batch=N`` that were written to the end."""
        numbers = [int(n.removeprefix("batch=")) for n in self._names(folder) if n.startswith("batch=")]
        return max((n for n in numbers if self._done(f"{folder}/batch={n}")), default=None)
