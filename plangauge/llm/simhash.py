"""Near-duplicate components by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has a bit for each bit of a shingle's 64-bit hash: 1 if it is set in over half the shingles.
Two fingerprints link if they differ in at most ``radius`` bits; components are what links connect.

Covering hashing: bit position i gets a vector of ``radius + 1`` bits, and every vector v other than zero gives a mask, the
positions whose vector has an odd product with v.  The vectors of ``radius`` differing positions do not span the whole space, so
some v is orthogonal to all of them: its mask leaves out every differing bit, and the pair is equal under it.  Every pair within the
radius therefore meets in one of the ``2 ** (radius + 1) - 1`` tables; nothing depends on luck.

Equal fingerprints are one node, so exact copies cost nothing.  A bucket of more than ``limit`` nodes is split by masks over
the bits that its own mask leaves free, which halve at each round; the same argument holds inside a bucket, so no pair is lost, and
rows grow by a constant factor.  Buckets within the limit are compared in one task, which gives a spanning forest and not the pairs.

Nulls, empty texts and texts without words have the fingerprint zero, which links like any other.  Texts of any length are hashed
whole, shingle by shingle.  Rows that share an id, or are equal, give a row each; an id that is null never names a component unless all ids
of it are null, which gives null.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plangauge.llm.common import Kept, keep, map_rows
from plangauge.llm.near_copies import components

BITS = 64
SHINGLE = 4
SEED = 42
RADIUS = 4
LIMIT = 4096


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 values of the shingles, repeats included."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(tokens) - size + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), (ends[len(ends) - n :] - 1).tolist())
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype="<u8", count=n)
    return int(sum(1 << k for k in np.flatnonzero(2 * set_bits(hashes) > n).tolist()))


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def set_bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, from a histogram of each of their bytes."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    return np.concatenate([np.bincount(columns[:, k], minlength=256) @ BYTE_BITS for k in range(8)])


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def covering_masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """Masks over the bit positions ``free``; any ``radius`` of these are all outside one of the masks.

    Positions take the vectors other than zero in turn, so each mask holds about half of them.
    """
    vectors = (1 << (radius + 1)) - 1
    of_position = {p: k % vectors + 1 for k, p in enumerate(free)}
    return [sum(1 << p for p, v in of_position.items() if (v & w).bit_count() % 2) for w in range(1, vectors + 1)]


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with each covering mask of the bits it leaves out."""
    free = [p for p in range(BITS) if not mask >> p & 1]
    return sorted({mask | extra for extra in covering_masks(free, radius)})


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect what differences of up to ``radius`` bits connect: each node once, with the node it was reached from."""
    left, out = np.sort(fps), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                reached = left[near]
                left = left[~near]
                out += [(int(at), int(x)) for x in reached]
                queue += list(reached)
    return out


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (a long with the 64 bits) of every row."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def make():
        def work(ids, texts):
            return zip(ids, [signed(fingerprint(t)) for t in texts])

        return work

    return map_rows(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long", make)


def _compare(rows: DataFrame, radius: int) -> DataFrame:
    """a, b: forests of the buckets of ``rows(mask, key, fp)``; each bucket lies in one task and is of bounded size."""
    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(columns: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((columns[:2, 1:] != columns[:2, :-1]).any(axis=0)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [columns.shape[1]]])
            fps, sizes = columns[2].view(np.uint64), ends - begins
            two = begins[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= radius]
            found = [(int(a), int(b)) for a, b in zip(fps[two], fps[two + 1])]
            for a, b in zip(begins[sizes > 2].tolist(), ends[sizes > 2].tolist()):
                found += forest(fps[a:b], radius)
            pairs = np.array(found, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        held = np.empty((3, 0), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.vstack([c.to_numpy(zero_copy_only=False) for c in batch.columns])], axis=1)
            last = np.flatnonzero((held[:2] != held[:2, -1:]).any(axis=0))
            if len(last):  # the bucket of the last row may go on
                yield links(held[:, : last[-1] + 1])
                held = held[:, last[-1] + 1 :]
        if held.shape[1]:
            yield links(held)

    return spread.select("mask", "key", "fp").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """a, b: links between different fingerprints ``nodes(fp)`` that connect all that are within the radius of each other."""
    spark: SparkSession = nodes.sparkSession
    masks = sorted(set(covering_masks(list(range(BITS)), radius)))
    rows = nodes.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    parts: list[DataFrame] = []
    while True:
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = keep(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
        within = rows.join(sizes.filter(F.col("n") <= limit).drop("n"), ["mask", "key"])
        parts.append(keep(_compare(within, radius), "bucket-links"))
        large = sizes.filter(F.col("n") > limit)
        # masks of buckets beyond the limit: at most all masks of this round, whatever the data
        hot = [r["mask"] for r in large.select("mask").distinct().collect()]
        if not hot:
            break
        finer = [(m, [signed(x) for x in finer_masks(m % (1 << BITS), radius)]) for m in hot]
        of_mask = spark.createDataFrame(finer, "mask long, finer array<long>")
        inside = rows.join(large.drop("n"), ["mask", "key"])
        rows = keep(inside.join(of_mask, "mask").select("fp", F.explode("finer").alias("mask")).distinct(), "finer-rows")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def near_components(df: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = RADIUS, limit: int = LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least id of the component) of every row."""
    found = keep(fingerprints(df, id_col, text), "fingerprints")
    nodes = keep(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    labels = keep(components(keep(links(nodes.select("fp"), radius, limit), "links")), "fingerprint-classes")
    led = nodes.join(labels, F.col("fp") == F.col("node")).groupBy("label").agg(F.min("first").alias("least"))
    named = labels.join(led, "label").select(F.col("node").alias("fp"), "least")
    whole = nodes.join(named, "fp", "left").select("fp", F.when(F.col("least").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"))
    return found.join(whole, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
