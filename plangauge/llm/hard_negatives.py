"""Hard negatives of anchors, from exact integer scores by Kronecker-packed products.

A vector's components become ``floor(scale * x)``; a score is the integer inner product with the anchor.  To score many
candidates at once, their components are made non-negative by a bias and laid side by side into fields of one wide integer.  The
packed integer is multiplied once with each (biased) component of the anchor and summed; no field can run over into its neighbour, as its width
is taken from the largest component there is.  The fields are then unpacked and freed of the bias:

    sum (x + e)(a + e) = score + e * sum(x) + e * sum(a) + d * e * e.

Words of 64 bits hold two fields or more while fields need at most 32 bits; wider ones are Python integers of eight fields, so scores are
exact at every magnitude.

The anchors are a stated share of all rows and meet all candidates in blocks: candidates are dealt by a hash of their id, anchors
into blocks of bounded size, and a task has one block of each.  The first pass keeps the best positives of each anchor in every block, the second the best
negatives in the range of each positive; what a task gives is bounded by its anchors, not by its candidates, and the best of all blocks follow by
a grouping.  No threshold, sample or index decides who is scored.

A null id, label or vector, or a null or non-finite component: the row takes no part.  Rows that share an id count as one, that of the
least label, then the least vector.  Ties go to the smaller id.  Vectors are compared with those of their own length; empty vectors score
zero; a score beyond 64 bits is an error.  Anchors without positives, and positives without negatives, give no rows; an empty table gives none.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from plangauge.llm.common import keep

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH, UNIT = 30, 90, 100
CANDIDATES, ANCHORS = 32_768, 4_096
WORD, WIDE_FIELDS, STRIP = 64, 8, 4096


class Packed:
    """Candidates' vectors in fields of wide integers: one row of words for each component."""

    def __init__(self, vectors: np.ndarray, bound: int):
        """``bound`` is at least as large as every component of candidates and anchors, less its sign."""
        self.n, self.width = vectors.shape
        self.bias = int(bound)
        self.field = max(1, (self.width * (2 * self.bias) ** 2).bit_length())
        self.fields = WORD // self.field if self.field <= WORD // 2 else WIDE_FIELDS
        kind = np.uint64 if self.field <= WORD // 2 else object
        words = -(-self.n // self.fields)
        biased = np.zeros((self.width, words * self.fields), dtype=kind)
        biased[:, : self.n] = vectors.T.astype(object) + self.bias if kind is object else (vectors.T + self.bias).astype(kind)
        self.words = np.zeros((self.width, words), dtype=kind)
        for k in range(self.fields):
            self.words |= biased[:, k::self.fields] << kind(k * self.field) if kind is np.uint64 else biased[:, k::self.fields] * (1 << k * self.field)
        self.sums = self._sums(vectors)

    @staticmethod
    def _sums(vectors: np.ndarray) -> np.ndarray:
        return vectors.astype(object).sum(axis=1) if vectors.shape[1] else np.zeros(len(vectors), dtype=object)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products of all candidates with one anchor."""
        if not self.width:
            return np.zeros(self.n, dtype=np.int64)
        small = self.words.dtype == np.uint64
        total = np.zeros(self.words.shape[1], dtype=self.words.dtype)
        for component, packed in zip((anchor.astype(object) + self.bias).tolist(), self.words):
            total += packed * (np.uint64(component) if small else component)
        mask = (1 << self.field) - 1
        out = np.empty(len(total) * self.fields, dtype=np.int64 if small else object)
        for k in range(self.fields):
            out[k :: self.fields] = (total >> np.uint64(k * self.field)) & np.uint64(mask) if small else (total >> k * self.field) & mask
        added = self.bias * int(self._sums(anchor[None, :])[0]) + self.width * self.bias**2
        shift = self.bias * self.sums + added
        return out[: self.n] - (shift.astype(np.int64) if small else shift)


def candidates(df: DataFrame, id_col: str, vector: str, label: Column, scale: int) -> DataFrame:
    """vec_id, label, vec (longs) of the rows that take part."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * F.lit(float(scale)))).alias("vec"))


def _vectors(group: pa.Table) -> np.ndarray:
    flat = group.column("vec").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(group.num_rows, -1)


def _block(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, labels and vectors in id order, one row of each id."""
    ids, labels, vectors = group.column("vec_id").to_numpy(), group.column("label").to_numpy(), _vectors(group)
    order = np.argsort(ids, kind="stable")
    again = ids[order][1:] == ids[order][:-1]
    if again.any():
        order = np.array(sorted(order.tolist(), key=lambda k: (ids[k], labels[k], vectors[k].tolist())))
        order = order[np.concatenate([[True], ids[order][1:] != ids[order][:-1]])]
    return ids[order], labels[order], vectors[order]


def _first(ids: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id; ids ascend."""
    if len(scores) > 4 * most and scores.dtype != object:
        floor = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= floor)
        return at[np.argsort(-scores[at], kind="stable")[:most]]
    return np.argsort(-scores, kind="stable")[:most]


def _meet(rows: DataFrame, asked: DataFrame, groups: int, blocks: int, work, schema: str) -> DataFrame:
    """``work(candidates, anchors)`` for every block of candidates with every block of anchors."""
    spark = rows.sparkSession
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("vec").alias("width")
    left = rows.select("vec_id", "label", "vec", width, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("part"), every(blocks).alias("block"))
    right = asked.select("*", width, F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block"), every(groups).alias("part"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = list(work(a, b)) if a.num_rows and b.num_rows else []
        columns = list(zip(*found)) if found else [[] for _ in arrow.names]
        return pa.Table.from_arrays([pa.array(c, type=t) for c, t in zip(columns, arrow.types)], schema=arrow)

    return left.groupBy("width", "part", "block").cogroup(right.groupBy("width", "part", "block")).applyInArrow(run, schema)


def _best(found: DataFrame, most: int, keys: list[str], *order: Column) -> DataFrame:
    """The first rows of every key with their ``rank``; all but the first are dropped before they are shuffled."""
    return found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)


def mine(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", positives: int = POSITIVES,
    negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, unit: int = UNIT, scale: int = SCALE,
    candidates_a_block: int = CANDIDATES, anchors_a_block: int = ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives of a positive score between ``low`` and ``high`` of ``unit`` parts of its score.  ``is_anchor`` is a condition on ``vec_id``.
    """
    rows = keep(candidates(df, id_col, vector, F.col(label) if isinstance(label, str) else label, scale), "vectors")
    least = F.min(F.struct("label", "vec")).alias("own")
    anchors = keep(rows.filter(is_anchor).groupBy("vec_id").agg(least).select("vec_id", "own.label", "own.vec"), "anchors")
    most = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    n, bound = rows.agg(F.count("*"), F.coalesce(F.max(most), F.lit(0))).first()
    bound = max(1, bound)
    groups, blocks = max(1, -(-n // candidates_a_block)), max(1, -(-anchors.count() // anchors_a_block))

    def near(a: pa.Table, b: pa.Table):
        ids, labels, vectors = _block(a)
        wanted = list(zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), _vectors(b)))
        for y in sorted({x[1] for x in wanted}):
            own = np.flatnonzero(labels == y)
            for at in range(0, len(own), 2 * STRIP):
                strip = own[at : at + 2 * STRIP]
                packed, those = Packed(vectors[strip], bound), ids[strip]
                for anchor, _, vec in (x for x in wanted if x[1] == y):
                    scores, other = packed.scores(vec), np.flatnonzero(those != anchor)
                    for k in other[_first(those[other], scores[other], positives)].tolist():
                        yield anchor, int(those[k]), int(scores[k])

    pairs = _meet(rows, anchors, groups, blocks, near, "vec_id long, positive_id long, positive_score long")
    first = _best(pairs, positives, ["vec_id"], F.desc("positive_score"), F.asc("positive_id"))
    best = first.groupBy("vec_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("best"))
    asked = keep(anchors.join(best, "vec_id"), "positives")

    def far(a: pa.Table, b: pa.Table):
        ids, labels, vectors = _block(a)
        wanted = list(zip(b.column("vec_id").to_pylist(), b.column("label").to_pylist(), _vectors(b), b.column("best").to_pylist()))
        for at in range(0, len(ids), 2 * STRIP):
            packed, those, kinds = Packed(vectors[at : at + 2 * STRIP], bound), ids[at : at + 2 * STRIP], labels[at : at + 2 * STRIP]
            for anchor, y, vec, best in wanted:
                scores, open_ = packed.scores(vec), kinds != y
                for p in best:
                    if p["score"] < 0:  # low parts of a negative score are above its high parts
                        continue
                    low_end, high_end = -(-low * p["score"] // unit), high * p["score"] // unit
                    fits = np.flatnonzero(open_ & (scores >= low_end) & (scores <= high_end))
                    for k in fits[_first(those[fits], scores[fits], negatives)].tolist():
                        yield anchor, p["id"], p["score"], int(those[k]), int(scores[k])

    found = _meet(rows, asked, groups, blocks, far, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    top = _best(found, negatives, ["anchor_id", "positive_id"], F.desc("negative_score"), F.asc("negative_id"))
    return top.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
