"""Near-duplicate classes by order MinHash.

Each of ``sketches`` hash functions picks the ``length`` least occurrence-labelled five-word
shingles of a text and keeps them in text order; their hash is a key.  Texts that share a key are
candidates.  Two texts are linked if their shingle sequences align to a similarity of
``threshold``: aligned / (all - aligned), which order and repetition lower.

Exact copies are one node.  In every key, members meet the member with most company; any two that both are
linked to it are in one class.  Members that are not linked to it meet everyone who was compared with
the same centre, in blocks of bounded size, so no candidate pair is lost and no bucket is expanded.  Joins that carry texts are merge joins at every size.

Null texts and texts without words are classes of their own, unless they are exact copies.  Rows that share an
id are one document; a row without an id joins the class of its exact copies or has none.
Every row in gives one row out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plangauge.llm.common import Kept, WordHashes, keep, map_rows, mix, words

SHINGLE = 5
SKETCHES = 20
LENGTH = 4
THRESHOLD = 0.8
BLOCK = 128


def shingles(known: WordHashes, text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words; of all words if there are fewer."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = known.array(tokens)
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), dtype=np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out + h[k : k + n])
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """Tell repeated shingles apart by their occurrence number."""
    order = np.argsort(grams, kind="stable")
    same = np.concatenate([[False], grams[order][1:] == grams[order][:-1]])
    if not same.any():
        return grams
    at = np.arange(len(grams))
    number = np.empty(len(grams), dtype=np.uint64)
    number[order] = at - np.maximum.accumulate(np.where(same, 0, at))
    return np.where(number > 0, mix(grams ^ mix(number)), grams)


def sketch(grams: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """One key per hash function."""
    tagged = labelled(grams)
    seeds = mix(np.arange(1, sketches + 1, dtype=np.uint64) << np.uint64(17))
    ranked = (tagged[None, :] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    ranked ^= ranked >> np.uint64(32)
    if len(tagged) > length:
        picked = np.sort(np.argpartition(ranked, length - 1, axis=1)[:, :length], axis=1)
    else:
        picked = np.tile(np.arange(len(tagged)), (sketches, 1))
    keys = seeds
    for column in picked.T:
        keys = mix(keys ^ tagged[column]) + seeds
    return keys.view(np.int64)


def least_common(n: int, m: int, threshold: float) -> float:
    """Common shingles that texts of ``n`` and ``m`` need at ``threshold``, less what rounding may add: 28 of 28 and 35 reach 0.8."""
    return threshold / (1 + threshold) * (n + m) - 1e-9 * (n + m)


def aligned(a: list[int], b: list[int], threshold: float = THRESHOLD) -> float:
    """Similarity by the longest common subsequence, within the band that the threshold leaves; 0 where it cannot be reached.

    At similarity t at most ``(n + m) (1 - t) / (1 + t)`` shingles are unaligned, which bounds
    how far aligned places differ.  Rows of the alignment are the bits of one integer.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    common = sum((Counter(a) & Counter(b)).values())
    if common < least_common(n, m, threshold):
        return 0.0
    band = int((n + m) * (1 - threshold) / (1 + threshold)) + 1
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    places: dict[int, int] = {}
    for i, g in enumerate(x):
        places[g] = places.get(g, 0) | 1 << i
    full = (1 << len(x)) - 1
    row, width = full, (1 << (2 * band + 1)) - 1
    for j, g in enumerate(y):
        hits = places.get(g, 0) & (width << (j - band) if j >= band else width >> (band - j))
        if hits:
            both = row & hits
            row = ((row + both) | (row - both)) & full
    length = head + tail + len(x) - row.bit_count()
    return length / (n + m - length)


def members(df: DataFrame, id_col: str, text: str, sketches: int, length: int) -> DataFrame:
    """doc_id, h1, h2, node (least id of the exact copies) and keys (at the node itself, if it has words)."""
    plain = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.col(text).alias("text"))

    def make():
        known = WordHashes()

        def work(ids, first, second, texts):
            for i, a, b, t in zip(ids, first, second, texts):
                g = shingles(known, t)
                yield i, a, b, sketch(g, sketches, length).tolist() if len(g) else None

        return work

    sketched = Kept(map_rows(plain, f"doc_id {dict(plain.dtypes)['doc_id']}, h1 long, h2 long, keys array<long>", make), "sketches")
    nodes = Kept(sketched.df.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "nodes")
    own = F.when(F.col("doc_id") == F.col("node"), F.col("keys")).alias("keys")
    whole = keep(sketched.df.join(nodes.df, ["h1", "h2"]).select("doc_id", "h1", "h2", "node", own), "members")
    sketched.drop()
    nodes.drop()
    return whole


def star_pairs(found: DataFrame) -> DataFrame:
    """centre, node: every member of a shared key with the member of that key that has most company."""
    keyed = found.filter(F.col("keys").isNotNull()).select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    shared = keep(sizes.filter("a != b").select("key", "n"), "shared-keys")
    keyed = keep(keyed.join(shared, "key"), "keyed")
    company = keep(keyed.groupBy("node").agg(F.sum("n").alias("company")), "company")
    centres = keyed.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("top"))
    centres = keep(centres.select("key", F.col("top.node").alias("centre")), "centres")
    return keyed.join(centres, "key").filter("node != centre").select("centre", "node").distinct()


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """centre, node, linked."""
    with_node = pairs.join(texts.hint("merge"), "node")
    both = with_node.join(texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text")).hint("merge"), "centre")

    def make():
        known = WordHashes()
        last: dict = {}

        def work(centres, nodes, texts, centre_texts):
            for c, x, t, u in zip(centres, nodes, texts, centre_texts):
                if c not in last:
                    last.clear()
                    last[c] = shingles(known, u).tolist()
                yield c, x, aligned(last[c], shingles(known, t).tolist(), threshold) >= threshold

        return work

    kind = dict(pairs.dtypes)["node"]
    return map_rows(both.select("centre", "node", "text", "centre_text"), f"centre {kind}, node {kind}, linked boolean", make, 128)


def compare_rest(verified: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b: links of nodes that are not linked to their centre with all that were compared with that centre."""
    counts = verified.groupBy("centre").agg(F.count("*").alias("n"), F.sum((~F.col("linked")).cast("long")).alias("n_open"))
    counts = keep(counts.filter("n > 1 and n_open > 0"), "open-centres")
    rows = verified.join(counts, "centre")
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    open_ = rows.filter(~F.col("linked")).withColumn("parts", blocks("n_open")).select("centre", "node", F.lit(True).alias("open"), own.alias("i"), every("n").alias("j"))
    all_ = rows.withColumn("parts", blocks("n")).select("centre", "node", F.lit(False).alias("open"), every("n_open").alias("i"), own.alias("j"))
    dealt = open_.unionByName(all_).join(texts.hint("merge"), "node")
    kind = dict(texts.dtypes)["node"]
    schema = verified.sparkSession.createDataFrame([], f"a {kind}, b {kind}").schema
    arrow = to_arrow_schema(schema)

    def pairs(group: pa.Table) -> pa.Table:
        known = WordHashes()
        nodes, opens = group.column("node").to_pylist(), group.column("open").to_pylist()
        grams: dict = {}
        for x, t in zip(nodes, group.column("text").to_pylist()):
            if x not in grams:
                grams[x] = shingles(known, t).tolist()
        sets = {x: frozenset(g) for x, g in grams.items()}
        repeats = {x: len(g) - len(sets[x]) for x, g in grams.items()}
        left, right = sorted({x for x, o in zip(nodes, opens) if o}), sorted({x for x, o in zip(nodes, opens) if not o})
        out = []
        for x in left:
            for y in right:
                if x == y:
                    continue
                n, m = len(grams[x]), len(grams[y])
                least = least_common(n, m, threshold)
                # common shingles with repetition are at most the common kinds and the lesser number of repeats
                if min(n, m) >= least and len(sets[x] & sets[y]) + min(repeats[x], repeats[y]) >= least and aligned(grams[x], grams[y], threshold) >= threshold:
                    out.append({"a": x, "b": y})
        return pa.Table.from_pylist(out, schema=arrow)

    return dealt.select("centre", "i", "j", "node", "open", "text").groupBy("centre", "i", "j").applyInArrow(pairs, schema)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of ``edges(a, b)``, by passing on labels and jumping along them."""
    both = keep(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = Kept(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.df, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("seen"))
        hooked = Kept(labels.df.join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label")), "hooked")
        jump = hooked.df.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = hooked.df.join(jump, F.col("label") == F.col("at")).select("node", "old", F.col("further").alias("label"))
        after = Kept(jumped, "labels")
        hooked.drop()
        labels.drop()
        labels = after
        changed = after.df.filter("old != label").limit(1).count()
        labels.df = after.df.select("node", "label")
        if not changed:
            return labels.df


def near_copies(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, sketches: int = SKETCHES, length: int = LENGTH
) -> DataFrame:
    """doc_id, h1, h2 (hashes of the text), class_id (least id of the class) of every row."""
    found = members(df, id_col, text, sketches, length)
    pairs = keep(star_pairs(found), "pairs")
    wanted = pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()
    docs = df.select(F.col(id_col).alias("node"), F.col(text).alias("text"))
    # rows that share an id count once: the least hash of their texts
    texts = keep(docs.join(wanted.hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "candidate-texts")
    verified = keep(verify(pairs, texts, threshold), "verified")
    links = verified.filter("linked").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    edges = keep(links.unionByName(compare_rest(verified, texts, threshold)), "links")
    labels = keep(components(edges).filter("node != label"), "classes").withColumnRenamed("node", "of_node")
    named = found.join(labels, F.col("node") == F.col("of_node"), "left")
    return named.select("doc_id", "h1", "h2", F.coalesce("label", "node").alias("class_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``df`` without those whose class is led by another document; equal rows stay once."""
    stay = near_copies(df, id_col, text, **options).filter(F.col("class_id").isNull() | (F.col("class_id") == F.col("doc_id")))
    stay = keep(stay.select(F.col("doc_id").alias("of_doc"), F.col("h1").alias("of_h1"), F.col("h2").alias("of_h2")).distinct(), "first-of-class")
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h1"), F.xxhash64(F.lit(1), F.col(f"`{text}`")).alias("h2"))
    same = F.col("id").eqNullSafe(F.col("of_doc")) & (F.col("h1") == F.col("of_h1")) & (F.col("h2") == F.col("of_h2"))
    return own.join(stay.hint("merge"), same, "left_semi").dropDuplicates(["id", "h1", "h2"]).select("row.*")
