"""Benchmark decontamination with one Aho-Corasick automaton over normalised test passages.

Texts are normalised (A-Z lower-cased, words are runs of ASCII digits, a-z and
all characters beyond ASCII).  Each window of ten words of an item, or the
whole item if it is shorter, is a pattern; each text is scanned once.  Hits are
mapped back to character spans of the original text.

Null or wordless texts and items give no hits.  Items that repeat an id count
once; an item without id hits words but is not listed.  Texts of any length are scanned whole.  Every row in gives one
row out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plangauge.llm.common import keep, map_rows

WINDOW = 10
# Bytes of windows in one automaton; measured, the automaton takes 44 bytes of a task's memory for each.
BLOCK_CHARS = 4_000_000
# What normalisation does to each byte of UTF-8.
KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in KEPT else 32 for b in range(256))
NORMAL_WORD = re.compile(rb"[^ ]+")


def normal(text: str | None) -> bytes:
    """Lower-cased text with a blank for every separator, byte for byte as long as the UTF-8 text."""
    return text.encode("utf-8", "surrogatepass").translate(TABLE) if text else b""


def patterns_of(text: str | None, window: int = WINDOW) -> set[bytes]:
    tokens = normal(text).split()
    if not tokens:
        return set()
    return {b" ".join(tokens[i : i + window]) for i in range(max(1, len(tokens) - window + 1))}


def benchmark_patterns(benchmark: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """pattern and the sorted ids that have it, one row for each different window of the test set."""

    def make():
        def work(ids, texts):
            return ((p, i) for i, t in zip(ids, texts) for p in patterns_of(t, window))

        return work

    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text}`").alias("t"))
    return map_rows(items, "pattern binary, i string", make).groupBy("pattern").agg(F.array_sort(F.collect_set("i")).alias("ids"))


def pattern_blocks(patterns: DataFrame, block_chars: int) -> Iterator[dict[bytes, list[str]]]:
    """The patterns in blocks of about ``block_chars`` bytes, dealt by a hash; the driver holds one block at a time."""
    size = patterns.agg(F.coalesce(F.sum(F.length("pattern")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    for k in range(blocks):
        rows = patterns.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()
        yield {bytes(r["pattern"]): r["ids"] for r in rows}


class Scanner:
    """Automaton over patterns; blanks on both sides make it match whole words only."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, ids in patterns.items():
            n = p.count(b" ") + 1
            self.automaton.add_word(f" {p.decode('utf-8', 'surrogateescape')} ", (n, tuple(sorted(ids))))
        self.automaton.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, hit flag per word, ids of the items found."""
        tokens = normal(text).split()
        items: set[str] = set()
        ends = []
        if tokens and len(self.automaton):
            joined = b" " + b" ".join(tokens) + b" "
            line = joined.decode("utf-8", "surrogateescape")
            ends = [(end, n, ids) for end, (n, ids) in self.automaton.iter(line)]
        hit = np.zeros(len(tokens), dtype=bool)
        if ends:
            blanks = np.cumsum([len(w) + 1 for w in line[1:-1].split(" ")])  # place of the blank behind each word
            for end, n, ids in ends:
                last = int(np.searchsorted(blanks, end)) + 1
                hit[last - n : last] = True
                items.update(ids)
        return len(tokens), hit, items


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character spans [start, end) of runs of hit words in the original text."""
    places = [m.span() for m in NORMAL_WORD.finditer(normal(text))]
    raw = text.encode("utf-8", "surrogatepass")
    out: list[tuple[int, int]] = []
    before = False
    for flag, (a, b) in zip(hit, places):
        if flag:
            out[-1:] = [(out[-1][0], b)] if before else [*out[-1:], (a, b)]
        before = bool(flag)
    return [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass"))) for a, b in out]


def scan(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, with_spans: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), if asked spans, and columns ``carry`` of every document; no shuffle.

    The test set is the stated query set.  Its windows are made and united in Spark.  They are held in one automaton up to about
    ``block_chars`` bytes (measured here); a larger set goes block by block, each block in one pass over the text whose flags are carried on.
    """
    patterns = keep(benchmark_patterns(benchmark, item_id, item_text, window), "benchmark-windows")
    kinds = dict(df.dtypes)
    names = [f"c{i}" for i in range(len(carry))]
    state = df.select(
        F.col(id_col).alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast("binary").alias("flags"), F.array().cast("array<string>").alias("items"),
        *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)],
    )
    between = state.schema
    schema = ", ".join([
        f"doc_id {kinds[id_col]}, n_words long, n_hit long, items array<string>", *["spans array<struct<start:int,end:int>>"] * with_spans,
        *[f"{n} {kinds[c]}" for c, n in zip(carry, names)],
    ])

    block, later = {}, pattern_blocks(patterns, block_chars)
    coming = next(later)
    while coming is not None:
        block, coming = coming, next(later, None)
        shared, last = df.sparkSession.sparkContext.broadcast(block), coming is None

        def make(shared=shared, last=last):
            scanner = Scanner(shared.value)

            def work(ids, texts, flags, items, *rest):
                for i, t, f, x, *others in zip(ids, texts, flags, items, *rest):
                    n, hit, found = scanner(t)
                    if f is not None:
                        hit = hit | np.frombuffer(f, dtype=bool)
                    found = sorted(found.union(x))
                    if not last:
                        yield i, t, hit.tobytes(), found, *others
                    elif with_spans:
                        yield i, n, int(hit.sum()), found, [{"start": a, "end": b} for a, b in spans(t or "", hit)], *others
                    else:
                        yield i, n, int(hit.sum()), found, *others

            return work

        state = map_rows(state, schema if last else between, make)
    own = [c for c in state.columns if c not in names]
    return state.select(*own, *[F.col(n).alias(c) for c, n in zip(carry, names) if c not in own])
