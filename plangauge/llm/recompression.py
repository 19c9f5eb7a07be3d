"""Substring dedup by recompression.

Rounds rename the word sequence of every document: runs of an equal symbol become one
symbol, then neighbours (left, right) become one symbol where a bit of the left name is 0
and of the right name is 1.  A new name is a hash of what it stands for, so equal strings get
equal names everywhere without a table of names, except near their ends.

For each window, the symbols that any surroundings would give are followed through the
rounds; of those that the last round leaves (or, if it leaves none, the last that leaves some),
the one with the least hash is its anchor, long symbols first.  The choice depends on the window's words alone, so equal windows have equal anchors at equal offsets.  Spark counts anchors; only windows around repeated anchors are compared, first all windows
that share an anchor at once, then, where that differs, window by window (128 bits).

Nulls and texts shorter than a window lose nothing.  Rows that share an id are told apart by the
hash of their text; equal rows repeat each other.  Every row in gives one row out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plangauge.llm.common import Kept, WordHashes, keep, map_rows, mix, words

WINDOW = 35
ROUNDS = 5
RUN_ROUNDS = (0,)
LONG = 4
BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_WORDS = 120_000


def _with_breaks(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All word hashes with a unique symbol behind each document; where documents start; which are breaks."""
    sizes = np.array([len(h) + 1 for h in hashes])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    line = np.empty(starts[-1], dtype=np.uint64)
    is_break = np.zeros(len(line), dtype=bool)
    is_break[starts[1:] - 1] = True
    line[~is_break] = np.concatenate(hashes)
    line[is_break] = mix(np.arange(1, len(hashes) + 1, dtype=np.uint64) << np.uint64(40))
    return line, starts[:-1], is_break


def _least(names: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least name in each range, leftmost on ties."""
    best = first.copy()
    todo = np.flatnonzero(last > first)
    step = 1
    while len(todo):
        at = first[todo] + step
        better = names[at] < names[best[todo]]
        best[todo[better]] = at[better]
        step += 1
        todo = todo[first[todo] + step <= last[todo]]
    return best


def anchors(hashes: list[np.ndarray], window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Per window of all documents: document, first word (in its document), anchor's word, anchor's name; then the window hashes."""
    line, starts, is_break = _with_breaks(hashes)
    breaks = np.flatnonzero(is_break)
    begin = np.arange(max(0, len(line) - window + 1))
    document = np.searchsorted(breaks, begin)
    fits = begin + window <= breaks[document]
    begin, document = begin[fits], document[fits]
    place, name = np.zeros(len(begin), dtype=np.int64), np.zeros(len(begin), dtype=np.uint64)
    symbols, at, edge = line, np.arange(len(line)), is_break  # names, first word, breaks of the symbols of this round
    alive, first, last = np.arange(len(begin)), begin.copy(), begin + window - 1

    def settle(done: np.ndarray, level: int) -> None:
        ranked = mix(symbols + np.uint64(level * 2 + 1)) >> np.uint64(1)
        ranked[np.diff(at, append=len(line)) < LONG] |= np.uint64(1 << 63)
        best = _least(ranked, first[done], last[done])
        place[alive[done]], name[alive[done]] = at[best], ranked[best]

    steps = [kind for r in range(rounds) for kind in (("run", "pair") if r in RUN_ROUNDS else ("pair",))]
    for level, kind in enumerate(steps):
        if not len(alive):
            break
        if kind == "run":
            head = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            group = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            length = np.diff(np.append(heads, len(symbols))).astype(np.uint64)
            named = np.where(length > 1, mix(symbols[heads] ^ mix(length + np.uint64(0x5151))), symbols[heads])
            a, b = group[first] + 1, group[last] - 1  # the outer runs may go on outside
        else:
            right = (mix(symbols ^ np.uint64(0xABCD00 + level)) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(symbols), dtype=bool)
            joins[:-1] = ~right[:-1] & right[1:] & ~edge[:-1] & ~edge[1:]
            head = np.concatenate([[True], ~joins[:-1]])
            group = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            second = symbols[np.minimum(heads + 1, len(symbols) - 1)]
            named = np.where(joins[heads], mix(mix(symbols[heads] + np.uint64(BASE)) ^ second), symbols[heads])
            a, b = first + right[first], last - ~right[last]
            empty = a > b
            a, b = np.where(empty, 1, group[np.minimum(a, len(symbols) - 1)]), np.where(empty, 0, group[np.maximum(b, 0)])
        over = a > b
        if over.any():
            settle(over, level)
        stay = ~over
        alive, first, last = alive[stay], a[stay], b[stay]
        symbols, at, edge = named, at[heads], edge[heads]
    if len(alive):
        settle(np.ones(len(alive), dtype=bool), len(steps))
    return document, begin - starts[document], place - starts[document], name, _Powers.hashes(line, begin, window)


class _Powers:
    """Hashes of word ranges from running sums of ``hash * BASE ** place``, modulo 2 ** 64."""

    up = down = np.empty(0, dtype=np.uint64)

    @classmethod
    def grow(cls, n: int) -> None:
        if len(cls.up) < n + 1:
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (BASE, pow(BASE, -1, 1 << 64)))

    @classmethod
    def ranges(cls, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        cls.grow(len(line))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * cls.up[: len(line)])])
        return mix((sums[b] - sums[a]) * cls.down[a] + (b - a).astype(np.uint64))

    @classmethod
    def hashes(cls, line: np.ndarray, begin: np.ndarray, window: int) -> np.ndarray:
        return cls.ranges(line, begin, begin + window)


def _groups(hashes: list[np.ndarray], window: int) -> dict[str, np.ndarray]:
    """One entry for each run of windows with the same anchor: document, first and last window, name, hash of all their words."""
    document, begin, place, name, _ = anchors(hashes, window)
    if not len(begin):
        return {}
    new = np.concatenate([[True], (document[1:] != document[:-1]) | (place[1:] != place[:-1]) | (name[1:] != name[:-1])])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(new)) - 1
    line, starts, _ = _with_breaks(hashes)
    base = starts[document[heads]]
    whole = _Powers.ranges(line, base + begin[heads], base + begin[tails] + window)
    whole = mix(whole ^ (place[heads] - begin[heads]).astype(np.uint64))
    return {"document": document[heads], "first": begin[heads], "last": begin[tails], "name": name[heads].view(np.int64), "whole": whole.view(np.int64)}


def _in_chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of batches with their words, about CHUNK_WORDS words each."""
    for batch in batches:
        column, begin, found, total = batch.column(text_at), 0, [], 0
        for i in range(batch.num_rows):
            found.append(words(column[i].as_py()))
            total += len(found[-1])
            if total >= CHUNK_WORDS or i == batch.num_rows - 1:
                yield batch.slice(begin, i + 1 - begin), found
                begin, found, total = i + 1, [], 0


def _arrow(df: DataFrame, schema: str):
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    return spark_schema, to_arrow_schema(spark_schema)


def anchor_table(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, name, whole, first, last (windows by their first word) of ``docs(doc_id, text_hash, text)``; no shuffle."""
    schema, arrow = _arrow(docs, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, name long, whole long, first int, last int")

    def run(batches):
        known = WordHashes()
        for part, tokens in _in_chunks(batches, 2):
            some = [i for i, t in enumerate(tokens) if len(t) >= window]
            if not some:
                continue
            g = _groups([known.array(tokens[i]) for i in some], window)
            rows = pa.array(np.array(some)[g["document"]])
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(rows), part.column(1).take(rows), *[pa.array(g[k]) for k in ("name", "whole")], *[pa.array(g[k].astype(np.int32)) for k in ("first", "last")]], schema=arrow
            )

    return docs.mapInArrow(run, schema)


def _window_table(docs: DataFrame, window: int) -> DataFrame:
    """Key (two longs), doc_id, text_hash and first word of the windows listed in ``docs(doc_id, text_hash, text, listed)``."""
    schema, arrow = _arrow(docs, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, name long, hash long, first int")

    def run(batches):
        known = WordHashes()
        for part, tokens in _in_chunks(batches, 2):
            line, starts, _ = _with_breaks([known.array(t) for t in tokens])
            rows, names, firsts = [], [], []
            for i, listed in enumerate(part.column(3).to_pylist()):
                for x in listed:
                    n = x["last"] - x["first"] + 1
                    rows.append(np.full(n, i))
                    names.append(np.full(n, x["name"], dtype=np.int64))
                    firsts.append(np.arange(x["first"], x["last"] + 1))
            row, first = np.concatenate(rows), np.concatenate(firsts)
            hashed = _Powers.hashes(line, starts[row] + first, window).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(np.concatenate(names)), pa.array(hashed), pa.array(first.astype(np.int32))], schema=arrow
            )

    return docs.mapInArrow(run, schema)


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, ranges (first, last): first words of the windows that start elsewhere too."""
    every = Kept(anchor_table(docs, window), "anchors")
    often = every.df.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name")
    often = Kept(often, "repeated-names")  # a stored side lets adaptive execution split a hot name of the other
    repeated = Kept(every.df.join(often.df, "name"), "repeated-anchors")
    every.drop()
    often.drop()
    table, place = repeated.df, F.xxhash64("doc_id", "text_hash", "first")
    alike = table.groupBy("name", "whole").agg(F.count("*").alias("n"), F.min(place).alias("shown"))
    alike = Kept(alike, "surroundings")
    kinds = Kept(alike.df.groupBy("name").agg((F.count("*") > 1).alias("differ")), "kinds")
    rated = table.join(alike.df, ["name", "whole"]).join(kinds.df, "name")
    rated = Kept(rated.select("doc_id", "text_hash", "name", "first", "last", "n", "differ", (place == F.col("shown")).alias("shown")), "rated-anchors")
    repeated.drop()
    alike.drop()
    kinds.drop()
    whole = rated.df.filter("n > 1").select("doc_id", "text_hash", "first", "last")
    # different surroundings: one of each kind is compared window by window
    unsure = rated.df.filter(F.col("differ") & ((F.col("n") == 1) | F.col("shown")))
    listed = unsure.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("first", "last", "name")).alias("listed"))
    some = _join_row(docs, listed, "inner")
    windows = Kept(_window_table(some.select("doc_id", "text_hash", "text", "listed"), window), "windows")
    twice = windows.df.groupBy("name", "hash").agg(F.count("*").alias("n")).filter("n > 1").select("name", "hash")
    twice = Kept(twice, "repeated-keys")
    single = windows.df.join(twice.df, ["name", "hash"]).select("doc_id", "text_hash", "first", F.col("first").alias("last"))
    found = whole.unionByName(single).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    found = keep(found, "repeated-windows")
    rated.drop()
    windows.drop()
    twice.drop()
    return found


def _join_row(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    found = found.withColumnsRenamed({"doc_id": "of_doc", "text_hash": "of_text"})
    return docs.join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_text")), how)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, removed (word ranges [start, end)) and, if asked, the kept text of every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    joined = _join_row(docs, repeated_windows(docs, window), "left")

    def make():
        def work(ids, texts, ranges):
            for i, t, r in zip(ids, texts, ranges):
                tokens = words(t)
                gone, kept, upto = [], [], 0
                for x in sorted((x["first"], x["last"] + window) for x in r or ()):
                    if gone and x[0] <= gone[-1][1]:
                        gone[-1] = (gone[-1][0], max(gone[-1][1], x[1]))
                    else:
                        gone.append(x)
                for a, b in gone:
                    kept += tokens[upto:a]
                    upto = b
                kept += tokens[upto:]
                rest = b" ".join(kept)
                out = (i, len(tokens), len(tokens) - len(kept), hashlib.sha256(rest).hexdigest(), [{"start": a, "end": b} for a, b in gone])
                yield (*out, rest.decode("utf-8", "replace")) if with_text else out

        return work

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"
    return map_rows(joined.select("doc_id", "text", "ranges"), schema + (", kept_text string" if with_text else ""), make)
