"""Alignment of two tokenizers over the same texts, by merging token ends along balanced pieces of the merge path.

Both tokenizers spell the same bytes, so a text gives two rising lists of byte offsets, the ends of its A tokens and of its B tokens.
Merging them gives everything: between two neighbouring ends of the merged list lies one A token over one B token (a link), and an end that both have closes a group.

The merge path is cut where it crosses evenly spaced diagonals.  On diagonal k the crossing (i, j), i + j = k, is found by
binary search, so each piece knows its own ends without the others and has the same work, whatever the text.  Pieces carry the tokens they end and, for links, the
next one of each side.  They are packed into batches of equal work, also from several texts, or from parts of one long text, and
merged in any task.  A group that runs over a piece's border comes out as the loose ends of both pieces, and is stitched by document.

Steps: texts to pieces (written to the shared folder); links of each batch, counted by id pair, to counts over the corpus and the highest count
of each B id; the counts of a batch's own pairs back to the batch, which is then merged for groups and sums.  What a batch sends and gets is
bounded by its work.  Ids are stored compressed.

Texts that are null, empty, or which one tokenizer does not spell byte for byte have no tokens: zeros and ''.  Long texts are split over batches as said.  Rows that share an
id, or are equal, are documents of their own, one row each, and all count.  A null id stays null.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plangauge.llm.common import keep
from plangauge.llm.token_planes import byte_letters, worker_cache

PIECE, BATCH = 65_536, 1_000_000
# Ends of a batch that are merged in one go: a merge holds some 120 bytes for each.
RUN = 131_072
SLICE = 128
# Texts that Spark hands over at once: it and the worker hold them beside the tokenizers.
TEXTS = 1_024


# A space between two characters that are letters, digits or marks in every version of the character tables.
CUT = re.compile("(?<=[!-~\u00c0-\u024f]) (?=[!-~\u00c0-\u024f])")
# A part that may have such a space on both sides.
EDGES = re.compile("(?=[!-~\u00c0-\u024f])(?s:.*)(?<=[!-~\u00c0-\u024f])\\Z")


def a_can_be_cut(tokenizer) -> bool:
    """No normalization, and the byte-level splitting that starts a new piece at every single space: nothing reaches over one from the left."""
    made = json.loads(tokenizer.to_str())
    split, model = made["pre_tokenizer"] or {}, made["model"]
    plain = made["normalizer"] is None and made["truncation"] is None and made["post_processor"] is None and all(t["special"] for t in made["added_tokens"])
    whole_words = model["type"] == "BPE" and not model["dropout"] and not model["continuing_subword_prefix"] and not model["end_of_word_suffix"]
    return plain and whole_words and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]


def b_can_be_cut(model_file: str, pieces: list[str]) -> bool:
    """Merges without normalization, and no piece that holds a space behind something else: no merge reaches over a space from the left."""
    from sentencepiece import sentencepiece_model_pb2

    made = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        made.ParseFromString(file.read())
    norm, learned = made.normalizer_spec, made.trainer_spec
    plain = norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
    merged = learned.model_type == sentencepiece_model_pb2.TrainerSpec.BPE and not learned.user_defined_symbols and not learned.treat_whitespace_as_suffix
    return plain and merged and not any("\u2581" in p.lstrip("\u2581") for p in pieces)


def stored(size: int) -> np.dtype:
    """How ids of a vocabulary are stored: in two bytes where they fit."""
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


def cache_name(a_path: str, b_path: str) -> str:
    return f"{a_path} {b_path}"


class Tokenizers:
    """Ids of texts in A (byte-level vocabulary) and B (pieces), and the bytes of each id.

    Where both tokenizers provably cut there, texts are split at single spaces between words; a part's ids do not depend on the others, so parts are
    encoded once, many in one text, and remembered, up to ``limit`` of them in a worker.  Other tokenizers get whole texts.
    """

    limit = 200_000
    together = 256

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        known = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = a_can_be_cut(self.a) and b_can_be_cut(b_path, pieces)
        self.a_len, self.b_len = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_type, self.b_type = stored(len(self.a_bytes)), stored(len(self.b_bytes))
        self.known = worker_cache(cache_name(a_path, b_path))

    def _both(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], bytes, bool]]:
        """Ids of space and text on both sides, its bytes, and whether both sides spell them."""
        firsts = self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)
        for t, first, b in zip(texts, firsts, self.b.encode(texts, num_threads=1)):
            a, want = first.ids, f" {t}".encode()
            yield a, b, want, b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))

    def _learn(self, parts: list[str]) -> None:
        """Remember the ids of both sides as bytes; empty where a side does not spell space and part."""
        a_known, b_known = self.known.setdefault("a", {}), self.known.setdefault("b", {})
        glued, alone = [], parts
        if self.cuttable:  # parts that have a character on both ends at which texts are cut are encoded together, as one text
            fit = [p for p in parts if "\u2581" not in p and EDGES.match(p)]  # a letter that stands for space is spelled otherwise
            glued, alone = [fit[at : at + self.together] for at in range(0, len(fit), self.together)], list(set(parts).difference(fit))
        for at in range(0, len(glued), 16):
            some = glued[at : at + 16]
            for own, (a, b, want, same) in zip(some, self._both([" ".join(x) for x in some])):
                upto = np.cumsum([len(p.encode()) + 1 for p in own])
                sides = []
                for ids, lengths, kind, known in ((a, self.a_len, self.a_type, a_known), (b, self.b_len, self.b_type, b_known)):
                    ids = np.array(ids, dtype=kind)
                    ends = np.cumsum(lengths[ids])
                    last = np.minimum(np.searchsorted(ends, upto), len(ids) - 1)
                    same = same and np.array_equal(ends[last], upto)
                    sides.append((known, ids.tobytes(), ((last + 1) * kind.itemsize).tolist()))
                if not same:
                    alone = alone + own
                    continue
                for known, raw, ends in sides:
                    known.update(zip(own, map(raw.__getitem__, map(slice, [0, *ends], ends))))
        for at in range(0, len(alone), 4096):
            some = alone[at : at + 4096]
            for p, (a, b, _, same) in zip(some, self._both(some)):
                a_known[p] = np.array(a, dtype=self.a_type).tobytes() if same else b""
                b_known[p] = np.array(b, dtype=self.b_type).tobytes() if same else b""

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides; none where a side does not spell space and text."""
        split = [(CUT.split(t) if self.cuttable else [t]) if t else [] for t in texts]
        a_known, b_known = self.known.setdefault("a", {}), self.known.setdefault("b", {})
        found = [list(map(a_known.get, parts)) for parts in split]
        new = {p for parts, ids in zip(split, found) if None in ids for p, x in zip(parts, ids) if x is None}
        if len(a_known) + len(new) > self.limit:  # the first learned are the most frequent: they stay
            for p in list(a_known)[self.limit // 2 :]:
                del a_known[p], b_known[p]
            new = set().union(*split).difference(a_known)
        self._learn(list(new))
        out = []
        for parts, a in zip(split, found):
            a = list(map(a_known.__getitem__, parts)) if None in a else a
            b = list(map(b_known.__getitem__, parts))
            if not all(a):
                a, b = [], []
            out.append((np.frombuffer(b"".join(a), dtype=self.a_type), np.frombuffer(b"".join(b), dtype=self.b_type)))
        return out

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a_len, self.b_len


def worker_tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """The tokenizers of a worker, loaded once for all its tasks, and kept with what they remember."""
    cache = worker_cache(cache_name(a_path, b_path))
    if "tokenizers" not in cache:
        cache["tokenizers"] = Tokenizers(a_path, b_path)
    return cache["tokenizers"]


def squeeze(ids: list[bytes], width: int) -> bytes:
    """Ids of a batch, low and high bytes apart, compressed."""
    import zstandard

    raw = np.frombuffer(b"".join(ids), dtype=np.uint8).reshape(-1, width)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw.T).tobytes())


def expand(packed: bytes, width: int) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel()


def pieces_of(row: dict, a_len: np.ndarray, b_len: np.ndarray) -> list[dict]:
    """The pieces of a stored batch with their ids."""
    pieces = row["pieces"]
    for side, lengths in (("a", a_len), ("b", b_len)):
        ids, at = expand(row[side], stored(len(lengths)).itemsize), 0
        for p in pieces:
            p[side] = ids[at : at + p[f"n_{side}"]]
            at += p[f"n_{side}"]
    return pieces


def crossing(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """Where the merge path of two rising lists crosses a diagonal; an end that both have is not parted."""
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[diagonal - i - 1]:
            low = i + 1
        else:
            high = i
    i, j = low, diagonal - low
    if i and j < len(b) and a[i - 1] == b[j]:
        j += 1
    return i, j


def cut(a_ids: np.ndarray, b_ids: np.ndarray, a_len: np.ndarray, b_len: np.ndarray, size: int) -> Iterator[dict]:
    """Pieces of one text: its share of both id lists, where it starts in bytes before the first end, and the next id of each side."""
    a, b = np.cumsum(a_len[a_ids]), np.cumsum(b_len[b_ids])
    count = max(1, -(-(len(a) + len(b)) // size))
    edges = [(0, 0), *(crossing(a, b, k * size) for k in range(1, count)), (len(a), len(b))]
    for k, ((i, j), (x, y)) in enumerate(zip(edges, edges[1:])):
        # bytes of the first token of each side that lie in earlier pieces
        done = max(a[i - 1] if i else 0, b[j - 1] if j else 0)
        yield {
            "piece": k, "pieces": count, "a": a_ids[i:x], "b": b_ids[j:y], "a_next": int(a_ids[x]) if x < len(a) else -1, "b_next": int(b_ids[y]) if y < len(b) else -1,
            "a_done": int(done - (a[i - 1] if i else 0)), "b_done": int(done - (b[j - 1] if j else 0)),
        }


@dataclass
class Merged:
    """Pieces of a batch merged in one go: links in order, and where pieces and groups end."""

    a: np.ndarray  # ids, each piece followed by its next one (0 where there is none)
    b: np.ndarray
    link_a: np.ndarray  # places in a and b
    link_b: np.ndarray
    link_piece: np.ndarray
    a_group: np.ndarray  # cuts before the end of each token that ends in a piece, over the batch
    b_group: np.ndarray
    a_from: np.ndarray  # first token of each piece, without the next ones
    b_from: np.ndarray
    cuts: np.ndarray  # cuts up to each piece


def merge(pieces: list[dict], a_len: np.ndarray, b_len: np.ndarray) -> Merged:
    """Ends of all pieces are laid one behind the other, so one merge serves all of them."""
    sides = []
    for side, lengths, done in (("a", a_len, "a_done"), ("b", b_len, "b_done")):
        own = [p[side].astype(np.int64) for p in pieces]
        counts = np.array([len(x) for x in own])
        after = np.array([max(0, p[f"{side}_next"]) for p in pieces], dtype=np.int64)
        ids = np.concatenate([y for x, n in zip(own, after) for y in (x, [n])]) if pieces else np.empty(0, dtype=np.int64)
        flat = np.concatenate(own) if pieces else np.empty(0, dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([[0], np.cumsum(lengths[flat])])
        ends = total[1:] - np.repeat(total[starts[:-1]] + np.array([p[done] for p in pieces], dtype=np.int64), counts)
        sides.append((ids, ends, counts, starts))
    (a, a_ends, a_counts, a_starts), (b, b_ends, b_counts, b_starts) = sides
    last = lambda ends, starts, counts: np.where(counts > 0, ends[np.maximum(starts[1:] - 1, 0)], 0) if len(ends) else np.zeros(len(counts), dtype=np.int64)
    span = np.maximum(last(a_ends, a_starts, a_counts), last(b_ends, b_starts, b_counts)) + 1
    base = np.concatenate([[0], np.cumsum(span)])[:-1]
    piece = np.arange(len(pieces))
    a_at, b_at = a_ends + np.repeat(base, a_counts), b_ends + np.repeat(base, b_counts)
    both = np.concatenate([a_at, b_at])
    order = np.argsort(both, kind="stable")  # two rising runs: one merge
    merged, from_a = both[order], order < len(a_at)
    new = np.concatenate([[True], merged[1:] != merged[:-1]]) if len(merged) else np.empty(0, dtype=bool)
    link = np.cumsum(new) - 1
    ends = merged[new]
    a_link, b_link = link[from_a], link[~from_a]  # the link that each token ends with
    has_a, has_b = np.zeros(len(ends), dtype=np.int64), np.zeros(len(ends), dtype=np.int64)
    has_a[a_link], has_b[b_link] = 1, 1
    of_piece = np.searchsorted(base, ends, side="right") - 1 if len(pieces) else np.empty(0, dtype=np.int64)
    cuts = np.cumsum(has_a & has_b)
    before = cuts - (has_a & has_b)
    by_piece = np.concatenate([[0], cuts])[np.searchsorted(of_piece, piece, side="right")]
    return Merged(
        a, b, np.cumsum(has_a) - has_a + of_piece, np.cumsum(has_b) - has_b + of_piece, of_piece, before[a_link], before[b_link], a_starts, b_starts, by_piece,
    )


class Spelling:
    """Group strings from ids: every id as text with what follows it, joined in the order of the string."""

    def __init__(self, a_size: int, b_size: int):
        self.a_size, self.b_size = a_size, b_size
        self.known = [f"{i}{end}".encode() for size, ends in ((a_size, ",|"), (b_size, ",;")) for end in ends for i in range(size)]

    def groups(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
        """``a1,a2|b1;`` for each group, in order."""
        if not len(a):
            return b""
        n = int(max(a_group[-1], b_group[-1])) + 1
        a_last = np.concatenate([a_group[1:] != a_group[:-1], [True]])
        b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]])
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=n))])
        a_upto = np.cumsum(np.bincount(a_group, minlength=n))
        code = np.empty(len(a) + len(b), dtype=np.int64)
        code[np.arange(len(a)) + b_before[a_group]] = a + a_last * self.a_size
        code[np.arange(len(b)) + a_upto[b_group]] = b + 2 * self.a_size + b_last * self.b_size
        return b"".join(map(self.known.__getitem__, code.tolist()))


PIECES = "key string, doc_id {id}, piece int, pieces int, n_a int, n_b int, a_next int, b_next int, a_done long, b_done long"
PARTS = "key string, doc_id {id}, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, body string, a_head array<int>, b_head array<int>, a_tail array<int>, b_tail array<int>"


def to_batches(df: DataFrame, a_path: str, b_path: str, id_col: str, text: str, piece: int, batch: int) -> DataFrame:
    """batch and its pieces: rows of about equal work."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    schema = df.sparkSession.createDataFrame([], f"batch long, a binary, b binary, pieces array<struct<{PIECES.format(id=dict(rows.dtypes)['doc_id']).replace(' ', ':').replace(',:', ',')}>>").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        tokenizers, name = worker_tokenizers(a_path, b_path), uuid.uuid4()
        a_len, b_len = tokenizers.lengths()
        waiting, work, number, made = [], 0, 0, 0

        def row():
            # random, not counted: tasks need not know of each other; two equal numbers would share a group, which is harmless
            sides = {c: squeeze([p.pop(c).tobytes() for p in waiting], kind.itemsize) for c, kind in (("a", tokenizers.a_type), ("b", tokenizers.b_type))}
            return pa.RecordBatch.from_pylist([sides | {"batch": (name.int + made * 0x9E3779B97F4A7C15) % (1 << 63), "pieces": waiting}], schema=arrow)

        for given in batches:
            for at in range(0, given.num_rows, SLICE):
                part = given.slice(at, SLICE)
                ids = part.column(0).to_pylist()
                for i, (a, b) in zip(ids, tokenizers.encode(part.column(1).to_pylist())):
                    number += 1
                    for p in cut(a, b, a_len, b_len, piece):
                        whole = p["pieces"] == 1
                        waiting.append(p | {"key": None if whole else f"{name.hex}-{number}", "doc_id": i, "n_a": len(p["a"]), "n_b": len(p["b"])})
                        work += len(p["a"]) + len(p["b"]) + 8
                        if work >= batch:
                            yield row()
                            waiting, work, made = [], 0, made + 1
        if waiting:
            yield row()

    return rows.mapInArrow(run, schema)


def pair_of(m: Merged) -> np.ndarray:
    """The id pair of each link as one number, B first."""
    return m.b[m.link_b] << 32 | m.a[m.link_a]


def runs(pieces: list[dict]) -> Iterator[list[dict]]:
    """The pieces of a batch in turn, some :data:`RUN` ends at a time."""
    held, ends = [], 0
    for p in pieces:
        if held and ends + p["n_a"] + p["n_b"] > RUN:
            yield held
            held, ends = [], 0
        held.append(p)
        ends += p["n_a"] + p["n_b"]
    if held:
        yield held


def count_pairs(pieces: list[dict], a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id pairs of a batch in rising order, and how many links each has."""
    pairs, n = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    for run in runs(pieces):
        more, times = np.unique(pair_of(merge(run, a_len, b_len)), return_counts=True)
        both, counts = np.concatenate([pairs, more]), np.concatenate([n, times])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else order
        pairs, n = both[first], np.add.reduceat(counts, first) if len(first) else counts
    return pairs, n


def counted_batches(given: Iterator[pa.RecordBatch], a_len: np.ndarray, b_len: np.ndarray, cache: str) -> Iterator[pa.RecordBatch]:
    """batch, pair, n of stored batches.  Texts are all encoded by then: what the worker remembers for that goes."""
    worker_cache(cache).clear()
    for part in given:
        for k in range(part.num_rows):
            row = part.slice(k, 1).to_pylist()[0]
            pairs, n = count_pairs(pieces_of(row, a_len, b_len), a_len, b_len)
            yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(pairs), type=pa.int64()), pa.array(pairs), pa.array(n)], names=["batch", "pair", "n"])


def batch_pairs(batches: DataFrame, a_len: np.ndarray, b_len: np.ndarray, cache: str) -> DataFrame:
    """batch, pair, n: links of every id pair of a batch."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return counted_batches(given, a_len, b_len, cache)

    return batches.mapInArrow(run, "batch long, pair long, n long")


def parts(batches: DataFrame, counted: DataFrame, a_len: np.ndarray, b_len: np.ndarray) -> DataFrame:
    """One row for each piece: sums over its links, its whole groups, and the loose ends of groups that run over its borders."""
    kind = {f.name: f.dataType.simpleString() for f in batches.schema["pieces"].dataType.elementType}["doc_id"]
    schema = batches.sparkSession.createDataFrame([], PARTS.format(id=kind)).schema
    arrow = to_arrow_schema(schema)

    held: list[Spelling] = []  # made once in a task

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not held:
            held.append(Spelling(len(a_len), len(b_len)))
        spell = held[0]
        pairs, n, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        order = np.unique(pairs, return_index=True)[1]
        pairs, n, best = pairs[order], n[order], best[order]
        out = []
        for pieces in (some for stored_row in left.to_pylist() for some in runs(pieces_of(stored_row, a_len, b_len))):
            m = merge(pieces, a_len, b_len)
            at = np.searchsorted(pairs, pair_of(m))
            add = lambda values: np.bincount(m.link_piece, values, len(pieces)) if len(at) else np.zeros(len(pieces))
            links, good = add(None), add(best[at])
            total = np.zeros(len(pieces), dtype=np.int64)
            np.add.at(total, m.link_piece, n[at])
            for k, p in enumerate(pieces):
                a, b = p["a"].astype(np.int64), p["b"].astype(np.int64)
                first = int(m.cuts[k - 1]) if k else 0
                groups = int(m.cuts[k]) - first
                ga, gb = m.a_group[m.a_from[k] : m.a_from[k + 1]] - first, m.b_group[m.b_from[k] : m.b_from[k + 1]] - first
                low = 1 if p["piece"] and groups else 0  # the first group may have begun before this piece
                whole_a, whole_b = slice(*np.searchsorted(ga, [low, groups])), slice(*np.searchsorted(gb, [low, groups]))
                body = spell.groups(a[whole_a], b[whole_b], ga[whole_a] - low, gb[whole_b] - low)
                row = {c: p[c] for c in ("key", "doc_id", "piece", "pieces")}
                row |= {"n_a": len(a), "n_b": len(b), "n_groups": groups, "n_links": int(links[k]), "n_best": int(good[k]), "count_sum": int(total[k])}
                if p["pieces"] == 1:
                    row["body"] = hashlib.sha256(body[:-1]).hexdigest() if body else ""
                else:
                    row |= {"body": body.decode(), "a_head": a[: whole_a.start], "b_head": b[: whole_b.start], "a_tail": a[whole_a.stop :], "b_tail": b[whole_b.stop :]}
                out.append(row)
        return pa.Table.from_pylist(out, schema=arrow)

    return batches.groupBy("batch").cogroup(counted.groupBy("batch")).applyInArrow(run, schema)


def stitch(cut_up: DataFrame) -> DataFrame:
    """Documents of several pieces: loose ends joined in the order of the pieces."""
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    fields = F.struct("piece", "n_groups", "body", "a_head", "b_head", "a_tail", "b_tail")
    gathered = cut_up.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in sums], F.array_sort(F.collect_list(fields)).alias("own"))

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in given:
            done = []
            for own in part.column(1).to_pylist():
                digest, a, b, mark = hashlib.sha256(), [], [], ""

                def close():
                    digest.update((mark + ",".join(map(str, a)) + "|" + ",".join(map(str, b))).encode())

                for p in own:
                    # a piece without a cut is all tail
                    if p["n_groups"]:
                        if p["piece"]:
                            a, b = a + p["a_head"], b + p["b_head"]
                            close()
                            mark = ";"
                        if p["body"]:
                            digest.update((mark + p["body"][:-1]).encode())
                            mark = ";"
                        a, b = p["a_tail"], p["b_tail"]
                    else:
                        a, b = a + p["a_head"] + p["a_tail"], b + p["b_head"] + p["b_tail"]
                if a or b:
                    close()
                done.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, type=pa.string())], names=["key", "sha"])

    signed = gathered.select("key", "own").mapInArrow(run, "key string, sha string")
    return gathered.drop("own").join(signed, "key").select("doc_id", *sums, F.col("sha").alias("groups_sha256"))


@contextmanager
def handed_over(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows go to a Python worker at once; what the session had is set again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text", piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    a_len, b_len = Tokenizers(a_path, b_path).lengths()
    with handed_over(df.sparkSession, TEXTS):
        batches = keep(to_batches(df, a_path, b_path, id_col, text, piece, batch), "token-batches")
    found = keep(batch_pairs(batches, a_len, b_len, cache_name(a_path, b_path)), "batch-pairs")
    counts = keep(found.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    b_id = F.shiftright("pair", 32)
    best = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most"))  # at most one row for each id of B
    judged = counts.join(F.broadcast(best), b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))
    counted = found.select("batch", "pair").join(judged, "pair")
    made = keep(parts(batches, counted, a_len, b_len), "aligned-pieces")
    single = made.filter("pieces = 1").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("body").alias("groups_sha256"))
    return single.unionByName(stitch(made.filter("pieces > 1")))
