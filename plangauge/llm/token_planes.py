"""Token ids in a binary format: byte planes of fixed-size blocks, each plane compressed, with a chunk index.

Documents are encoded in ascending id order, or in an order that is given; their ids, with the end id behind each
document, form one stream per shard.  The stream is cut into blocks of ``block_ids`` 32-bit
ids, a block is transposed into its four byte planes, and each plane is a zstandard frame.

A stored data set has two tables in one folder: ``blocks`` (shard, block, n_ids, the planes as one
binary, and the documents that end in the block) and ``index`` (shard, first_id, n_ids, n_docs, blocks,
compressed bytes).  Reading takes one pass over the blocks of a shard with one block in memory.

Null texts are empty and give the end id alone.  Null ids sort first; equal ids are
ordered by the hash of their text.  Documents of an equal place in a given order come in any order.  An empty table gives empty tables.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from plangauge.session import new_work_dir

END_ID = 2
BLOCK_IDS = 1 << 16
# Texts that are encoded at once.
SLICE = 1024


@dataclass(frozen=True)
class PlaneFormat:
    """``bits`` splits into 32 bit planes, else into 4 byte planes."""

    block_ids: int = BLOCK_IDS
    bits: bool = False
    level: int = 1

    def pack(self, ids: np.ndarray) -> bytes:
        """A table of plane lengths followed by the compressed planes."""
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=self.level).compress
        raw = ids.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
        if self.bits:
            planes = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
        else:
            planes = np.ascontiguousarray(raw.T)
        frames = [squeeze(p.tobytes()) for p in planes]
        return struct.pack(f"<B{len(frames)}I", len(frames), *map(len, frames)) + b"".join(frames)

    @staticmethod
    def unpack(packed: bytes, n_ids: int) -> np.ndarray:
        import zstandard

        count = packed[0]
        sizes = struct.unpack_from(f"<{count}I", packed, 1)
        at, planes = 1 + 4 * count, []
        expand = zstandard.ZstdDecompressor().decompress
        for size in sizes:
            planes.append(np.frombuffer(expand(packed[at : at + size]), dtype=np.uint8))
            at += size
        if count == 32:
            bits = np.unpackbits(np.vstack(planes), axis=1, bitorder="little")[:, :n_ids].T
            raw = np.packbits(bits, axis=1, bitorder="little")
        else:
            raw = np.vstack(planes).T
        return np.ascontiguousarray(raw).view("<u4").ravel()


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# First bytes of U+0300 and beyond: combining marks begin there.  Characters below are in normal form and are lower-cased one by one.
BEYOND = bytes(range(0xCC, 0x100))
# Latin letters below U+0250 but U+0130, whose lower case ends in a mark: lead bytes and what may follow them.
LATIN = [(rb"\xc3", rb"[\x80-\x96\x98-\xb6\xb8-\xbf]"), (rb"\xc4", rb"[\x80-\xaf\xb1-\xbf]"), (rb"[\xc5-\xc8]", rb"[\x80-\xbf]"), (rb"\xc9", rb"[\x80-\x8f]")]
WORD = re.compile(rb"(?:[a-z]++|" + rb"|".join(a + b for a, b in LATIN) + rb")+")


def of_bytes(own: bytes) -> np.ndarray:
    """Whether each byte value is one of these."""
    return np.isin(np.arange(256), np.frombuffer(own, dtype=np.uint8))


BLANKS, ENDINGS = of_bytes(b" \t\n\v\f\r"), of_bytes(b"!#$%&*+,-./:;<=>?@\\^_`|~()[]{}\"")
LETTERED = np.zeros((256, 256), dtype=bool)  # the last two bytes of a text that ends in a letter or digit
LETTERED[:, of_bytes(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True
for x in range(0xC3, 0xCA):
    LETTERED[x, [y for y in range(0x80, 0xC0) if WORD.fullmatch(bytes([x, y]))]] = True
MARK = "\x01"

# The normalization and the splitting under which texts may be cut at blanks, and in front of marks behind a letter or digit.
CUTTABLE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: itself where it is a printing Latin-1 character, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


# The letters of all bytes in turn; blanks stay, they part words.
LETTERS = "".join(" " if b == 0x20 else c for c, b in sorted(byte_letters().items(), key=lambda x: x[1]))


def worker_cache(name: str) -> dict:
    """A dict that outlives the task in a Python worker that Spark uses again."""
    home = sys.modules.setdefault("plangauge_worker_cache", types.ModuleType("plangauge_worker_cache"))
    return home.__dict__.setdefault(name, {})


def can_be_cut(tokenizer) -> bool:
    """Whether the loaded tokenizer normalizes and splits as :data:`CUTTABLE` says, and its added tokens all start with ``<|``."""
    made = json.loads(tokenizer.to_str())
    model, added = made["model"], made["added_tokens"]
    plain = model["type"] == "BPE" and not model["dropout"] and not made["truncation"] and not made["padding"]
    return plain and all(made[k] == v for k, v in CUTTABLE.items()) and all(t["content"].startswith("<|") and not t["normalized"] for t in added)


def bytes_of(values: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; ``to_pylist`` makes a scalar of each and takes ten times as long."""
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset : values.offset + len(values) + 1].tolist() if len(values) else [0]
    raw = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes() if len(values) else b""
    return list(map(raw.__getitem__, map(slice, offsets, offsets[1:])))


def words_of(plain: list[bytes], others: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Blank-separated words of all texts, one behind the other, and where those of each text end.

    In ``plain`` texts, marks behind a letter or digit and in front of a blank are a word of their own.
    """
    first = b" " + b"".join(x + b" " for x in plain)
    flat = np.frombuffer(first + b"".join(x + b" " for x in others), dtype=np.uint8)
    inside, marks = ~BLANKS[flat], ENDINGS[flat[: len(first)]]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    # runs of marks: texts start and end with a blank
    edges = np.flatnonzero(marks[1:] != marks[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    begins[starts[LETTERED[flat[starts - 2], flat[starts - 1]] & ~inside[ends]]] = True
    at = np.flatnonzero(begins)
    offsets = np.append(np.cumsum(inside)[at] - 1, np.count_nonzero(inside))
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat[inside])])
    return words, np.searchsorted(at, np.cumsum([len(x) + 1 for x in (*plain, *others)], dtype=np.int64))


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    A tokenizer that :func:`can_be_cut` gives a text the ids of its blank-separated pieces in turn: no normal form reaches over a
    blank, and no split holds one.  In texts of characters below U+0300, which normalization only lower-cases, marks behind a Latin letter
    or digit are a split of their own; the one letter whose lower case ends in a mark, U+0130, is left whole.  Different pieces of the texts
    that are given are looked up once, those not known are encoded together, and up to ``limit`` of them are remembered.  Texts that may hold
    an added token or the mark that parts pieces, and all texts of any other tokenizer, are encoded as they are.
    """

    limit = 300_000
    together = 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cuttable = can_be_cut(self.tokenizer)
        # words of Latin letters are one split each; they are given in lower case and in the letters of their bytes, to the same model
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[bytes, bytes] = worker_cache(path)

    def _learn(self, tokenizer, mark: str, pieces: list[bytes]) -> None:
        ids_of = lambda texts: [np.array(e.ids, dtype="<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        given = lambda raw: codecs.charmap_decode(raw.decode("utf-8").lower().encode("utf-8"), "strict", LETTERS)[0] if tokenizer is self.letters else raw.decode("utf-8")
        mark_id, step = ids_of([f"a {mark}"])[0][-1], self.together
        glue = f" {mark} ".encode()
        for at in range(0, len(pieces), 64 * step):
            groups = [pieces[i : i + step] for i in range(at, min(at + 64 * step, len(pieces)), step)]
            for group, ids in zip(groups, ids_of([given(glue.join(g)) for g in groups])):
                ends = (4 * np.flatnonzero(ids == mark_id)).tolist()
                raw = ids.tobytes()
                self.known.update(zip(group, [raw[a:b] for a, b in zip([0, *[e + 4 for e in ends]], [*ends, len(raw)])]))

    def _found(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of different pieces."""
        known = self.known
        found = list(map(known.get, pieces))
        places = [k for k, ids in enumerate(found) if ids is None]
        if len(known) + len(places) > self.limit:  # the first learned are the most frequent: they stay
            for p in list(known)[3 * self.limit // 4 :]:
                del known[p]
        words, others = [], []
        for p in map(pieces.__getitem__, places):
            (words if p.isalpha() or WORD.fullmatch(p) else others).append(p)
        self._learn(self.letters, "0", words)
        self._learn(self.tokenizer, MARK, others)
        for k in places:
            found[k] = known[pieces[k]]
        return found

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        out, plain, others = [b""] * len(texts), {}, {}
        for i, t in enumerate(texts):
            raw = t.encode("utf-8") if t else b""
            if not raw:
                continue
            if not self.cuttable or b"<|" in raw or b"\x01" in raw:
                out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
            elif raw.isascii() or len(raw.translate(None, BEYOND)) == len(raw):
                plain[i] = raw.translate(LOWER)
            else:
                others[i] = b" ".join([p if len(p.translate(None, BEYOND)) < len(p) else p.translate(LOWER) for p in raw.split()])
        words, upto = words_of(list(plain.values()), list(others.values()))
        coded = words.dictionary_encode()
        ids = pa.array(self._found(bytes_of(coded.dictionary)), type=pa.large_binary()).take(coded.indices)
        ends = np.append(0, np.frombuffer(ids.buffers()[1], dtype=np.int64)[1 : len(ids) + 1])[upto].tolist()
        stream = memoryview(ids.buffers()[2] or b"")
        for i, begin, end in zip((*plain, *others), [0, *ends], ends):
            out[i] = stream[begin:end].tobytes()
        return out


def worker_encoder(path: str) -> Encoder:
    """The encoder of a worker, loaded once for all its tasks."""
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = Encoder(path)
    return cache[path]


def forget_encoders() -> None:
    """Texts are all encoded: what the worker loaded and remembers for that goes."""
    cache = worker_cache("encoders")
    for encoder in cache.values():
        encoder.known.clear()
    cache.clear()


BLOCK_SCHEMA = "shard int, block int, n_ids int, planes binary, docs array<struct<id:{id},end:int>>"


def row_order(df: DataFrame) -> list[Column]:
    """Columns that sort the rows of ``df`` as they stand: by the files that Spark wrote for its partitions and the rows in them, else by partition.

    A file table is read in another order than it was written (large files first), so its partitions do not tell.
    """
    if df._jdf.queryExecution().analyzed().children().isEmpty():
        try:
            df.select("_metadata.file_name", "_metadata.row_index")
        except AnalysisException:  # not files, or files that do not number their rows
            return [F.monotonically_increasing_id()]
        name = F.col("_metadata.file_name")
        part, piece = (F.regexp_extract(name, at, 1).try_cast("long") for at in (r"^part-(\d+)", r"-c(\d+)\."))
        return [part, piece, F.when(part.isNull(), name), F.col("_metadata.row_index")]
    return [F.monotonically_increasing_id()]


def write(
    df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text: str = "text", end_id: int = END_ID, fmt: PlaneFormat = PlaneFormat(),
    shards: int | None = None, order: list[Column] | None = None,
) -> None:
    """Encode and store. Shards are ranges of ids, or of ``order``, one task each; a retried task replaces its own output."""
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = [F.xxhash64(text).alias("tie")] if order is None else [c.alias(f"place{k}") for k, c in enumerate(order)]
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"), *places)
    by = [F.col(c).asc_nulls_first() for c in (["id", "tie"] if order is None else rows.columns[2:])]
    ranged = rows.repartitionByRange(shards, *by).sortWithinPartitions(*by)
    schema = spark.createDataFrame([], BLOCK_SCHEMA.format(id=dict(rows.dtypes)["id"])).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard = worker_encoder(tokenizer), TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        waiting, ends, block = bytearray(), [], 0

        def flush(size: int):
            nonlocal block, ends
            ids = np.frombuffer(bytes(waiting[: 4 * size]), dtype="<u4")
            del waiting[: 4 * size]
            inside = [x for x in ends if x["end"] <= size]
            ends = [{"id": x["id"], "end": x["end"] - size} for x in ends[len(inside) :]]
            row = {"shard": shard, "block": block, "n_ids": size, "planes": fmt.pack(ids), "docs": inside}
            block += 1
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for i, raw in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist())):
                    waiting += raw + end
                    ends.append({"id": i, "end": len(waiting) // 4})
                    while len(waiting) >= 4 * fmt.block_ids:
                        yield flush(fmt.block_ids)
        if waiting:
            yield flush(len(waiting) // 4)

    ranged.mapInArrow(run, schema).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks").select("shard", "block", "n_ids", F.size("docs").alias("n_docs"), F.length("planes").alias("bytes"))
    by_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"), F.count("*").alias("blocks"), F.sum("bytes").alias("bytes"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per shard
    by_shard.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).write.parquet(f"{path}/index")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids themselves if asked), from the stored blocks."""
    blocks, index = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/index")
    kind = blocks.schema["docs"].dataType.elementType["id"].dataType.simpleString()
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lined = blocks.repartition(shards, "shard").sortWithinPartitions("shard", "block")
    schema = spark.createDataFrame([], f"shard int, doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        shard, base, begin, crc, open_ids = None, 0, 0, 0, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["shard"] != shard:
                    shard, base, begin, crc, open_ids = row["shard"], 0, 0, 0, []
                raw, at, out = PlaneFormat.unpack(row["planes"], row["n_ids"]).tobytes(), 0, []
                for doc in row["docs"]:
                    piece = raw[4 * at : 4 * doc["end"]]
                    crc = zlib.crc32(piece, crc)
                    at = doc["end"]
                    made = {"shard": shard, "doc_id": doc["id"], "start": begin, "n_tokens": base + at - begin, "ids_crc32": crc}
                    if with_ids:
                        made["ids"] = b"".join([*open_ids, piece])
                    out.append(made)
                    begin, crc, open_ids = base + at, 0, []
                rest = raw[4 * at :]
                crc = zlib.crc32(rest, crc)
                if with_ids and rest:
                    open_ids.append(rest)
                base += row["n_ids"]
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = lined.mapInArrow(run, schema).join(index.select("shard", "first_id"), "shard")
    return found.withColumn("start", F.col("start") + F.col("first_id")).drop("shard", "first_id")


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write to the shared folder and read back."""
    path = new_work_dir(df.sparkSession, "token-planes")
    write(df, tokenizer, path, **options)
    return read(df.sparkSession, path)
