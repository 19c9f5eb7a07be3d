"""SimHash components, hard negatives and tokenizer alignment against brute force, with nulls, empty and long inputs, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import tracemalloc
import re

import numpy as np
import pytest

pytest.importorskip("plangauge.llm")

from pyspark.sql import functions as F  # noqa: E402

from plangauge.llm import alignment, hard_negatives, simhash, token_planes  # noqa: E402
from plangauge.llm.catalog import CATALOG, tokenizer_path  # noqa: E402

CLASHES = "fp long, mask long, key string, node long, label2 string, first long, least long, piece int, batch int, rank int, own string, part int, block int, width int, best int, x int, h1 long"


def _table(spark, rows, schema):
    """Rows with nulls under every name that the operators use inside."""
    extra = len(CLASHES.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * extra for r in rows], f"{schema}, {CLASHES}")


def _components(ids, linked):
    label = {i: i for i in ids}

    def find(a):
        while label[a] != a:
            label[a] = label[label[a]]
            a = label[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# SimHash -------------------------------------------------------------------------------


def _fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _by_brute_force(rows):
    fps = [_fingerprint(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    of_row = _components(range(len(rows)), near)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[of_row[k]] = min(i, least.get(of_row[k], i))
    return collections.Counter((i, f"{fps[k]:016x}", least.get(of_row[k])) for k, (i, _) in enumerate(rows))


def _near_texts(rng):
    base = [f"w{rng.randint(0, 900)}" for _ in range(600)]
    texts = [" ".join(base)]
    for _ in range(12):
        other = list(base)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(600)] = "other"
        texts.append(" ".join(other))
    return texts


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "one", "One", "two words", "a b c d", "A B C D", "é É ß", "x\x1cy z", " ".join(f"v{k}" for k in range(30_000)), *_near_texts(rng)]
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    rows = list(enumerate(texts)) + [(3, "one"), (3, "one"), (7, texts[11]), (None, "one"), (None, "only here, without an id"), (None, None)]
    found = simhash.near_components(_table(spark, rows, "doc_id long, text string"))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert collections.Counter(map(tuple, found.collect())) == _by_brute_force(rows)
    assert simhash.near_components(_table(spark, [], "doc_id long, text string")).count() == 0


def test_simhash_query_equals_brute_force_on_the_given_documents(spark, data):
    found = CATALOG.queries["op11_covering_simhash"](spark, data)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, found.collect())) == _by_brute_force(rows)


def test_masks_cover_every_set_of_differing_bits():
    rng = random.Random(1)
    for free in (list(range(64)), list(range(3, 60, 2)), [1, 5, 9, 11, 40]):
        masks = simhash.covering_masks(free)
        assert len(masks) == 31 and all(m & ~sum(1 << p for p in free) == 0 for m in masks)
        for _ in range(2000):
            differing = sum(1 << p for p in rng.sample(free, 4))
            assert any(m & differing == 0 for m in masks)
    # a pair under a finer mask agrees on everything the mask before asked for
    assert all(finer & 0xFFFF == 0xFFFF for finer in simhash.finer_masks(0xFFFF))


def test_large_buckets_are_split_and_lose_no_link(spark):
    rng = random.Random(2)
    fps = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64)):
        for _ in range(220):
            x = centre
            for _ in range(rng.randint(1, 8)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    nodes = spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")
    found = [(a % 2**64, b % 2**64) for a, b in map(tuple, simhash.links(nodes, limit=100).collect())]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    ordered = sorted(fps)
    every = [(a, b) for k, a in enumerate(ordered) for b in ordered[:k] if (a ^ b).bit_count() <= 4]
    assert _components(ordered, found) == _components(ordered, every)
    assert len(simhash.forest(np.array(ordered, dtype=np.uint64))) < len(ordered)


# Hard negatives ------------------------------------------------------------------------


@pytest.mark.parametrize("bound, width, n", [(200, 64, 999), (3, 5, 7), (2**20, 64, 60), (2**29, 10, 33), (1, 1, 1), (7, 0, 4)])
def test_packed_products_are_exact(bound, width, n):
    rng = np.random.default_rng(bound)
    vectors, anchor = rng.integers(-bound, bound + 1, (n, width)), rng.integers(-bound, bound + 1, width)
    vectors[0], vectors[-1] = bound, -bound
    for a in (anchor, np.full(width, bound), np.full(width, -bound)):
        want = [sum(int(x) * int(y) for x, y in zip(row, a)) for row in vectors]
        assert list(map(int, hard_negatives.Packed(vectors, bound).scores(a))) == want


def _mined(rows):
    import math

    rows = [r for r in rows if None not in r and all(x is not None and math.isfinite(x) for x in r[2])]
    best = {}
    for i, y, v in rows:
        y, v = ((y + 1) % 10 if i % 7 == 0 else y), [math.floor(256 * x) for x in v]
        if i not in best or (y, v) < best[i]:
            best[i] = (y, v)
    out = set()
    for a in (i for i in best if i % 100 == 0):
        score = {i: sum(x * z for x, z in zip(best[a][1], v)) for i, (_, v) in best.items() if len(v) == len(best[a][1])}
        order = sorted((i for i in score if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in order if best[i][0] == best[a][0]][:5]:
            fits = [i for i in order if best[i][0] != best[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out |= {(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fits)}
    return out


def _query(df, **options):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(df, F.col("vec_id") % 100 == 0, label=label, **options)


SCHEMA = "vec_id long, label int, embedding array<float>"


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 3), [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]) for i in range(420)]
    rows += [rows[100], rows[100], (101, 1, rows[5][2]), (200, None, rows[0][2]), (900, 1, None), (1000, 1, [1.0, None, 0.5, 1.0]), (1001, 1, [float("nan")] * 4)]
    rows += [(1002, 2, [float("inf"), 0.0, 0.0, 0.0]), (None, 1, rows[1][2]), (1100, 1, [0.5, 0.25]), (1101, 1, [0.5, 0.5]), (1102, 2, [0.25, 0.25]), (1200, 1, []), (1201, 1, []), (1300, 77, rows[3][2])]
    for options in ({}, {"candidates_a_block": 100, "anchors_a_block": 2}):
        found = _query(_table(spark, rows, SCHEMA), **options)
        assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(set(got)) and set(got) == _mined(rows)
    assert _query(_table(spark, [], SCHEMA)).count() == 0


def test_hard_negatives_of_large_components(spark):
    rng = random.Random(6)
    rows = [(i, i % 3, [rng.uniform(-(2.0**20), 2.0**20) for _ in range(3)]) for i in range(150)]
    rows = [(i, y, [float(np.float32(x)) for x in v]) for i, y, v in rows]
    assert {tuple(r) for r in _query(_table(spark, rows, SCHEMA)).collect()} == _mined(rows)


# Alignment -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizers():
    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def _aligned(rows, paths):
    made, counts = [], collections.Counter()
    both = alignment.Tokenizers(*paths)
    for i, t in rows:
        a, b = (x.tolist() for x in both.encode([t])[0])
        ends = [np.cumsum([len(side[x]) for x in ids]).tolist() for ids, side in ((a, both.a_bytes), (b, both.b_bytes))]
        links, x, y, first, groups = [], 0, 0, (0, 0), []
        while x < len(a):
            links.append((a[x], b[y]))
            at_a, at_b = ends[0][x], ends[1][y]
            x, y = x + (at_a <= at_b), y + (at_b <= at_a)
            if at_a == at_b:
                groups.append("|".join(",".join(map(str, ids)) for ids in (a[first[0] : x], b[first[1] : y])))
                first = (x, y)
        counts.update(links)
        made.append((i, a, b, groups, links))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    sha = lambda groups: hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
    return collections.Counter(
        (i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha(groups)) for i, a, b, groups, links in made
    )


def test_alignment_equals_brute_force_at_every_piece_size(spark, tokenizers):
    rng = random.Random(8)
    letters = "ab é日ß½ﬁ🎉▁<0x41>\n\t\x00\x01 .,'ＡİŞ"
    texts = [None, "", " ", "a", "<|endoftext|> x </s> <unk>", "x▁y", "  two  spaces \n", "naïve café's don't 日本語 🎉🎉", "́a", "é ﻿ ​ x"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(40)] + [" ".join(f"word{k}tail" for k in range(3000))]
    rows = list(enumerate(texts)) + [(3, "a"), (3, "a"), (4, "other"), (None, "no id"), (None, None)]
    table, want = _table(spark, rows, "doc_id long, text string"), _aligned(rows, tokenizers)
    for options in ({}, {"piece": 50, "batch": 400}, {"piece": 3, "batch": 60}):
        found = alignment.align(table, *tokenizers, **options)
        assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert collections.Counter(map(tuple, found.collect())) == want
    assert alignment.align(_table(spark, [], "doc_id long, text string"), *tokenizers).count() == 0


def test_alignment_query_equals_brute_force_on_the_given_documents(spark, data, tokenizers):
    found = CATALOG.queries["op13_token_alignment"](spark, data)
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, found.collect())) == _aligned(rows, tokenizers)


def test_token_bytes_spell_the_text(tokenizers):
    both = alignment.Tokenizers(*tokenizers)
    text = "plain words, ünïcode 日本 \U0001f389 and <|endoftext|>"
    (a, b) = both.encode([text])[0]
    assert b"".join(both.a_bytes[i] for i in a) == b"".join(both.b_bytes[i] for i in b) == f" {text}".encode()
    assert [len(x) for x in both.encode(["x▁y"])[0]] == [0, 0]  # a letter that stands for space: B spells another text


def test_texts_cut_at_spaces_have_the_ids_of_whole_texts(tokenizers):
    rng = random.Random(12)
    both = alignment.Tokenizers(*tokenizers)
    assert both.cuttable
    blocks = [(0x20, 0x7F)] * 5 + [(0, 0x21), (0x80, 0x250), (0x80, 0x250), (0x250, 0x3000), (0x3000, 0xD7FF), (0xFB00, 0xFFFF), (0x10000, 0x1F9FF)]
    texts = ["".join(chr(rng.randrange(*rng.choice(blocks))) + rng.choice(["", "", " ", " ", "  ", "\n", " 's", "\u2581 "]) for _ in range(rng.randint(1, 16))) for _ in range(30_000)]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        firsts = both.a.encode_batch_fast([f" {t}" for t in some], add_special_tokens=False)
        for t, first, second, (a, b) in zip(some, firsts, both.b.encode(some, num_threads=1), both.encode(some)):
            spelled = b"".join(both.a_bytes[i] for i in first.ids) == b"".join(both.b_bytes[i] for i in second) == f" {t}".encode()
            assert [a.tolist(), b.tolist()] == ([first.ids, second] if spelled else [[], []]), t


def test_pieces_of_the_merge_path_have_equal_work_and_part_no_tie():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (np.array(sorted(rng.sample(range(1, 80), rng.randint(1, 40)))) for _ in range(2))
        for diagonal in range(len(a) + len(b) + 1):
            i, j = alignment.crossing(a, b, diagonal)
            assert i + j in (diagonal, diagonal + 1)
            assert not (i and j < len(b)) or a[i - 1] < b[j]
            assert not (j and i < len(a)) or b[j - 1] < a[i]


def _pieces(both, texts):
    a_len, b_len = both.lengths()
    found = [p | {"n_a": len(p["a"]), "n_b": len(p["b"])} for a, b in both.encode(texts) for p in alignment.cut(a, b, a_len, b_len, alignment.PIECE)]
    return found, a_len, b_len


def test_a_batch_of_a_million_ends_is_merged_in_bounded_memory(tokenizers):
    rng = random.Random(13)
    words = ["".join(rng.choice("aeioustrnlmé日") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=k)) for k in [500] * 100 + [0, 1, 150_000]]
    pieces, a_len, b_len = _pieces(alignment.Tokenizers(*tokenizers), texts)
    ends = sum(p["n_a"] + p["n_b"] for p in pieces)
    assert ends > 900_000 and max(p["pieces"] for p in pieces) > 1
    some = list(alignment.runs(pieces))
    assert [p for run in some for p in run] == pieces and all(len(run) == 1 or sum(p["n_a"] + p["n_b"] for p in run) <= alignment.RUN for run in some)
    pairs, n = np.unique(alignment.pair_of(alignment.merge(pieces, a_len, b_len)), return_counts=True)
    tracemalloc.start()
    try:
        got = alignment.count_pairs(pieces, a_len, b_len)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert got[0].tolist() == pairs.tolist() and got[1].tolist() == n.tolist()
    assert peak < 40 * ends  # all in one go: some 120


def test_no_pairs_of_texts_without_tokens(tokenizers):
    found = alignment.count_pairs(*_pieces(alignment.Tokenizers(*tokenizers), [None, ""]))
    assert [x.tolist() for x in found] == [[], []]


def test_encoded_texts_are_forgotten_before_pairs_are_counted(tokenizers):
    both = alignment.Tokenizers(*tokenizers)
    both.encode(["words to remember"])
    assert both.known["a"]
    assert list(alignment.counted_batches(iter([]), *both.lengths(), alignment.cache_name(*tokenizers))) == []
    assert not both.known


def test_parts_learned_together_have_the_ids_of_parts_learned_alone(tokenizers):
    rng = random.Random(21)
    both, (a_len, b_len) = alignment.Tokenizers(*tokenizers), alignment.Tokenizers(*tokenizers).lengths()
    parts = list({"".join(rng.choice("abcdeéèß'.,#$09日\n▁½") for _ in range(rng.randint(1, 9))) for _ in range(3000)})
    both.known.clear()
    calls, whole = [], both.a
    both.a = type("Counting", (), {"encode_batch_fast": lambda self, texts, **kw: calls.append(len(texts)) or whole.encode_batch_fast(texts, **kw)})()
    both._learn(parts)
    assert sum(calls) < len(parts)  # one by one: as many texts as parts
    a_known, b_known = both.known["a"], both.known["b"]
    for p, first, b in zip(parts, whole.encode_batch_fast([f" {p}" for p in parts], add_special_tokens=False), both.b.encode(parts)):
        spelled = b"".join(both.a_bytes[i] for i in first.ids) == b"".join(both.b_bytes[i] for i in b) == f" {p}".encode()
        got = [np.frombuffer(known[p], dtype=kind).tolist() for known, kind in ((a_known, both.a_type), (b_known, both.b_type))]
        assert got == ([first.ids, b] if spelled else [[], []]), p


def test_ids_stay_right_while_learned_parts_are_forgotten(tokenizers):
    rng = random.Random(22)
    both = alignment.Tokenizers(*tokenizers)
    texts = [" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 60)}" for _ in range(20)) for _ in range(200)] + ["x▁y z", None]
    want = [[x.tolist() for x in both.encode([t])[0]] for t in texts]
    both.known.clear()
    both.limit = 40
    for at in range(0, len(texts), 3):
        assert [[x.tolist() for x in sides] for sides in both.encode(texts[at : at + 3])] == want[at : at + 3]


def test_a_worker_loads_its_tokenizers_once(tokenizers):
    first = alignment.worker_tokenizers(*tokenizers)
    assert alignment.worker_tokenizers(*tokenizers) is first
    assert list(alignment.counted_batches(iter([]), *first.lengths(), alignment.cache_name(*tokenizers))) == []
    assert not first.known  # the worker drops them with what they remember


def test_pieces_that_are_soon_made_again_are_forgotten_first():
    encoder = token_planes.Encoder(tokenizer_path())
    encoder.known.clear()
    encoder.limit = 40
    words = ["".join(random.Random(k).choices("abcdefgh", k=9)) for k in range(25)]
    texts = [" ".join(words)] + [" ".join(f"{w}{mark}" for w in words[k : k + 8]) for mark in (".", ",", "!?") for k in (0, 8, 16)]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    learned = []
    learn = encoder._learn
    encoder._learn = lambda tokenizer, mark, pieces: (learned.extend(pieces), learn(tokenizer, mark, pieces))
    assert [encoder([t])[0] for t in texts] == want
    assert sorted(learned) == sorted({w.encode() for w in words} | {b".", b",", b"!?"})  # no word is learned again
    encoder.known.clear()


def test_words_are_remembered_without_the_marks_behind_them():
    encoder = token_planes.Encoder(tokenizer_path())
    text = "Word, word. wörd! (word) x1; don't? \u0130, a.b, ... WÖRD.\u0301 日本, c."
    for t in (text, text.split(" \u0130")[0]):  # with and without characters from U+0300 on, with which words are left whole
        encoder.known.clear()
        assert np.frombuffer(encoder([t])[0], dtype="<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert {b"word", "wörd".encode(), b"x1", b"don't", b",", b".", b"?"} <= set(encoder.known)
    assert not {b"word.", "wörd!".encode(), b"x1;", b"don't?"} & set(encoder.known)
    encoder.known.clear()


def test_a_worker_loads_its_encoder_once_and_drops_it_when_texts_are_encoded():
    first = token_planes.worker_encoder(tokenizer_path())
    assert token_planes.worker_encoder(tokenizer_path()) is first
    first(["words to remember"])
    assert first.known
    token_planes.forget_encoders()
    assert not first.known and token_planes.worker_encoder(tokenizer_path()) is not first
    token_planes.forget_encoders()
