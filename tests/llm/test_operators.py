"""Every operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("plangauge.llm")

from plangauge.llm import decontaminate, host_rules, language, line_chunks, main_text, mixing, near_copies, quality, recompression, token_planes  # noqa: E402
from plangauge.llm.catalog import CATALOG, tokenizer_path  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, mix string, line_chunks int, lang_pred string, host string, words int"


def _prose(rng, n, kinds=400):
    return " ".join(f"w{min(int(rng.expovariate(0.01)), kinds)}{rng.choice('abc')}" for _ in range(n))


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    passage, copied = _prose(rng, 60), _prose(rng, 200)
    texts = [None, "", " \n\t ", "one", "the the " * 50, "ab cd " * 40, copied, copied, copied + " end", passage, "x\n" + passage + "\ny z"]
    texts += [_prose(rng, 80) + "\n" + passage + "\n" + _prose(rng, 30) for _ in range(3)]
    texts += [_prose(rng, rng.randint(1, 90)) for _ in range(15)] + [_prose(rng, 20_000), "é ü ñ 12 ### !! " * 9]
    near = copied.split()
    near[100] = "changed"
    texts += [" ".join(near), "l1 a\nl2 b\nl3 c\nl4 d\nl5 e\nl6 f", "q\nl1 a\nl2 b\nl3 c\nl4 d\nl5 e\nl6 f"]
    lines = "\n".join(f"line {k} of {k * k}" for k in range(40))
    texts += [lines, "first\nand second\n" + lines + "\nlast"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "a", "b", "a"][i % 4], None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], rows[6], (None, passage, "en", "b", *[None] * 7), (None, None, *[None] * 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def _multiset(rows):
    return collections.Counter(map(tuple, rows))


def test_letters_are_told_by_category():
    for nothing in (None, "", "\u00bd \u00b2", "\u2460", "12 \u0663", "\u0301 \u0301", "_-!", "\u2167"):
        assert language.letters_only(nothing) == []
    assert language.letters_only("\u0939\u093f\u0928\u094d\u0926\u0940 Don't A\u00e9\u00b2b") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "don", "t", "a\u00e9", "b"]
    import unicodedata

    for c in map(chr, range(0x300)):
        assert bool(language.letters_only(c)) == (unicodedata.category(c)[0] == "L")


def test_trained_language_model_against_brute_force(spark):
    """Word frequencies of a tiny sample, computed anew."""
    import math

    texts = [("aa", "ein ein zwei drei"), ("aa", "ein zwei"), ("bb", "one two two"), ("bb", "one one two three"), (None, "never learned")]
    model = language.train(spark.createDataFrame(texts, "lang string, text string"), min_count=1)
    assert model.languages == ("aa", "bb") and "never" not in model.words
    counts = {l: collections.Counter(w for k, t in texts if k == l for w in t.split()) for l in model.languages}
    kinds = len(set().union(*counts.values()))
    for word, found in model.words.items():
        logs = [math.log((counts[l][word] + 0.5) / (sum(counts[l].values()) + 0.5 * kinds + 1)) for l in model.languages]
        assert found == pytest.approx([x - sum(logs) / 2 for x in logs])
    assert set(model.words) == set().union(*counts.values())


def test_language_backs_off_and_rejects(spark, docs, empty):
    model = language.LanguageModel(("de", "en"), {"und": (1.0, -1.0), "and": (-1.0, 1.0)}, {2: {"ng": (-1.0, 1.0), "ch": (1.0, -1.0), "ic": (1.0, -1.0)}, 1: {"z": (1.0, -1.0)}})
    score = language.Scorer(model)
    assert score(None) == score("") == score(" 12 !?") == ("und", 0.0)
    assert score("und")[0] == "de" and score("AND!")[0] == "en"
    assert score("zz")[0] == "de"  # bigrams unknown, falls to letters
    assert score("日")[1] == pytest.approx(0.5)
    found = language.identify(docs, model)
    assert found.count() == docs.count() and found.columns.count("score") == 1 and "host" in found.columns
    assert language.identify(empty, language.train(empty)).count() == 0
    assert language.identify(docs, language.train(empty)).filter("lang_pred != 'und'").count() == 0


def test_recompression_equals_brute_force(docs, table, empty):
    windows = collections.Counter()
    for r in table:
        w = _words(r[1])
        windows.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    want = []
    for r in table:
        w = _words(r[1])
        gone = {j for k in range(len(w) - 34) if windows[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = recompression.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text").collect()
    assert _multiset(got) == _multiset(want)
    assert sum(x[2] for x in want) > 500
    assert recompression.remove_repeats(empty).count() == 0


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(3)
    for kinds in (1, 2, 3, 30):
        hashes = [rng.integers(1, kinds + 1, size=int(n)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in rng.integers(12, 200, size=8)]
        document, first, place, name, hashed = recompression.anchors(hashes, window=12)
        seen = {}
        for d, f, p, n, h in zip(document, first, place, name, hashed):
            window = tuple(hashes[d][f : f + 12].tolist())
            assert seen.setdefault(window, (p - f, n, h)) == (p - f, n, h)
            assert f <= p < f + 12


def test_host_rules(docs, table, empty):
    def brute(t):
        w, lines = _words(t), collections.Counter()
        grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeat = len({j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        dup = 0
        for line in (t or "").split("\n"):
            if _words(line):
                dup += lines[line] > 0
                lines[line] += 1
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, repeat, len(w) < 10 or 100 * repeat > 20 * len(w)

    got = host_rules.judge(docs).collect()
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert _multiset([[r[c] for c in columns] for r in got]) == _multiset([(r[0], *brute(r[1])) for r in table])
    assert all(r["kept"] == (not r["base_failed"] and not r["host_failed"]) for r in got)
    assert host_rules.judge(empty).count() == 0


def test_bad_host_takes_its_documents_along(spark):
    rows = [(i, "bad" if i < 30 else f"h{i % 8}", "short" if i < 28 or i == 31 else " ".join(f"w{i}x{k}" for k in range(40))) for i in range(200)]
    got = {r["doc_id"]: r for r in host_rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not got[29]["base_failed"] and got[29]["host_failed"] and not got[29]["kept"]
    assert got[40]["kept"] and not got[31]["kept"]


def test_decontamination(spark, docs, table, empty):
    items = [(1, " ".join(_words(table[9][1])[5:30]).upper()), (2, "W1a--ONE"), (3, "one"), (4, None), (5, "  ..."), (3, "one"), (None, "w2b")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = collections.defaultdict(set)
    for i, t in items:
        w = lower(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            known[tuple(w[k : k + 10])].update([str(i)] if i is not None else [])
    want = []
    for r in table:
        w, hit, found = lower(r[1]), set(), set()
        for p, ids in known.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit.update(range(k, k + len(p)))
                    found |= ids
        want.append((r[0], len(w), len(hit), tuple(sorted(found))))
    for block in (64_000_000, 40):  # one automaton, and blocks of it
        got = decontaminate.scan(docs, benchmark, block_chars=block, with_spans=True, carry=("text", "host")).collect()
        assert _multiset([(r[0], r[1], r[2], tuple(r[3])) for r in got]) == _multiset(want)
        for r in got:
            assert sum(len(lower(r["text"][s["start"] : s["end"]])) for s in r["spans"]) == r["n_hit"]
    assert decontaminate.scan(docs, benchmark.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.scan(empty, benchmark).count() == 0


def test_quality_learns_from_positives_and_unlabelled(spark, docs, empty):
    rng = random.Random(1)
    good = lambda: _prose(rng, 60)
    bad = lambda: " ".join(w + "***" for w in _prose(rng, 60).split())
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(600)]
    labels = [(i, 0 if i % 4 == 0 else 1) for i in range(600)]
    pages = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.train(pages, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert 0.6 < model.prior < 0.9
    held = [r for r in quality.score(pages, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    none = quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def test_near_copies(docs, table, empty):
    got = collections.defaultdict(set)
    for r in near_copies.near_copies(docs).collect():
        got[r["doc_id"]].add(r["class_id"])
    assert got[6] == got[7] == got[8] == {6}  # exact copies, one with a word more
    changed = next(i for i, t in enumerate(table) if t[1] and "changed" in t[1])
    assert got[changed] == {6}
    assert got[9] == {9} and got[None] == {9, 0}
    assert got[11] == {11} and got[3] == {3}
    stay = near_copies.keep_one(docs).select("doc_id").collect()
    assert len([r for r in stay if r[0] in (6, 7, 8, changed)]) == 1 and len([r for r in stay if r[0] == 9]) == 1
    assert near_copies.near_copies(empty).count() == 0 and near_copies.keep_one(empty).count() == 0


def test_alignment_is_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(1, 40))]
        b = [x for x in a if rng.random() > 0.06]
        b = [rng.randint(0, 30) if rng.random() < 0.05 else x for x in b] + [rng.randint(0, 30)] * rng.randint(0, 2)
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(row[j], old[j + 1]))
        true = row[-1] / (len(a) + len(b) - row[-1]) if b else 0
        got = near_copies.aligned(a, b)
        assert (got == pytest.approx(true)) if true >= 0.8 else got < 0.8


def test_links_through_a_centre_are_not_lost(spark):
    """b and c are alike, neither is like the centre a that both meet."""
    base = [f"t{k}" for k in range(300)]
    change = lambda w, at: [f"x{k}" if k in at else v for k, v in enumerate(w)]
    a, b = base, change(base, range(0, 300, 30))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(change(b, [295]))), (4, " ".join(change(a, [7])))]
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4)], "centre long, node long")
    verified = near_copies.verify(pairs, texts, 0.8)
    assert {(r["node"], r["linked"]) for r in verified.collect()} == {(2, False), (3, False), (4, True)}
    for block in (1, 128):
        links = {tuple(sorted(r)) for r in near_copies.compare_rest(verified, texts, 0.8, block).collect()}
        assert (2, 3) in links and not links & {(1, 2), (1, 3), (2, 4), (3, 4)}


def test_pairs_of_exactly_the_threshold_are_linked(spark):
    """Texts of 32 and 39 words: 28 shingles in 35. 4/9 of 63 is above 28 as a float."""
    rows, pairs = [(0, " ".join(f"c{k}" for k in range(40)))], []
    for i, n in enumerate((28, 52, 56, 60)):  # shingles of the shorter text; the longer has a quarter more
        long = [f"p{i}w{k}" for k in range(n * 5 // 4 + 4)]
        rows += [(2 * i + 1, " ".join(long[: n + 4])), (2 * i + 2, " ".join(long))]
        pairs += [(0, 2 * i + 1), (0, 2 * i + 2)]
    texts = spark.createDataFrame(rows, "node long, text string")
    verified = near_copies.verify(spark.createDataFrame(pairs, "centre long, node long"), texts, 0.8)
    links = {tuple(sorted(r)) for r in near_copies.compare_rest(verified, texts, 0.8).collect()}
    assert links == {(2 * i + 1, 2 * i + 2) for i in range(4)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (4, 3), (9, 8), (8, 7), (20, 21)] + [(30 + k, 31 + k) for k in range(12)]
    got = {r["node"]: r["label"] for r in near_copies.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20} | {30 + k: 30 for k in range(13)}


def _chunks(text, modulus=3):
    lines, out, run = text.split("\n"), [], []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    for i, line in enumerate(lines):
        run.append(line)
        if (h[i] + 31 * (h[i - 1] if i else 0) + 961 * (h[i - 2] if i > 1 else 0)) % modulus == 0 or i == len(lines) - 1:
            out.append(run)
            run = []
    return out


def test_line_chunks(docs, table, empty):
    order = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in table if r[1] is not None})
    places = collections.defaultdict(list)
    for known, i, t in order:
        for k, c in enumerate(_chunks(t)):
            if len(c) > 1:
                places["\n".join(c)].append((known, i, t, k))
    want = []
    for r in table:
        if r[1] is None:
            want.append((r[0], 0, 0, None))
            continue
        kept = [c for k, c in enumerate(_chunks(r[1])) if len(c) < 2 or places["\n".join(c)][0] == (r[0] is not None, r[0] or 0, r[1], k)]
        n = len(r[1].split("\n"))
        want.append((r[0], n, n - sum(map(len, kept)), "\n".join(x for c in kept for x in c)))
    got = line_chunks.remove_repeated(docs).select("doc_id", "line_chunks.*").collect()
    assert _multiset(got) == _multiset(want)
    assert sum(x[2] for x in want) > 0
    assert line_chunks.remove_repeated(empty).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><script>var a = "</p>";</script></head><body>
<nav class="menu"><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<article><h1>Big  &lt;news&gt;</h1><p>First <b>para</b>graph<br>of the text, long enough to matter to readers.<p>Second one: caf&eacute;.</article>
<section class="comments"><p>me too</p></section><footer>&copy; all rights</footer>"""


def test_main_text(spark, empty):
    nodes = main_text.parse(PAGE)
    assert [x.tag for x in nodes if x.tag in ("p", "li", "title")] == ["title", "li", "li", "p", "p", "p"]
    keep = main_text.decode(nodes, np.where(main_text.weak_labels(nodes) == 1, 1.0, -1.0))
    want = "Big <news>\n\nFirst paragraph of the text, long enough to matter to readers.\n\nSecond one: café."
    assert "\n\n".join(main_text.blocks(nodes, keep)) == want
    rng = random.Random(3)
    rows = [(i, f"u{i}", PAGE.replace("Second one", _prose(rng, 40)) if i % 2 else PAGE) for i in range(40)] + [(100, None, None), (101, "u", ""), (None, "u", "plain words"), (102, "u", "<p>a<p"), (1, "u1", PAGE)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["url"]): r for r in main_text.main_text(pages, main_text.train(pages)).collect()}
    assert got[(0, "u0")]["text"] == want and got[(0, "u0")]["n_chars"] == len(want)
    assert got[(100, None)]["text"] == got[(101, "u")]["text"] == ""
    none = main_text.train(pages.limit(0))
    assert main_text.main_text(pages, none).count() == len(rows) and main_text.main_text(pages.limit(0), none).count() == 0


def test_formulas_drawings_and_objects_of_an_article_stay():
    extra = '<math><semantics><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TEX</annotation></semantics></math> <svg><title>T</title><text>label</text></svg> <object>instead</object>'
    nodes = main_text.parse(f"<nav><svg><text>icon</text></svg></nav><article><p>So {extra}.</article>")
    odds = np.where(main_text.weak_labels(nodes) == 1, 1.0, -1.0)
    odds[[i for i, x in enumerate(nodes) if x.tag in ("math", "mi", "svg", "text")]] = -3.0  # as trees fitted to pages without any say
    assert main_text.blocks(nodes, main_text.decode(nodes, odds)) == ["So x=2 label instead."]


def test_decoding_keeps_nothing_under_a_dropped_element():
    rng = np.random.default_rng(1)
    nodes = main_text.parse("<div><p>a<b>b</b></p><ul><li>c<li>d</ul></div><div>e<p>f</div>")
    for _ in range(50):
        odds = rng.normal(size=len(nodes))
        keep = main_text.decode(nodes, odds)
        gain = lambda k: np.where(k, odds, -odds).sum()
        best = max((np.array([m >> i & 1 for i in range(len(nodes))], dtype=bool) for m in range(1 << len(nodes)) if all(x.parent < 0 or m >> x.parent & 1 or not m >> i & 1 for i, x in enumerate(nodes))), key=gain)
        assert gain(keep) == pytest.approx(gain(best))


def test_layouts_are_learned():
    rng = np.random.default_rng(4)
    texts = [_prose(random.Random(k), 30) + "." for k in range(12)]
    made = [main_text.layout_labels(main_text.lay_out(texts, rng)) for _ in range(260)]
    fit, held = made[:200], made[200:]
    forest = main_text.boost(np.vstack([main_text.features(n) for n, _ in fit]), np.concatenate([y for _, y in fit]), np.ones(sum(len(y) for _, y in fit)))
    right = sum(int((main_text.decode(n, forest.log_odds(main_text.features(n))) == (y == 1)).sum()) for n, y in held)
    assert right / sum(len(y) for _, y in held) > 0.93


@pytest.mark.parametrize("prior", [0.1, 0.35, 0.7])
def test_prior_is_estimated_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(3)
    good, bad = (lambda n: rng.normal(1.5, 1, n)), (lambda n: rng.normal(-1.5, 1, n))
    unlabelled = np.concatenate([good(int(6000 * prior)), bad(6000 - int(6000 * prior))])
    assert abs(quality.estimate_prior(good(3000), unlabelled) - prior) < 0.06
    assert quality.estimate_prior(np.empty(0), unlabelled) == 0.5


def test_quality_learns_from_positive_labels_alone(spark):
    rng = random.Random(2)
    good = [(i, " ".join(_prose(rng, 60).split()) + ".", 1) for i in range(0, 400)]
    bad = [(i, "!!! $$$ ### " * rng.randint(5, 30), 0) for i in range(400, 1000)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, q in good + bad if q and i % 2], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert abs(model.prior - 0.4) < 0.12
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert sum((scores[i] >= 0.3) == bool(q) for i, _, q in good + bad) > 0.97 * len(scores)


def test_mixing(docs, table, empty):
    got = mixing.mix(docs).select("doc_id", "source", "text", "mix.*").collect()
    sizes = collections.Counter()
    for r in table:
        sizes[r[3]] += len(_words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, held = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in held)
        total = sum(weights[s] for s in names if s not in held)
        target = {s: 3 * sizes[s] if s in held else rest * weights[s] / total for s in names}
        over = {s for s in names if s not in held and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            break
        held |= over
    taken = collections.Counter()
    for r in got:
        assert r["size"] == len(_words(r["text"])) and r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == len(table) and all(abs(taken[s] - target[s]) <= 1 for s in names)
    ordered = mixing.in_training_order(mixing.mix(docs)).select("position").collect()
    places = [r[0] for r in ordered]
    assert places == sorted(places) and 0 <= places[0] and places[-1] < 1
    assert mixing.mix(empty).count() == 0
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("n"))
    pick = ["doc_id", "mix.size", "mix.taken", "mix.plays"]
    assert sorted(map(repr, mixing.mix(sized, size=mixing.F.col("n")).select(*pick).collect())) == sorted(map(repr, mixing.mix(docs).select(*pick).collect()))


def test_other_slopes_move_the_documents(docs):
    """A use lies where the integral of its source's schedule reaches the words before it."""
    for slopes in (mixing.SLOPES, (0.9, -0.9, 0.3)):
        rows = mixing.mix(docs, slopes=slopes).select("source", "mix.*").collect()
        names = sorted({r["source"] for r in rows if r["source"] is not None}) + [None]
        by_source = collections.defaultdict(list)
        for r in rows:
            by_source[r["source"]] += [(p["position"], p["words"]) for p in r["plays"]]
        for source, plays in by_source.items():
            slope, total, before = slopes[names.index(source) % 3], sum(w for _, w in plays), 0
            for t, words in sorted(plays):
                assert t + slope * (t * t - t) == pytest.approx(before / total, abs=1e-6)
                before += words


def test_columns_with_names_of_the_operators_stay_or_are_replaced(spark):
    names = "position words play row size draw piece before _h1 _h2 h1 h2 id of_doc of_h1 of_h2 key node centre n keys wanted slope at plays rank".split()
    rows = [(i, f"some words number {i % 3} " * 9, "a", *[f"{c}{i}" for c in names]) for i in range(6)] + [(None, None, None, *[None] * len(names))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names))
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns and {r["_h1"] for r in kept.collect()} == {"_h10", "_h11", "_h12", None}
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "mix"] and mixed.count() == 7
    ordered = mixing.in_training_order(mixed)
    assert sorted(ordered.columns) == sorted(df.columns) and all(isinstance(r["position"], float) and r["play"] == f"play{r['doc_id']}" for r in ordered.collect())


def test_token_planes(spark, docs, table, empty):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    want, start = [], 0
    rows = sorted(((r[0] is not None, r[0] or 0), i) for i, r in enumerate(table))
    by_id = collections.defaultdict(list)
    for key, i in rows:
        by_id[key].append(plain.encode(table[i][1] or "", add_special_tokens=False).ids + [2])
    for fmt in (token_planes.PlaneFormat(block_ids=512), token_planes.PlaneFormat(block_ids=1000, bits=True)):
        path = token_planes.new_work_dir(spark, "test-planes")
        token_planes.write(docs, tokenizer_path(), path, fmt=fmt, shards=3)
        got = token_planes.read(spark, path, with_ids=True).collect()
        assert len(got) == len(table)
        stream = sorted(got, key=lambda r: r["start"])
        assert [r["start"] for r in stream] == list(np.cumsum([0] + [r["n_tokens"] for r in stream[:-1]]))
        assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in stream] == [key for key, _ in rows]
        found = collections.defaultdict(list)
        for r in stream:
            ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
            assert r["n_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(r["ids"])
            found[(r["doc_id"] is not None, r["doc_id"] or 0)].append(ids)
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in by_id.items()}
    assert token_planes.round_trip(empty, tokenizer_path()).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(tokenizer_path()), token_planes.Encoder(tokenizer_path())
    odd = ["Don't STOP 's it's!, é### É. éx ΣΑΣ. <|startoftext|> a<|endoftext|>b 1,2.3. ***, x\x01q a.b, '", "<|STARTOFTEXT|>", "", None, "K K. ß! ﬁ, ½. ² ª! x’s.  z", " \t\x0b"]
    for t, raw in zip(odd, encode(odd)):
        assert np.frombuffer(raw, dtype="<u4").tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer_on_random_letters_and_marks():
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(tokenizer_path()), token_planes.Encoder(tokenizer_path())
    assert encode.cuttable
    rng = random.Random(11)
    blocks = [(0x20, 0x7F)] * 6 + [(0, 0x20), (0x80, 0x250), (0x80, 0x250), (0x250, 0x300), (0x300, 0x370), (0x370, 0x3000), (0x3000, 0xD7FF), (0xFB00, 0xFFFF), (0x10000, 0x1F9FF)]
    marks = [".", ",", "!", " ", "\u0307", "\u0301", "'s", "\u0130", "J\u030c"]
    texts = ["".join(chr(rng.randrange(*rng.choice(blocks))) + (rng.choice(marks) if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 14))) for _ in range(100_000)]
    texts += [t for c in range(0x300) for t in (f"RESM{chr(c)}.", f"a{chr(c)}!", f"{chr(c)}b, c")]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        want = [e.ids for e in plain.encode_batch_fast(some, add_special_tokens=False)]
        assert [np.frombuffer(raw, dtype="<u4").tolist() for raw in encode(some)] == want


def test_encoder_leaves_texts_whole_for_other_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    plain, encode = Tokenizer.from_file(path), token_planes.Encoder(path)
    assert not encode.cuttable
    texts = ["Two  words.", " Ünï", None, "a\nb"]
    assert [np.frombuffer(raw, dtype="<u4").tolist() for raw in encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    fmt = token_planes.PlaneFormat(bits=bits)
    for n in (1, 7, 8, 4096):
        ids = np.random.default_rng(n).integers(0, 2**32, size=n, dtype=np.uint64).astype("<u4")
        assert (fmt.unpack(fmt.pack(ids), n) == ids).all()


@pytest.mark.parametrize("html, want", [
    ("<p>one <a title=don't href=x>two</a> three it's four</p>", "one two three it's four"), ("a <b x=\"oops>two</b> c", "a two c"), ("<a href=/x/>l</a> m", "l m"),
    ("1 < 2 <3", "1 < 2 <3"), ("<p a='>'>k", "k"), ("<a =x>u</a>", "u"), ("<p>x <a", "x "), ("<p>a<!-- c > -->b<!-->d", "abd"), ("<!DOCTYPE html><P CLASS=A>w", "w"), ("</ z>q", "q"),
])
def test_markup_is_read_as_browsers_do(html, want):
    out: list = []

    def walk(nodes, i):
        for piece in nodes[i].pieces:
            out.append(piece) if isinstance(piece, str) else walk(nodes, piece)

    walk(main_text.parse(html), 0)
    assert "".join(out) == want


@pytest.mark.parametrize("html", ["<a " * 100_000, "<a x='" * 50_001, '<a x=">" ' * 100_000, "<" * 200_000, "<b>" * 50_000 + "</x>" * 50_000, "<div>" * 20_000, "<!--" * 50_000])
def test_hostile_markup_takes_time_in_proportion(html):
    import time

    begin = time.process_time()
    main_text.parse(html)
    assert time.process_time() - begin < 3


def test_every_number_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in CATALOG.queries) == list(range(1, 14))
