"""SQL text checks, tampering variants, completions, diversity."""

from conftest import rows
from pyspark.sql import functions as F

from plangauge.functions import completions as C
from plangauge.functions import sqltext as S
from plangauge.operators.diversity import completion_diversity, distance_sums, exact_diversity


def check(spark, function, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def test_guards(spark):
    reads = ["SELECT 1", "WITH x AS (SELECT 1) SELECT * FROM x", "  explain select 1", "\n\tselect updated_at from t"]
    writes = ["UPDATE users SET a = 1", "CREATE INDEX i ON t (a)", "DELETE FROM t", "INSERT INTO t VALUES (1)", "TRUNCATE t", "VACUUM t", "", None]
    assert check(spark, S.is_read_only, *reads) == [True] * 4
    assert check(spark, S.is_read_only, *writes) == [False] * 8
    assert check(spark, S.has_no_blocked_word, *writes) == [False] * 8
    # one rejects a literal, the other an EXPLAIN ANALYZE
    assert check(spark, S.is_read_only, "select 'please update me'") == [False]
    assert check(spark, S.has_no_blocked_word, "EXPLAIN ANALYZE SELECT 1", "SELECT updated FROM t", "select drop_date") == [False, True, True]


def test_cte(spark):
    yes = ["with a as (select 1) select 1", 'x\nWITH "a.b"\n AS\n(', "WITH a AS MATERIALIZED (select 1)"]
    no = ["CREATE TIMESTAMP WITHOUT TIME ZONE", "without a as (", "with a (b) as (", "swith a as (", None]
    assert check(spark, S.has_cte, *yes) == [True] * 3
    assert check(spark, S.has_cte, *no) == [False] * 5


def variants(spark, query):
    df = S.tamper_variants(spark.createDataFrame([(query,)], "query string"))
    return {r["variant"]: (r["sql"], r["expected_penalty"]) for r in df.collect()}


def test_tamper_variants(spark):
    out = variants(spark, "SELECT a FROM t WHERE a > 1 AND b IN (SELECT b FROM u WHERE c) GROUP BY a ORDER BY a; ")
    assert out["limit_zero"] == ("SELECT * FROM (\nSELECT a FROM t WHERE a > 1 AND b IN (SELECT b FROM u WHERE c) GROUP BY a ORDER BY a\n) AS _a LIMIT 0", -20.0)
    assert out["where_false"][0].endswith("\n) AS _a WHERE 1=0")
    assert out["drop_where"][0] == "SELECT a FROM t GROUP BY a ORDER BY a; "
    assert out["ddl"][1] == -15.0
    assert out["constant_predicate"][0].startswith("SELECT a FROM t WHERE l_orderkey = 1 AND a > 1 AND b IN (SELECT b FROM u WHERE c)")
    assert variants(spark, "select 1 where x\norder by 1")["drop_where"][0] == "select 1 order by 1"
    assert variants(spark, "select 1 where x")["drop_where"][0] == "select 1 "
    plain = variants(spark, "select 1")
    assert plain["drop_where"][0] == "select 1" and plain["constant_predicate"][0] == S.TAMPER_FALLBACK


def test_tamper_audit(spark):
    expected = S.tamper_variants(spark.createDataFrame([(1, "select 1 where a")], "id int, query string"))
    seen = spark.createDataFrame([(1, "ddl", -15.0), (1, "limit_zero", -20.005), (1, "drop_where", 3.0)], "id int, variant string, observed_penalty double")
    out = {r["variant"]: r["as_expected"] for r in S.tamper_audit(seen, expected, ["id"]).collect()}
    assert out == {"ddl": True, "limit_zero": True, "drop_where": False}


def clause(spark, a, b, **options):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(S.changed_clause(F.col("a"), F.col("b"), **options)).first()[0]


def test_changed_clause(spark):
    full = "select 1 from t join u on x where {} group by a"
    assert clause(spark, full.format("a"), full.format("b")) == "WHERE"
    assert clause(spark, full.format("a"), full.format("a").replace("group by a", "group by b")) == "GROUP BY"
    assert clause(spark, full.format("a"), full.format("a")) == "other"
    assert clause(spark, "select 1", "select 1") == "GROUP BY"
    assert clause(spark, "select 1", "select 1", absent_counts=False) == "other"
    # the change is far behind the start of a long text
    pad = " " * 5000
    assert clause(spark, pad + full.format("a"), pad + full.format("b")) == "WHERE"


def parsed(spark, *texts, function=C.parse_tolerant):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return function(df).orderBy("i").collect()


def test_tolerant_parse(spark):
    out = parsed(
        spark,
        '{"action": "add_cte", "rewritten_query": " SELECT 2 "} and more',
        'Sure! ```json\n{"action": "jump", "rewritten_query": "SELECT 3"}\n``` bye',
        "```sql\nSELECT 4\n```",
        '{"action": "add_cte", "rewritten_query": "SELECT',
        "",
        None,
        "  plain text ",
        '{"action": "add_cte"}',
        '{"rewritten_query": "a {b} \\"c\\""}',
        '[1] {"rewritten_query": "SELECT 5", "x": {"y": [1, {"z": 2}]}} }',
    )
    assert [(r["action"], r["rewritten_query"]) for r in out] == [
        ("add_cte", "SELECT 2"),
        ("push_filter", "SELECT 3"),
        ("push_filter", "SELECT 4"),
        ("push_filter", '{"action": "add_cte", "rewritten_query": "SELECT'),
        ("push_filter", "SELECT 1"),
        ("push_filter", "SELECT 1"),
        ("push_filter", "plain text"),
        ("push_filter", '{"action": "add_cte"}'),
        ("push_filter", 'a {b} "c"'),
        ("push_filter", "SELECT 5"),
    ]
    assert [(r["json_valid"], r["has_query"]) for r in out] == [
        (True, True), (True, True), (False, False), (False, False), (False, False), (False, False), (False, False), (True, False), (True, True), (True, True),
    ]


def test_strict_parse(spark):
    good = '{"action": " add_cte ", "rewritten_query": "SELECT 2"}'
    bad = [good + " tail", '{"action": "", "rewritten_query": "x"}', '{"action": "a"}', "[1]", "{", "", None, '{"action": 5, "rewritten_query": "x"}', good + "," + good]
    out = parsed(spark, good, " " + good + "\n", *bad, function=C.parse_strict)
    assert [r["strict_ok"] for r in out] == [True, True] + [False] * len(bad)
    assert tuple(out[0]["strict"]) == ("add_cte", "SELECT 2") and out[2]["strict"] is None


def test_validity_share(spark):
    df = spark.createDataFrame([("r", '{"rewritten_query": "x"}'), ("r", "{}"), ("r", "no"), ("r", "{")], "run_id string, text string")
    out = C.validity_by(C.parse_tolerant(df), ["run_id"]).first()
    assert (out["completions"], out["valid_share"], out["query_share"]) == (4, 0.5, 0.25)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_diversity_by_brute_force(spark):
    import hashlib
    import itertools
    import random

    g = random.Random(5)
    data = [(p, s, "".join(g.choice("aéb ") for _ in range(g.randrange(90)))) for p, n in enumerate((12, 4, 1)) for s in range(n)]
    out = rows(completion_diversity(spark.createDataFrame(data, "prompt_id long, sample_id int, text string")), "prompt_id")
    expected = []
    for p, n in enumerate((12, 4, 1)):
        probes = {}
        for q, s, t in data:
            if q == p:
                number = int(hashlib.md5(str(s).encode()).hexdigest()[:8], 16) % -(-n // 5)
                probes.setdefault(number, []).append(t)
        pairs = [distance(a, b) for texts in probes.values() for a, b in itertools.combinations(texts, 2)]
        mean = sum(pairs) / max(len(pairs), 1)
        expected.append((p, n, len(probes), len(pairs), mean, mean < 50))
    assert out == expected and out[1][3] == 6


def test_exact_diversity_equals_all_pairs(spark):
    import random
    from collections import Counter

    rng = random.Random(5)
    data = [(n, k, None if k == 3 else "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for n in (1, 2, 7, 50, 1000) for k in range(n)]
    df = spark.createDataFrame(data, "prompt_id long, sample_id int, text string")
    kinds = {}
    for n, _, t in data:
        kinds.setdefault(n, []).append(t or "")
    want = {}
    for n, texts in kinds.items():
        found = sorted(Counter(texts).items())
        total = sum(c * d * distance(a, b) for i, (a, c) in enumerate(found) for b, d in found[:i])
        want[n] = total / max(1, n * (n - 1) // 2)
    for block in (64, 5):
        out = {r["prompt_id"]: (r["samples"], r["pairs"], r["mean_distance"]) for r in exact_diversity(df, block).collect()}
        assert out == {n: (n, n * (n - 1) // 2, want[n]) for n in kinds}
    assert exact_diversity(df.filter("false")).count() == 0


def test_distance_sums_equal_single_distances():
    import random

    import numpy as np

    rng = random.Random(3)
    for longest in (3, 63, 64, 65, 130, 200):
        letters = rng.choice(["ab", "ab\u00e9\U0001f600"])
        text = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, longest)))
        texts, others = [text() for _ in range(6)], [text() for _ in range(6)] + ["", "a" * 64, "a" * 65, "a" * 64]
        weights = np.array([rng.randint(1, 9) for _ in texts])
        want = [sum(int(w) * distance(a, b) for a, w in zip(texts, weights)) for b in others]
        assert list(distance_sums(texts, others, weights)) == want
        assert list(distance_sums(texts, sorted(others), weights)) == [w for _, w in sorted(zip(others, want))]


def test_exact_diversity_compares_equal_texts_once(spark):
    # 5 * 10 ** 9 pairs of samples, three pairs of different texts
    df = spark.range(100_000).selectExpr("1 AS prompt_id", "id AS sample_id", "CASE id % 4 WHEN 0 THEN 'abc' WHEN 1 THEN repeat('x', 200) ELSE 'abd' END AS text")
    row = exact_diversity(df).first()
    n, a, x, b = 100_000, 25_000, 25_000, 50_000
    assert (row["samples"], row["pairs"]) == (n, n * (n - 1) // 2)
    assert row["mean_distance"] == (a * x * 200 + x * b * 200 + a * b) / (n * (n - 1) // 2)


def test_frames_equal_single_distances(monkeypatch):
    import random

    import numpy as np

    from plangauge.operators import diversity as D

    rng = random.Random(8)
    for _ in range(150):
        letters = rng.choice(["ab", "0123456789", "abcdefgh", "aé\U0001f600"])
        text = lambda n: "".join(rng.choice(letters) for _ in range(n))
        longest, sides = rng.choice([0, 1, 3, 8, 16]), []
        for _ in range(2):
            head, tail = text(rng.randint(0, 9)), text(rng.randint(0, 9))
            texts = sorted({head + text(rng.randint(0, longest)) + tail for _ in range(rng.randint(1, 8))})
            sides.append((texts, np.array([rng.randint(1, 9) for _ in texts]), len(head), len(tail)))
        if rng.random() < 0.3:
            # the same texts, cut elsewhere
            texts, counts, head, tail = sides[0]
            sides[1] = (texts, counts, rng.randint(0, head), rng.randint(0, tail)) if longest <= 3 else sides[0]
        monkeypatch.setattr(D, "BLOCK_BYTES", rng.choice([1, 16, 1 << 16]))
        monkeypatch.setattr(D, "BLOCK_PAIRS", rng.choice([1, 16, 1 << 17]))
        a, b = D.build_frames(sides)
        (some, of_some, *_), (others, of_others, *_) = sides
        assert D.frame_sum(a, b) == sum(int(c) * int(d) * distance(s, t) for s, c in zip(some, of_some) for t, d in zip(others, of_others))
        pairs = [(i, k) for i in range(len(some)) for k in range(i)]
        assert D.frame_sum(a, a) == sum(int(of_some[i] * of_some[k]) * distance(some[i], some[k]) for i, k in pairs)


def test_texts_that_begin_and_end_alike_are_compared_by_their_middles(monkeypatch):
    # 5 * 10 ** 7 pairs; no letter stands in two places, so the distance is the number of places that differ
    import itertools

    import pyarrow as pa

    from plangauge.operators import diversity as D

    def whole(*_):
        raise AssertionError("compared letter by letter")

    monkeypatch.setattr(D, "distance_sums", whole)
    places = ["0123456789", "abcdefghij", "klmnopqrst", "ABCDEFGHIJ"]
    texts = ["SELECT X FROM Y WHERE Z = " + "".join(p) + " ORDER BY X" for p in itertools.product(*places)]
    n = len(texts)

    def tile(first, second):
        both = {"_i": [0] * n, "_j": [int(bool(second))] * n, "_first": [True] * len(first) + [False] * len(second), "text": first + second}
        return pa.table({"prompt_id": ["p"] * n, "_n": [n] * n, **both, "_c": pa.array([1] * n, pa.int64())})

    def total(first, second):
        return D._tile_sums(tile(first, second))["_total"][0].as_py()

    assert total(texts, []) == 4 * (n * n // 2) * 9 // 10
    # in the half with an even last place, and the other: all differ there
    even, odd = texts[::2], texts[1::2]
    assert total(even, odd) == len(even) * len(odd) * 3 * 9 // 10 + len(even) * len(odd)


def test_exact_diversity_of_frames_and_others(spark):
    import random

    import numpy as np

    rng = random.Random(2)
    number = lambda: str(rng.randint(1, 99999))
    frames = [("WITH r AS (SELECT k FROM orders WHERE k < ", ") SELECT COUNT(*) FROM r"), ("SELECT p, 12 FROM lineitem WHERE s = ", " GROUP BY p;"), ("", "")]
    texts = [head + number() + tail for head, tail in frames for _ in range(150)]
    texts += ["".join(rng.choice("SELCT 019") for _ in range(rng.randint(0, 150))) for _ in range(60)] + ["", "DROP TABLE t7"]
    texts += rng.choices(texts, k=200)
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "prompt_id long, sample_id int, text string")
    total = sum(distance_sums(texts, sorted(texts), np.ones(len(texts), np.int64))) // 2
    for block in (1024, 40):
        row = exact_diversity(df, block).first()
        pairs = len(texts) * (len(texts) - 1) // 2
        assert (row["samples"], row["pairs"], row["mean_distance"]) == (len(texts), pairs, total / pairs)


def test_bit_sums_equal_sums_of_texts_one_by_one(monkeypatch):
    import random

    import numpy as np

    from plangauge.operators import diversity as D

    rng = random.Random(4)
    for letters, longest, room in (("ab", 5, 1), ("ab\u00e9\U0001f600", 70, 1 << 25), ("abcdefgh", 130, 1 << 12), ("ab", 0, 1 << 25)):
        some, others = (["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)] for n in (50, 130))
        of_some, of_others = (np.array([rng.choice([1, 1, 6, 100_000]) for _ in part]) for part in (some, others))
        monkeypatch.setattr(D, "BIT_BYTES", room)
        want = sum(s * int(c) for s, c in zip(distance_sums(others, some, of_others), of_some))
        assert D.bit_sum(some, others, of_some, of_others) == want
