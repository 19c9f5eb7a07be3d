"""Fingerprints."""

import pytest
from conftest import plan_of, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plangauge.operators import equality as E

DDL = "a int, b string"
ROW = st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.text("ab:|~", max_size=3)))


def mark(spark, data):
    return tuple(E.fingerprint(spark.createDataFrame(data, DDL)).first())


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, min_size=1, max_size=6), st.randoms(), ROW)
def test_order_free_and_sensitive(spark, data, random, extra):
    shuffled = data[:]
    random.shuffle(shuffled)
    assert mark(spark, data) == mark(spark, shuffled)
    assert mark(spark, data) != mark(spark, data + [extra])
    assert mark(spark, data) != mark(spark, data + [data[0]] * 2)
    if extra != data[0]:
        assert mark(spark, data) != mark(spark, [extra] + data[1:])


def test_null_empty_and_neighbours(spark):
    assert mark(spark, [(1, None)]) != mark(spark, [(1, "")])
    assert mark(spark, [(1, "~")]) != mark(spark, [(1, None)])
    two = "a string, b string"
    x = E.fingerprint(spark.createDataFrame([("ab", "c")], two)).first()
    y = E.fingerprint(spark.createDataFrame([("a", "bc")], two)).first()
    assert x != y


def test_same_result(spark):
    one = spark.createDataFrame([(1, "x")], DDL)
    none = one.filter("false")
    out = E.same_result(one, none).first()
    assert (out["rows_before"], out["rows_after"], out["same_result"]) == (1, 0, False)
    assert E.same_result(none, none).first()["same_result"] is True
    with pytest.raises(ValueError):
        E.same_result(one, one.withColumn("a", F.col("a").cast("long")))


def test_ordered_fingerprint(spark):
    df = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 10).alias("g"))
    up = tuple(E.ordered_fingerprint(df, [F.col("g"), F.col("id")]).first())
    again = tuple(E.ordered_fingerprint(df.repartition(3), [F.col("g"), F.col("id")]).first())
    down = tuple(E.ordered_fingerprint(df, [F.col("g").desc(), F.col("id")]).first())
    assert up == again
    assert up != down and up[0] == down[0] == 1000


def test_no_collect_of_rows(spark):
    text = plan_of(E.fingerprint(spark.range(100)))
    assert "partial_sum" in text.lower() or "partial_count" in text.lower()


def test_differing_rows(spark):
    a = spark.createDataFrame([(i % 3, "x") for i in range(9)], DDL)
    b = spark.createDataFrame([(0, "x"), (0, "x"), (7, "y")], DDL)
    out = rows(E.differing_rows(a, b), "side", "a")
    assert out == [(7, "y", "only_after"), (0, "x", "only_before"), (1, "x", "only_before"), (1, "x", "only_before"), (1, "x", "only_before"), (2, "x", "only_before")]
    assert E.differing_rows(a, b, n=None).filter("side = 'only_before'").count() == 7


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=8), st.lists(ROW, max_size=8))
def test_few_differing_rows_equal_the_whole_comparison(spark, left, right):
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL)
    for n in (None, 2):
        assert sorted(map(repr, E.few_differing_rows(a, b, n).collect())) == sorted(map(repr, E.differing_rows(a, b, n).collect()))


def test_difference_is_told_without_shuffling_the_rows(spark, monkeypatch):
    a = spark.range(0, 200_000, 1, 6).select("id", F.concat(F.lit("text "), F.col("id") % 977).alias("t"))
    b = a.repartition(5).filter("id % 1000 <> 7").unionByName(a.filter("id < 3"))
    sketch = E.difference_sketch(a, b)
    assert sketch.count() <= 3 * 203
    monkeypatch.setattr(E, "differing_rows", lambda x, y, n: (x, y))
    x, y = E.few_differing_rows(a, b)
    for side in (x, y):
        text = plan_of(side)
        assert "BroadcastHashJoin" in text and "hashpartitioning" not in text
    assert x.count() == 203 and y.count() == 6  # of rows 0 to 2 both sides come, one and two times


def test_a_full_sketch_falls_back_to_the_whole_comparison(spark):
    a, b = spark.range(0, 900).select(F.col("id").cast("int").alias("a"), F.lit("x").alias("b")), spark.createDataFrame([(5, "x")] * 3, DDL)
    rows = {r["cell"]: [r[c] for c in ("n", "p0", "p1", "p2", "p3", "check")] for r in E.difference_sketch(a, b, 16).collect()}
    assert len(rows) == 48 and E.peel(rows, 16) is None
    assert E.few_differing_rows(a, b, None, 16).groupBy("side").count().orderBy("side").collect() == [("only_after", 2), ("only_before", 899)]


def test_peeling_holds_up_to_four_fifths_of_the_cells():
    import random

    rng = random.Random(7)
    for size in (0, 1, 50, 600):
        rows = {tuple(rng.randrange(E.PRIME) for _ in range(E.PARTS)): rng.choice([-3, -1, 1, 2]) for _ in range(size)}
        cells = {}
        for parts, n in rows.items():
            for k in range(E.TABLES):
                at = k * 256 + parts[k] % 256
                cells[at] = [x + y for x, y in zip(cells.get(at, [0] * 6), [n, *(n * p for p in parts), n * E._check(parts)])]
        assert E.peel({c: v for c, v in cells.items() if any(v)}, 256) == rows


def test_repetitions(spark):
    t = spark.createDataFrame(
        [("q", "u", "h"), ("q", "u", "h"), ("q", "t", "h"), ("q", "t", None)], "query_id string, variant string, result_hash string"
    )
    base = spark.createDataFrame([("q", "h")], "query_id string, base_hash string")
    out = {r["variant"]: (r["hash_match"], r["repetitions"]) for r in E.all_repetitions_match(t, base).collect()}
    assert out == {"u": (True, 2), "t": (False, 2)}


def test_attempts_without_a_baseline_stay(spark):
    attempts = spark.createDataFrame([(1, "h"), (1, "x"), (2, "h"), (3, None)], "episode_id int, new_hash string")
    known = spark.createDataFrame([(1, "h"), (3, None)], "episode_id int, base_hash string")
    got = E.changed_results(attempts, known, ["episode_id"]).select("episode_id", "new_hash", "has_baseline", "result_changed")
    assert {tuple(r) for r in got.collect()} == {(1, "h", True, False), (1, "x", True, True), (2, "h", False, None), (3, None, True, False)}
