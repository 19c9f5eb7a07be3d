"""Exact rewards of known plan pairs."""

import pytest
from pyspark.sql import functions as F

from plangauge.functions import reward as R

DEFAULT = dict(node_type="Seq Scan", total_cost=10000.0, rows=100000, seq_scans=1, nested_loops=0, hash_joins=0)


def plan(**changes):
    return {**DEFAULT, **changes}


# name, old ms, new ms, old plan, new plan, step, raw, normalized
CASES = [
    ("scan removed", 5000, 4000, plan(), plan(seq_scans=0, node_type="Index Scan"), 0, 11.75, 0.26705),
    ("loop removed", 8000, 2000, plan(nested_loops=1), plan(hash_joins=1), 0, 34.0, 0.77273),
    ("halved", 5000, 2500, plan(), plan(), 0, 28.0, 0.63636),
    ("one fifth", 5000, 1000, plan(), plan(), 0, 28.0, 0.63636),
    ("no-op step 0", 5000, 5000, plan(), plan(), 0, -2.0, -0.04545),
    ("no-op step 4", 5000, 5000, plan(), plan(), 4, -10.0, -0.22727),
    ("no-op step 9", 5000, 5000, plan(), plan(), 9, -10.0, -0.22727),
    ("rows cut", 5000, 4800, plan(), plan(rows=40000), 0, 3.625, 0.08239),
    ("slower", 5000, 7000, plan(), plan(), 0, -4.0, -0.09091),
    (
        "combined",
        8420,
        310,
        plan(seq_scans=2, nested_loops=1, total_cost=50000.0),
        plan(seq_scans=0, nested_loops=0, rows=5000, total_cost=5000.0),
        0,
        57.45,
        1.0,
    ),
    ("zero", 0, 0, plan(), plan(), 0, 0.0, 0.0),
    ("much slower", 100, 9999, plan(), plan(), 0, -20.0, -0.45455),
    ("tiny no-op", 0.001, 0.001, plan(), plan(), 0, -2.0, -0.04545),
    (
        "demo pair",
        8420,
        310,
        plan(seq_scans=2, nested_loops=1, total_cost=50000.0, rows=1000000),
        plan(seq_scans=0, nested_loops=0, hash_joins=1, total_cost=1000.0, rows=50000),
        0,
        57.69,
        1.0,
    ),
    ("new time zero", 100, 0, plan(), plan(seq_scans=1), 0, 28.0, 0.63636),
]

PLAN_DDL = "struct<node_type:string,total_cost:double,rows:bigint,seq_scans:int,nested_loops:int,hash_joins:int>"


def frame(spark, cases):
    data = [(c[0], float(c[1]) if c[1] is not None else None, float(c[2]) if c[2] is not None else None, c[3], c[4], c[5]) for c in cases]
    return spark.createDataFrame(data, f"name string, old_ms double, new_ms double, old {PLAN_DDL}, new {PLAN_DDL}, step int")


def rewarded(df):
    def fields(prefix):
        return {n: F.col(f"{prefix}.{n}") for n in R.PLAN_FIELDS}

    return R.with_reward(df, F.col("old_ms"), F.col("new_ms"), fields("old"), fields("new"), F.col("step"))


def test_exact_values(spark):
    out = {r["name"]: r["breakdown"] for r in rewarded(frame(spark, CASES)).collect()}
    for name, *_, raw, normalized in CASES:
        assert out[name]["raw"] == pytest.approx(raw, abs=1e-9), name
        assert out[name]["normalized"] == pytest.approx(normalized, abs=1e-5), name
        parts = [v for k, v in out[name].asDict().items() if k not in ("raw", "normalized")]
        assert sum(parts) == pytest.approx(out[name]["raw"])


def test_missing_numbers_count_as_zero_and_result_is_bounded(spark):
    empty = dict.fromkeys(R.PLAN_FIELDS)
    cases = [("nulls", None, None, empty, empty, 0), ("huge", 1e300, 1e-300, plan(seq_scans=1000000), plan(seq_scans=0), 0)]
    out = {r["name"]: r["breakdown"] for r in rewarded(frame(spark, cases)).collect()}
    assert out["nulls"]["normalized"] == 0.0
    assert -1.0 <= out["huge"]["normalized"] <= 1.0


def test_ideal_plan(spark):
    df = spark.createDataFrame(
        [("Seq Scan", 50000.0, 1000000, 2, 1, 0, 400.0), ("Sort", 0.0, 10, 0, 0, 2, 0.0)],
        "node_type string, total_cost double, rows long, seq_scans int, nested_loops int, hash_joins int, ms double",
    )
    ideal, ms = R.ideal_plan({n: F.col(n) for n in R.PLAN_FIELDS}, F.col("ms"))
    out = df.select(*[c.alias(n) for n, c in ideal.items()], ms.alias("new_ms")).collect()
    assert tuple(out[0]) == ("Index Only Scan", 5000.0, 5000, 0, 0, 0, 40.0)
    assert tuple(out[1]) == ("Sort", 1.0, 1, 0, 0, 2, 0.1)
