"""Health checks, alerts and alignment on known series."""

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from plangauge.operators import series
from plangauge.sources.logs import HISTORY

NAN = float("nan")


def history(spark, *records, run="r"):
    names = HISTORY.fieldNames()
    data = [tuple({"run_id": run, "step": i, **r}.get(n) for n in names) for i, r in enumerate(records)]
    return spark.createDataFrame(data, HISTORY)


def rewards(spark, *values, **options):
    return history(spark, *[{"reward_mean": v} for v in values], **options)


def test_inflection(spark):
    out = series.reward_inflection(rewards(spark, *[0.5] * 37, *[1.2] * 64)).first()
    assert (out["inflection"], out["reward_before"], out["reward_after"], out["reward_at_end"], out["pass"]) == (28, 0.5, 0.57, 1.2, True)


def test_inflection_needs_points_and_a_rise(spark):
    short = series.reward_inflection(rewards(spark, *[1.0] * 19)).first()
    assert (short["points"], short["inflection"], short["pass"], short["reward_before"]) == (19, None, False, None)
    flat = series.reward_inflection(rewards(spark, *[1.0] * 30, 2.0)).first()
    assert flat["inflection"] is None or flat["pass"]
    low = series.reward_inflection(rewards(spark, *[1.0] * 30)).first()
    assert (low["inflection"], low["pass"], low["reward_before"], low["reward_after"]) == (None, False, 1.0, 1.0)


def test_inflection_late_fails_and_beyond_the_search_is_not_seen(spark):
    late = series.reward_inflection(rewards(spark, *[0.5] * 150, *[1.2] * 20)).first()
    assert late["inflection"] >= 100 and late["pass"] is False
    beyond = series.reward_inflection(rewards(spark, *[0.5] * 600, *[9.0] * 20)).first()
    assert beyond["inflection"] is None and beyond["reward_after"] == 9.0


def test_reward_series_takes_the_first_present(spark):
    h = history(spark, {"reward_mean": 1.0, "env_reward": 9.0}, {"env_reward": 2.0}, {"reward_mean": NAN}, {})
    assert rows(series.reward_series(h), "step") == [("r", 0, 1.0), ("r", 1, 2.0)]


def test_noop_rate(spark):
    h = history(spark, {"action": " No_Op "}, {"rewrite_unchanged": 1, "action": "x"}, {"noop": 1}, {"action": "push_filter"})
    out = series.noop_rate(h).first()
    assert (out["noop_rate"], out["pass"], out["skipped"]) == (0.75, False, False)
    # short runs are divided by three
    assert series.noop_rate(history(spark, {"action": "noop"})).first()["noop_rate"] == 0.3333
    silent = series.noop_rate(rewards(spark, 1.0, 2.0)).first()
    assert (silent["noop_rate"], silent["pass"], silent["skipped"]) == (None, None, True)
    # only the last fifty rows count
    long = history(spark, *[{"action": "noop"}] * 60, *[{"action": "a"}] * 45)
    assert series.noop_rate(long).first()["noop_rate"] == 0.1 and series.noop_rate(long).first()["pass"] is True


def test_improvement_rate(spark):
    h = history(spark, {"seq_scans_removed": 1.0}, {"seq_scans_removed": 0.0}, {"seq_scans_removed": None}, {"seq_scans_removed": NAN})
    out = series.improvement_rate(h).first()
    assert (out["improvement_rate"], out["pass"]) == (0.25, False)
    assert series.improvement_rate(rewards(spark, 1.0)).first()["skipped"] is True


def test_alerts(spark):
    flat = [{"reward_mean": 1.0 + i / 1000, "episode_length": 5.0, "result_changed": 0.0} for i in range(25)]
    out = series.alerts(history(spark, *flat)).first()
    assert (out["reward_flat"], out["result_tampering"], out["stuck"]) == (True, False, True)
    moving = [{"reward_mean": float(i), "episode_length": 4.0, "result_changed": 0.2 if i == 0 else 0.0} for i in range(9)]
    out = series.alerts(history(spark, *moving)).first()
    assert (out["reward_flat"], out["result_tampering"], out["stuck"]) == (False, True, False)
    nine = series.alerts(history(spark, *[{"episode_length": 5.0, "reward_mean": NAN}] * 9)).first()
    assert (nine["stuck"], nine["reward_flat"]) == (False, False)


def test_report_and_trend(spark):
    h = history(spark, *[{"reward_mean": float(i), "syntax_error": 1.0, "episode_length": float(20 - i), "result_changed": NAN} for i in range(12)])
    out = {r["metric"]: r for r in series.last_rows_report(h).collect()}
    assert (out["reward_mean"]["e0"], out["reward_mean"]["e9"], out["reward_mean"]["trend"]) == (2.0, 11.0, "improving")
    assert (out["episode_length"]["trend"], out["syntax_error"]["trend"], out["result_changed"]["trend"]) == ("improving", "flat", "n/a")
    two = {r["metric"]: r for r in series.last_rows_report(history(spark, {"reward_mean": 2.0}, {"reward_mean": 1.0})).collect()}
    assert (two["reward_mean"]["trend"], two["reward_mean"]["e2"]) == ("worse", None)


def test_alignment(spark):
    h = history(spark, {"reward_mean": 1.0, "result_changed": 2.0}, {"reward_mean": None, "episode_length": 3.0, "seq_scans_removed": 2.0})
    out = series.aligned_series(h, 4).orderBy("episode").collect()
    assert [r["reward_mean"] for r in out] == [1.0, 0.0, 0.0, 0.0]
    assert [r["result_changed"] for r in out] == [2.0, 0.0, 0.0, 0.0]
    assert [r["episode_length"] for r in out] == [4.0, 3.0, 3.0, 3.0]
    assert [r["scan_star"] for r in out] == [False, True, True, True]
    assert series.aligned_series(rewards(spark, *[1.0] * 9), 4).count() == 4


def test_summary(spark):
    h = history(spark, *[{"reward_mean": float(i), "result_changed": 5.0 if i in (3, 7) else 0.0, "syntax_error": 1.0} for i in range(60)])
    out = series.series_summary(h).first()
    assert out["final_mean_reward"] == pytest.approx(sum(range(10, 60)) / 50)
    assert (out["best_reward"], out["syntax_errors"], out["peak_penalty"], out["peak_step"]) == (59.0, 60.0, 5.0, 3)
    assert series.series_summary(rewards(spark, 1.0)).first()["peak_step"] is None


def test_verdict(spark):
    def checks(*flags):
        data = [("r", name, flag, flag is None) for name, flag in zip(series.CHECKS, flags)]
        return series.verdict(spark.createDataFrame(data, "run_id string, check string, pass boolean, skipped boolean")).first()

    assert checks(True, True, True, True, True)["overall"] == "PASS"
    assert checks(True, None, True, True, True)["overall"] == "PARTIAL"
    assert checks(None, None, None, None, None)["overall"] == "PARTIAL"
    assert checks(True, True, True, False, False)["overall"] == "PARTIAL"
    bad = checks(True, False, False, False, True)
    assert (bad["overall"], bad["checks_failed"]) == ("FAIL", 3)
    # reward inflection comes before no-op elimination
    assert bad["recommendation"] == dict(series.ADVICE)["REWARD_INFLECTION"]
    assert checks(True, None, True, True, True)["recommendation"] == series.ADVICE_OTHER


def test_compact_keeps_every_check(spark):
    import random

    g = random.Random(3)
    records = [
        {"reward_mean": g.choice([None, NAN, g.random()]), "seq_scans_removed": g.choice([None, 0.0, 1.0]), "action": g.choice(["noop", "x"]),
         "episode_length": 5.0, "result_changed": g.random() / 5}
        for _ in range(1500)
    ]
    whole = history(spark, *records).unionByName(history(spark, *records[:40], run="s"))
    # two batches, the first one compacted
    first = series.compact(whole.filter("step < 800"))
    state = series.compact(first.unionByName(whole.filter("step >= 800")))
    assert state.count() < 700
    for check in (series.noop_rate, series.improvement_rate, series.alerts):
        assert rows(check(state), "run_id") == rows(check(whole), "run_id")
    keep = ["run_id", "inflection", "reward_before", "reward_after", "reward_at_end", "pass"]
    assert rows(series.reward_inflection(state).select(*keep), "run_id") == rows(series.reward_inflection(whole).select(*keep), "run_id")


def test_first_syntax_penalties(spark):
    h = history(spark, *[{"syntax_error": float(i % 2)} for i in range(20)])
    assert [r["step"] for r in series.first_syntax_penalties(h).orderBy("step").collect()] == [1, 3, 5, 7, 9]


def test_no_window_over_a_whole_run(spark):
    text = plan_of(series.rolling_mean(rewards(spark, 1.0), ["reward_mean"], 10))
    assert "_block" in text and "_chunk" in text
    assert F is not None
