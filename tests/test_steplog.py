"""The nested step log: forms of a line, quarantine, and every scoring key on a log in that layout."""

import json

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_scoring import ATTEMPT, attempt, initial

from plangauge.catalog import scoring as catalog
from plangauge.operators import episodes, scoring
from plangauge.sources import steplog

PLAN = {"node_type": "Seq Scan", "total_cost": 100.0, "actual_time_ms": 5, "rows": 1000, "seq_scans": 1, "nested_loops": 0, "hash_joins": 0, "children": [{"node_type": "Sort", "children": []}]}


def state(ms, **more):
    return {"original_query": "SELECT 0", "explain_plan": PLAN, "execution_ms": ms, "result_hash": "h", "task_level": 2, "target_ms": 10.0, "step_count": 0} | more


def entry(step, ms=50.0, error=None, **more):
    info = {"error": error, "message": "m"} if error else {"new_ms": ms, "best_ms": ms, "step_count": step + 1, "reward_breakdown": {"raw": 1.5}}
    after = state(100.0 if error else ms)
    return {"run_id": "r", "episode_id": 1, "step_index": step, "obs_before": state(100.0), "action": "add_cte", "rewritten_query": "q", "observation": after, "reward": 0.5, "done": False, "info": info} | more


def read(spark, tmp_path, *lines):
    path = tmp_path / "log"
    path.mkdir()
    (path / "part.json").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return steplog.read_step_log(spark, str(path))


def test_entry_becomes_attempt_and_first_observation(spark, tmp_path):
    found, bad = read(spark, tmp_path, entry(0), "", "   ", entry(1, error="timeout"), entry(2, error="result_changed"), entry(3, error="execution_error"), entry(4, error="syntax_error"))
    assert bad.count() == 0
    got = steplog.attempts(found).orderBy("step_index").collect()
    assert [(r["parse_ok"], r["timed_out"], r["exec_error"], r["new_ms"], r["new_hash"], r["node_type"]) for r in got] == [
        (True, False, None, 50.0, "h", "Seq Scan"), (True, True, None, None, "h", None), (True, False, None, None, None, None), (True, False, "m", None, "h", None), (False, False, None, None, "h", None),
    ]
    first = steplog.initial_observations(found).collect()
    assert [(r["run_id"], r["episode_id"], r["task_level"], r["execution_ms"], r["base_hash"], r["base_rows"]) for r in first] == [("r", 1, 2, 100.0, "h", 1000)]
    assert json.loads(found.filter("step_index = 0").first()["info"]["reward_breakdown"]) == {"raw": 1.5}


def test_trajectories_and_older_forms(spark, tmp_path):
    own = {k: v for k, v in entry(0).items() if k not in ("run_id", "episode_id", "step_index")}
    older = {"run_id": "o", "episode_id": 5, "step_index": 0, "observation": state(70.0), "action": {"action": "revert", "rewritten_query": "z"}, "reward": -1.0, "done": True, "info": {"new_ms": 60.0}}
    found, bad = read(spark, tmp_path, {"run_id": "t", "episode_id": 9, "trajectory": [own, own | {"action": "push_filter"}, "no entry"]}, older, {"run_id": "t", "episode_id": 10, "trajectory": []})
    got = rows(found.select("run_id", "episode_id", "step_index", "action", "rewritten_query", F.col("obs_before.execution_ms")), "run_id", "step_index")
    assert got == [("o", 5, 0, "revert", "z", 70.0), ("t", 9, 0, "add_cte", "q", 100.0), ("t", 9, 1, "push_filter", "q", 100.0)]
    assert steplog.attempts(found).filter("run_id = 'o'").first()["new_ms"] == 60.0
    assert sorted(r["problem"] for r in bad.collect()) == ["an entry is not an object", "an entry is not an object"]


def test_bad_lines_are_kept_apart(spark, tmp_path):
    whole = json.dumps(entry(0))
    bad = [whole[: len(whole) // 2], "[1, 2]", "5", whole + whole[:9], {"a": 1}, entry(1, run_id=None), entry(-1), entry(2, action=None), entry(3, obs_before=None, observation=None), entry(4, info=3)]
    found, kept = read(spark, tmp_path, entry(0), *bad)
    assert found.count() == 1 and kept.count() == len(bad)
    assert {r["problem"] for r in kept.collect()} == {
        "not a JSON object", "no id", "negative step", "no action", "no observation before the step", "no info",
    }
    assert all(r["file"] for r in kept.collect())
    nothing, none = steplog.read_step_log(spark, str(tmp_path / "nowhere"))
    assert nothing.count() == 0 and none.count() == 0


def test_replay_agrees_with_the_log_and_shows_where_not(spark, tmp_path):
    log = spark.createDataFrame([attempt(0, ms=4000.0), attempt(1, hash="x"), attempt(2, error="e"), attempt(3, ms=3000.0, plan=(None,) * 6), attempt(4, action="revert", ms=9.0)], ATTEMPT)
    want = scoring.with_history(scoring.score_attempts(log, initial(spark)))
    path = str(tmp_path / "written")
    steplog.write_step_log(want, path)
    found, bad = steplog.read_step_log(spark, path)
    assert bad.count() == 0
    again = scoring.score_attempts(steplog.attempts(found), steplog.initial_observations(found))
    same = ["step_index", "error", "accepted", "reward", "old_ms", "state_ms", "best_ms", "best_query", "step_count", "done", "effective_query"]
    assert rows(again.select(*same), "step_index") == rows(want.select(*same), "step_index")
    assert steplog.disagreements(found, again).count() == 0
    off = found.withColumn("reward", F.when(F.col("step_index") == 3, F.lit(7.0)).otherwise(F.col("reward")))
    assert [r["step_index"] for r in steplog.disagreements(off, again).collect()] == [3]


def test_attempts_without_a_first_observation_stay_and_are_marked(spark, tmp_path):
    lost = [attempt(0, episode=7, ms=1.0, hash="x"), attempt(1, episode=7, action="explode"), attempt(2, episode=7)]
    known = initial(spark, 1)
    scored = scoring.score_attempts(spark.createDataFrame([attempt(0, ms=4000.0), *lost], ATTEMPT), known)
    got = rows(scored.select("episode_id", "step_index", "has_start", "error", "accepted", "done", F.col("reward").isNull()), "episode_id", "step_index")
    assert got == [(1, 0, True, None, True, False, False), (7, 0, False, None, False, False, True), (7, 1, False, "invalid_action", False, False, False), (7, 2, False, None, False, False, True)]
    metrics = episodes.episode_metrics(scored, known)
    assert rows(metrics.select("episode_id", "has_start", "episode_length", "final_execution_ms"), "episode_id") == [(1, True, 1, 4000.0), (7, False, 3, None)]
    # a log whose step 0 is missing starts nowhere
    found, _ = read(spark, tmp_path, entry(1), entry(2))
    assert steplog.initial_observations(found).count() == 0 and steplog.attempts(found).count() == 2


@pytest.fixture(scope="module")
def nested(spark, data):
    rows, _ = catalog._step_log(spark, data)
    return steplog.attempts(rows).cache(), steplog.initial_observations(rows).cache()


@pytest.mark.parametrize("key", [k for k in catalog.CATALOG.queries if k[0] in "SE" and k.split("_")[0] in {"S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10", "E1", "E2", "E4", "E5"}])
def test_scoring_and_episode_keys_on_a_nested_log(spark, data, nested, key, monkeypatch):
    log, start = nested
    played = start.select("run_id", "episode_id")
    # attempts behind the end of an episode are not in a log of what was played
    flat = catalog.attempts(spark, data).join(log.select("run_id", "episode_id", "step_index"), ["run_id", "episode_id", "step_index"], "left_semi")
    given = catalog.standin(spark, data, "initial_obs").join(played, ["run_id", "episode_id"], "left_semi")
    results = []
    for attempts, initial_obs in ((flat, given), (log, start)):
        monkeypatch.setattr(catalog, "attempts", lambda s, d: attempts)
        monkeypatch.setattr(catalog, "standin", lambda s, d, name: initial_obs)
        found = catalog.CATALOG.queries[key](spark, data)
        results.append(sorted(map(repr, found.select(*sorted(found.columns)).collect())))
    assert results[0] == results[1] and results[0]
