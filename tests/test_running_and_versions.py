"""Episodes while they run, and versioned outputs through compaction and crashes."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_streams_and_sources import START, arrive, step

from plangauge.streaming import jobs, running, versions


def totals(spark, folder):
    rows = running.current(jobs.latest_versions(spark, folder, running.KEYS)).orderBy("episode_id", "session_start").collect()
    minute = lambda at: int((at - START).total_seconds() // 60)
    return [(r["episode_id"], minute(r["session_start"]), minute(r["session_end"]), r["episode_length"], float(r["episode_total_reward"]), r["final_execution_ms"], r["syntax_penalties"], r["result_penalties"], r["closed"]) for r in rows]


def run(spark, folder, *files, delay="1 hour"):
    stream = arrive(spark, folder, *files)
    jobs.start_versioned(running.running_episode_totals(stream, delay=delay), folder, keys=running.KEYS).awaitTermination()
    return totals(spark, folder)


def test_open_sessions_appear_and_are_replaced_by_later_rows(spark, tmp_path):
    got = run(spark, str(tmp_path), [step(0), step(5, error="syntax_error"), step(7, 2, 2.0)], [step(20, 1, -3.0, "result_changed"), step(20, 1, 0.5, index=1)])
    assert got == [(1, 0, 80, 4, -0.5, 20.0, 1, 1, False), (2, 7, 67, 1, 2.0, 7.0, 0, 0, False)]
    batches = spark.read.parquet(f"{tmp_path}/data")
    assert batches.filter("batch = 0 and episode_id = 1").select("episode_length", "state").collect() == [(2, "running")]


def test_sessions_close_once_the_watermark_has_passed_and_late_rows_are_dropped(spark, tmp_path):
    # the watermark is an hour behind minute 300 when the third file comes: minute 5 is late, minute 250 is not
    got = run(spark, str(tmp_path), [step(0), step(10)], [step(300)], [step(250, 1, 4.0), step(5, 1, 99.0)], [step(1000, 3)])
    assert got == [(1, 0, 70, 2, 2.0, 10.0, 0, 0, True), (1, 250, 360, 2, 5.0, 300.0, 0, 0, True), (3, 1000, 1060, 1, 1.0, 1000.0, 0, 0, False)]


def test_a_step_between_two_sessions_joins_them(spark, tmp_path):
    got = run(spark, str(tmp_path), [step(0), step(100)], [step(50)], [step(-20)], delay="3 hours")
    assert got == [(1, -20, 160, 4, 4.0, 100.0, 0, 0, False)]
    gone = spark.read.parquet(f"{tmp_path}/data").filter("state = 'replaced'").select(F.col("session_start")).collect()
    assert len(gone) == 2


def test_merging_steps_in_any_order_gives_the_sessions_of_a_sorted_pass():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(0, 1000) for _ in range(rng.randint(1, 30))]
        steps = [{"first": t, "last": t, "steps": 1, "reward": Decimal(1), "final_index": k, "final_ms": float(k), "syntax": 0, "changed": 0} for k, t in enumerate(times)]
        rng.shuffle(steps)
        sessions = []
        for s in steps:
            sessions = running.add_step(sessions, s, 40)
        want = []
        for t, k in sorted((t, k) for k, t in enumerate(times)):
            if want and t - want[-1]["last"] < 40:
                want[-1] |= {"last": t, "steps": want[-1]["steps"] + 1, "final": k}
            else:
                want.append({"first": t, "last": t, "steps": 1, "final": k})
        got = sorted(sessions, key=lambda s: s["first"])
        assert [(s["first"], s["last"], s["steps"], s["final_index"]) for s in got] == [(s["first"], s["last"], s["steps"], s["final"]) for s in want]


def test_a_restarted_query_goes_on_from_its_state(spark, tmp_path):
    folder = str(tmp_path)
    first = run(spark, folder, [step(0), step(10)])
    assert first == [(1, 0, 70, 2, 2.0, 10.0, 0, 0, False)]
    spark.createDataFrame([step(30, 1, 5.0)], "run_id string, episode_id long, step_index int, ts timestamp_ntz, new_ms double, reward double, error string, action string").coalesce(1).write.parquet(f"{folder}/in/f=9")
    schema = spark.read.parquet(f"{folder}/in/f=9").schema
    stream = jobs.read_stream(spark, f"{folder}/in/*", schema, files_per_batch=1)
    jobs.start_versioned(running.running_episode_totals(stream), folder, keys=running.KEYS).awaitTermination()
    assert totals(spark, folder) == [(1, 0, 90, 3, 7.0, 30.0, 0, 0, False)]


def batch(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def read(folder):
    return dict(map(tuple, folder.latest(["k"]).collect()))


def test_reading_costs_one_snapshot_and_the_open_batches(spark, tmp_path):
    kept = versions.Folder(spark, str(tmp_path))
    with pytest.raises(ValueError):
        kept.latest(["k"])
    assert kept.latest(["k"], batch(spark, ("a", 1)).schema).count() == 0 and not kept.compact(["k"])
    for n in range(7):
        kept.write(batch(spark, ("a", n), (f"k{n}", n)), n)
        if n % 3 == 2:
            assert kept.compact(["k"])
    snapshot, open_batches = kept.live()
    assert snapshot["upto"] == 5 and open_batches == [6]
    assert read(kept) == {"a": 6} | {f"k{n}": n for n in range(7)}
    # what only older manifests need is gone: storage follows the keys, not the batches
    assert kept.manifests() == [2, 5] and kept.batches() == [3, 4, 5, 6] and len(list((tmp_path / "snapshots").iterdir())) == 2


@pytest.mark.parametrize("dies_in", ["_switch", "clean"])
def test_a_crash_in_compaction_changes_nothing_for_readers(spark, tmp_path, monkeypatch, dies_in):
    kept = versions.Folder(spark, str(tmp_path))
    for n in range(4):
        kept.write(batch(spark, ("a", n), (f"k{n}", n)), n)
    want = read(kept)

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(versions.Folder, dies_in, die)
        with pytest.raises(RuntimeError):
            kept.compact(["k"])
    again = versions.Folder(spark, str(tmp_path))
    assert read(again) == want
    # the batch is tried again: a snapshot that holds it already is not undone
    again.write(batch(spark, ("a", 3), ("k3", 3)), 3)
    again.write(batch(spark, ("a", 4)), 4)
    assert read(again) == want | {"a": 4}
    assert again.compact(["k"]) and read(again) == want | {"a": 4}
    known = {m["snapshot"] for m in (again._manifest(n) for n in again.manifests())}
    assert {p.name for p in (tmp_path / "snapshots").iterdir()} == known


def test_unfinished_batches_are_not_read(spark, tmp_path):
    kept = versions.Folder(spark, str(tmp_path))
    kept.write(batch(spark, ("a", 1)), 0)
    kept.write(batch(spark, ("a", 2)), 1)
    (tmp_path / "data" / "batch=1" / "_SUCCESS").unlink()
    assert read(kept) == {"a": 1}


def test_stream_compacts_while_it_runs(spark, tmp_path):
    folder = str(tmp_path)
    files = [[step(k, 1 + k % 3)] for k in range(9)]
    stream = arrive(spark, folder, *files)
    keys = ["window_start", "window_end", "action"]
    jobs.start_versioned(jobs.penalty_windows(stream, delay="2 hours"), folder, keys=keys, compact_every=3).awaitTermination()
    snapshot, open_batches = versions.Folder(spark, folder).live()
    assert snapshot is not None and len(open_batches) <= 3
    assert [r["attempts"] for r in jobs.latest_versions(spark, folder, keys).collect()] == [9]


def test_health_states_of_two_batches_are_stored(spark, data, tmp_path):
    from plangauge.sources.standins import standin

    folder = str(tmp_path)
    history = standin(spark, data, "history")
    for k in range(5):
        history.filter(F.col("step") % 5 == k).coalesce(1).write.parquet(f"{folder}/in/f={k}")
    stream = jobs.read_stream(spark, f"{folder}/in/*", history.schema, files_per_batch=1)
    jobs.start_health_checks(stream, folder, keep_reports=2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.is_dir()) == ["batch=3", "batch=4"]
    assert sorted(p.name for p in (tmp_path / "reports").iterdir() if p.is_dir()) == ["batch=3", "batch=4"]
    want = jobs.health_report(jobs.series.compact(history)).select("run_id", "global_step").collect()
    assert sorted(jobs.latest_report(spark, folder).select("run_id", "global_step").collect()) == sorted(want)


def test_the_state_of_open_sessions_can_be_read_back(spark, tmp_path):
    folder = str(tmp_path)
    run(spark, folder, [step(0), step(10), step(7, 2, 2.0)])
    held = spark.read.format("statestore").option("stateVarName", "sessions").option("flattenCollectionTypes", "true").load(f"{folder}/checkpoint")
    found = held.select("key.*", "list_element.*").orderBy("episode_id").select("episode_id", "steps").collect()
    assert [tuple(r) for r in found] == [(1, 2), (2, 1)]


def test_episodes_of_one_bucket_share_state_and_close_one_by_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(running, "BUCKETS", 1)
    folder = str(tmp_path)
    got = run(spark, folder, [step(0), step(10), step(30, 2, 2.0), step(200, 3)], [step(220, 3)], [step(400, 4)])
    assert got == [(1, 0, 70, 2, 2.0, 10.0, 0, 0, True), (2, 30, 90, 1, 2.0, 30.0, 0, 0, True), (3, 200, 280, 2, 2.0, 220.0, 0, 0, True), (4, 400, 460, 1, 1.0, 400.0, 0, 0, False)]
    held = spark.read.format("statestore").option("stateVarName", "sessions").option("flattenCollectionTypes", "true").load(f"{folder}/checkpoint")
    assert held.select("key").distinct().count() == 1 and [r[0] for r in held.select("list_element.episode_id").collect()] == [4]
