"""Totals of episodes while they run, from state that holds every open session.

A session of an episode lasts until no step comes for ``gap``.  Each batch gives a row for every session it changed, long before
the session closes; the row of a later batch replaces it.  A step that joins two sessions, or comes before a session's first one, takes over their
rows: what they were known by before is put out as ``replaced``.  When the watermark passes the end of a session, a timer
closes it, its last row says so, and its state is dropped, so state lives as long as a session may still change and no longer.  Steps later than
the watermark's delay are dropped, so none can reach a session that has closed.

State is one small summary for each open session, merged row by row: however many steps a batch brings for an episode, none is held.
Episodes are dealt to :data:`BUCKETS` by a hash, and a bucket keeps its open sessions in one list with one timer, for the earliest end among them:
every call for a key costs a few messages between Spark and Python, so calls are for buckets, and their number does not grow with the episodes.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from decimal import Decimal

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plangauge.streaming.jobs import event_time

# Python workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RUNNING, CLOSED, REPLACED = "running", "closed", "replaced"
KEYS = ["run_id", "episode_id", "session_start"]
# Times are whole microseconds, as Spark keeps them.
# A checkpoint belongs to one number of buckets.
BUCKETS = 1 << 14
SESSION = "run_id string, episode_id long, first long, last long, steps long, reward decimal(38,4), final_index long, final_ms double, syntax long, changed long"
TOTALS = (
    "run_id string, episode_id long, session_start timestamp, session_end timestamp, episode_length long, episode_total_reward decimal(38,4), "
    "final_execution_ms double, syntax_penalties long, result_penalties long, state string"
)
FIELDS = [part.split()[0] for part in SESSION.replace("38,4", "").split(", ")]
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def merge(a: dict, b: dict) -> dict:
    """Two summaries of the same session; of steps at the same time the one with the greater index is the last."""
    late = max((a, b), key=lambda s: (s["last"], s["final_index"]))
    both = {c: a[c] + b[c] for c in ("steps", "reward", "syntax", "changed")}
    return a | both | {"first": min(a["first"], b["first"]), "last": late["last"], "final_index": late["final_index"], "final_ms": late["final_ms"]}


def add_step(sessions: list[dict], step: dict, gap: int) -> list[dict]:
    """The sessions of an episode with one more step: those less than ``gap`` away become one."""
    apart = []
    for session in sessions:
        if step["first"] - session["last"] < gap and session["first"] - step["last"] < gap:
            step = merge(session, step)
        else:
            apart.append(session)
    return [*apart, step]


class OpenSessions(StatefulProcessor):
    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", SESSION)

    def _row(self, session: dict, state: str) -> Row:
        at = lambda us: EPOCH + dt.timedelta(microseconds=us)
        return Row(
            run_id=session["run_id"], episode_id=session["episode_id"], session_start=at(session["first"]), session_end=at(session["last"] + self.gap), episode_length=session["steps"],
            episode_total_reward=session["reward"], final_execution_ms=session["final_ms"], syntax_penalties=session["syntax"], result_penalties=session["changed"], state=state,
        )

    def _timer(self, session: dict) -> int:
        """Milliseconds at which the session is over, rounded up."""
        return -(-(session["last"] + self.gap) // 1000)

    def _held(self) -> list[dict]:
        return [dict(zip(FIELDS, s)) for s in self.sessions.get()]

    def _hold(self, sessions: list[dict]) -> None:
        if sessions:
            self.sessions.put([tuple(s[c] for c in FIELDS) for s in sessions])
        else:
            self.sessions.clear()

    def _earliest(self, sessions: list[dict]) -> int | None:
        return min(map(self._timer, sessions), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self._held()
        before: dict[tuple, list[dict]] = {}
        for s in held:
            before.setdefault((s["run_id"], s["episode_id"]), []).append(s)
        now = dict(before)
        watermark = 1000 * timerValues.getCurrentWatermarkInMs()
        changed = set()
        for r in rows:
            if r.us < watermark:  # Spark itself tells late rows by the watermark of the batch before
                continue
            episode = (r.run_id, r.episode_id)
            changed.add(episode)
            step = {"run_id": r.run_id, "episode_id": r.episode_id, "first": r.us, "last": r.us, "steps": 1, "reward": r.reward or Decimal(0), "final_index": r.step_index, "final_ms": r.new_ms}
            step |= {"syntax": int(r.error == "syntax_error"), "changed": int(r.error == "result_changed")}
            now[episode] = add_step(now.get(episode, []), step, self.gap)
        if not changed:
            return
        sessions = [s for of_one in now.values() for s in of_one]
        self._hold(sessions)
        old, new = self._earliest(held), self._earliest(sessions)
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(new)
        for episode in changed:
            known = before.get(episode, [])
            starts = {s["first"] for s in now[episode]}
            for s in known:
                if s["first"] not in starts:
                    yield self._row(s, REPLACED)
            for s in now[episode]:
                if s not in known:
                    yield self._row(s, RUNNING)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # the timer is that of the earliest end; all that the watermark has passed close with it
        over = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        sessions = self._held()
        left = [s for s in sessions if self._timer(s) > over]
        self._hold(left)
        if left:
            self.handle.registerTimer(self._earliest(left))
        for s in sessions:
            if self._timer(s) <= over:
                yield self._row(s, CLOSED)


def running_episode_totals(steps: DataFrame, gap: dt.timedelta = dt.timedelta(hours=1), delay: str = "1 hour") -> DataFrame:
    """Changes of the totals of open and closing sessions, for :func:`plangauge.streaming.jobs.start_versioned` with :data:`KEYS`.

    Expects run_id, episode_id, step_index, ts, reward, new_ms, error.  A null reward counts as 0.
    """
    for name, value in STATE_STORE.items():
        steps.sparkSession.conf.set(name, value)
    timed = event_time(steps, delay=delay)
    narrow = timed.select(
        F.pmod(F.xxhash64("run_id", "episode_id"), F.lit(BUCKETS)).alias("_bucket"), "run_id", "episode_id", F.coalesce(F.col("step_index").cast("long"), F.lit(-1)).alias("step_index"), "ts", F.unix_micros("ts").alias("us"),
        F.col("reward").cast("decimal(18,4)").alias("reward"), F.col("new_ms").cast("double").alias("new_ms"), "error",
    )
    micros = gap // dt.timedelta(microseconds=1)
    return narrow.groupBy("_bucket").transformWithState(OpenSessions(micros), TOTALS, "Update", "EventTime")


def current(versions: DataFrame) -> DataFrame:
    """The sessions that exist: the newest row of each, without those that others have taken over."""
    return versions.filter(F.col("state") != REPLACED).withColumn("closed", F.col("state") == CLOSED).drop("state")
