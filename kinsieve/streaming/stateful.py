"""Operators with state of their own and timers: the queue of a job, and files that wait for their bucket.

Both need the RocksDB state store (spark.sql.streaming.stateStore.providerClass = ROCKSDB), where an entry of a map or a
list is read and written alone, so a key's state may be larger than memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha1

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.queue import ATTEMPTS, DELAY, LEASE, _wait

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TASK = "status string, attempts int, next_ts double, token string, error string, position long"
#: Tasks that one request may lease.
MOST = 500
#: Rows of a frame that is handed on.
FRAME = 10_000


def token_of(job: str, item: str, attempt: int) -> str:
    """The token of functions.text.lease_token()."""
    return sha1(f"{job}:{item}:{attempt}".encode()).hexdigest()


class JobQueue(StatefulProcessor):
    """The tasks of one job. Rows (item_id, kind, ok, reason, token, size, position), in the order they come:

    start queues an item anew, unless it succeeded, and ends the cooldown; lease takes up to `size` due tasks, fewest
    attempts then position first, none during a cooldown; ack (ok, reason, token) settles a task in flight and is ignored otherwise,
    a reason with 429 stops the whole job until the task itself is due again. A lease that nobody acknowledges runs out by a timer of
    processing time, no event needed. Finished tasks are forgotten after `keep` seconds; one started again after that is a new task.
    Each change is a row of the result.
    """

    def __init__(self, lease: float = LEASE, delay: float = DELAY, most: int = ATTEMPTS, keep: float = 7 * 86400.0):
        self.limits = lease, delay, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lease, self.delay, self.most, keep = self.limits
        self.handle = handle
        self.queued = handle.getMapState("queued", "item_id string", TASK)
        # as many as are in flight: all that a timer looks at
        self.running = handle.getMapState("running", "item_id string", TASK)
        self.done = handle.getMapState("done", "item_id string", TASK, ttlDurationMs=int(keep * 1000))
        self.cooldown = handle.getValueState("cooldown", "until double")

    def _until(self) -> float:
        return self.cooldown.get()[0] if self.cooldown.exists() else 0.0

    def _put(self, item: str, task: tuple) -> None:
        for name, state in (("queued", self.queued), ("inflight", self.running), ("done", self.done)):
            if name == ("done" if task[0] in ("success", "failed") else task[0]):
                state.updateValue((item,), task)
            elif state.containsKey((item,)):
                state.removeKey((item,))

    def _back(self, task: tuple, why: str, due: float) -> tuple:
        return ("failed" if task[1] >= self.most else "queued", task[1], due, None, why, task[5])

    def _start(self, item: str, position: int | None) -> dict:
        self.cooldown.update((0.0,))
        old = next((tuple(s.getValue((item,))) for s in (self.done, self.running, self.queued) if s.containsKey((item,))), None)
        if old and old[0] == "success":
            return {}
        place = position if position is not None else old[5] if old else 0
        return {item: ("queued", 0, 0.0, None, old[4] if old else None, int(place))}

    def _lease(self, job: str, size: int, now: float) -> dict:
        if self._until() > now:
            return {}
        due = ((t[1], t[5], k[0], tuple(t)) for k, t in self.queued.iterator() if t[2] <= now)
        taken = heapq.nsmallest(max(0, min(MOST, size)), due)
        if taken:
            self.handle.registerTimer(int((now + self.lease) * 1000) + 1)
        return {item: ("inflight", n + 1, now + self.lease, token_of(job, item, n + 1), None, place) for n, place, item, _ in taken}

    def _ack(self, item: str, ok: bool | None, reason: str | None, token: str | None, now: float) -> dict:
        if not self.running.containsKey((item,)):
            return {}
        task = tuple(self.running.getValue((item,)))
        if token and token != task[3]:
            return {}
        if ok:
            return {item: ("success", task[1], 0.0, None, None, task[5])}
        due = now + _wait(task[1], reason, self.delay)
        if reason and "429" in reason:
            self.cooldown.update((max(self._until(), due),))
        return {item: self._back(task, reason or "unconfirmed_failure", due)}

    def _expire(self, now: float) -> dict:
        gone = {k[0]: self._back(tuple(t), "result_unconfirmed", now + self.delay) for k, t in self.running.iterator() if t[2] <= now}
        for item, task in gone.items():
            self._put(item, task)
        return gone

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs() / 1000
        changed = self._expire(now)
        for frame in rows:
            for e in frame.astype(object).where(frame.notna(), None).itertuples():
                if e.kind == "start":
                    new = self._start(e.item_id, e.position)
                elif e.kind == "lease":
                    new = self._lease(key[0], int(e.size or 0), now)
                else:
                    new = self._ack(e.item_id, e.ok, e.reason, e.token, now) if e.kind == "ack" else {}
                for item, task in new.items():
                    self._put(item, task)
                changed |= new
                if len(changed) >= FRAME:
                    yield self._rows(key, changed)
                    changed = {}
        yield self._rows(key, changed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield self._rows(key, self._expire(timerValues.getCurrentProcessingTimeInMs() / 1000))

    def _rows(self, key, changed: dict) -> pd.DataFrame:
        return pd.DataFrame([(key[0], item, *task[:5]) for item, task in changed.items()], columns=["job", "item_id", "status", "attempts", "next_ts", "token", "error"])

    def close(self) -> None:
        pass


def job_queue_stream(events: DataFrame, **limits: float) -> DataFrame:
    """Changed tasks (job, item_id, status, attempts, next_ts, token, error) of each micro-batch of events, and those whose lease ran out."""
    rows = events.select("job", F.col("item_id").cast("string").alias("item_id"), "kind", "ok", "reason", "token", F.col("size").cast("long").alias("size"), F.col("position").cast("long").alias("position"))
    schema = "job string, item_id string, status string, attempts int, next_ts double, token string, error string"
    return rows.groupBy("job").transformWithStateInPandas(JobQueue(**limits), schema, "Update", "ProcessingTime")


class Waiting(StatefulProcessor):
    """Files of a bucket, held back until it has two files of two items; then all of them, and later ones as they come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getListState("files", "file_id string, item_id string")
        self.first = handle.getValueState("first", "item_id string, opened boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        first, opened = tuple(self.first.get()) if self.first.exists() else (None, False)
        for frame in rows:
            files = list(zip(frame.file_id, frame.item_id, strict=True))
            if not files:
                continue
            first = files[0][1] if first is None else first
            if not opened and any(item != first for _, item in files):
                opened = True
                yield from self._out(key, (tuple(f) for f in self.files.get()))
                self.files.clear()
            if opened:
                yield from self._out(key, iter(files))
            else:
                self.files.appendList(files)
        if first is not None:
            self.first.update((first, opened))

    def _out(self, key, files: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        held = []
        for file in files:
            held.append((key[0], *file))
            if len(held) >= FRAME:
                yield pd.DataFrame(held, columns=["bucket", "file_id", "item_id"])
                held = []
        if held:
            yield pd.DataFrame(held, columns=["bucket", "file_id", "item_id"])

    def close(self) -> None:
        pass


def candidate_stream(files: DataFrame) -> DataFrame:
    """Files (bucket, file_id, item_id) as soon as their bucket has two files and two items; each file once."""
    rows = files.select("bucket", F.col("file_id").cast("string").alias("file_id"), F.col("item_id").cast("string").alias("item_id"))
    return rows.groupBy("bucket").transformWithStateInPandas(Waiting(), "bucket string, file_id string, item_id string", "Append", "None")
