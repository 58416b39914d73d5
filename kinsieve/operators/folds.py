"""Folds over ordered events of a key, one row at a time, with state that stays small however many events a key has.

Events are dealt by key and sorted inside their partitions (the sort spills), then
walked with the state carried from batch to batch; no key's events are gathered.
Rows of one key are walked in one task, as their order asks for.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

REQUEST_GAP, DEFER, IDLE = 1.0, 300.0, 5.0


def walked(events: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], advance: Callable, schema: str, out: Callable = tuple) -> DataFrame:
    """keys and out(state), with columns as in schema, after all events of each key; advance(state, event) gives the next state."""
    columns = events.columns
    own = StructType([events.schema[k] for k in keys] + list(StructType.fromDDL(schema).fields))
    target = to_arrow_schema(own)
    at = [columns.index(k) for k in keys]

    def run(batches):
        event = namedtuple("Event", columns, rename=True)
        key, state = None, None
        for batch in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                now = tuple(row[i] for i in at)
                if now != key:
                    if key is not None:
                        done.append((*key, *out(state)))
                    key, state = now, start()
                state = advance(state, event(*row))
            if done:
                yield _rows(done, target)
        if key is not None:
            yield _rows([(*key, *out(state))], target)

    return events.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, own)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def paced(s: tuple, e) -> tuple:
    """(gap ms, successes in a row, when it last grew, cooldown) after an answer (at, ok, reason): every fifth success in a row
    narrows the gap, a failure doubles it once a second at most, and a limit or a broken network stops all for ten seconds."""
    gap, run, grown, cooldown = s
    if e.ok:
        run += 1
        return (max(50.0, float(int(gap * 0.85))) if run % 5 == 0 else gap, run, grown, cooldown)
    if e.at - grown >= 1.0:
        gap, grown = min(2000.0, gap * 2), e.at
    limited = any(word in (e.reason or "").lower() for word in ("429", "503", "timeout", "network"))
    return (gap, 0, grown, max(cooldown, e.at + 10.0) if limited else cooldown)


def gaps(events: DataFrame, keys: list[str], start: float = 50.0) -> DataFrame:
    """Gap and cooldown of each worker after its answers (at, seq, ok, reason)."""
    return walked(events, keys, ["at", "seq"], lambda: (start, 0, -1e9, 0.0), paced, "gap double, run int, cooldown double", lambda s: (s[0], s[1], s[3]))


def controlled(s: tuple, e) -> tuple:
    """(running, paused, downloads_paused) after a command; all but start do nothing unless it runs. A pause of downloads outlives a restart."""
    running, paused, downloads = s
    if e.kind == "start":
        return (True, False, downloads)
    if not running:
        return s
    if e.kind == "stop":
        return (False, paused, downloads)
    if e.kind in ("pause", "resume"):
        return (True, e.kind == "pause", downloads)
    if e.kind in ("pause-downloads", "resume-downloads"):
        return (True, paused, e.kind == "pause-downloads")
    return s


def controls(events: DataFrame, keys: list[str]) -> DataFrame:
    """Marks of each session after its commands (at, seq, kind)."""
    return walked(events, keys, ["at", "seq"], lambda: (False, False, False), controlled, "running boolean, paused boolean, downloads_paused boolean")


def claimed(s: tuple, e) -> tuple:
    """(owner, runs, refused) after a claim or release (owner): a job that is owned refuses others, and only its owner releases it."""
    owner, runs, refused = s
    if e.kind == "claim":
        return (e.owner, runs + 1, refused) if owner is None else (owner, runs, refused + 1)
    return (None, runs, refused) if e.kind == "release" and owner == e.owner else s


def claims(events: DataFrame, keys: list[str]) -> DataFrame:
    """Owner of each job after its events (at, seq, kind, owner), and how many claims ran and were refused."""
    kind = events.schema["owner"].dataType.simpleString()
    return walked(events, keys, ["at", "seq"], lambda: (None, 0, 0), claimed, f"owner {kind}, runs int, refused int")


def scheduled(s: dict, e) -> dict:
    """The one-at-a-time scheduler after an event (at, kind, item, result).

    request: item is the first candidate, result 1 if the request was accepted; it counts only if nothing is
    active or paused, the gap is over and the item isn't deferred. none: there was no candidate. result: of the
    active item, 1 is success; others' results are ignored, those of a paused session count. restart: item names
    the instance; the same one keeps what is completed, deferred and last.
    """
    late = {i: t for i, t in s["retry"].items() if t > e.at}  # requests are a second apart, so about 300 at most
    s = s | {"retry": late}
    ready = s["active"] is None and not s["paused"] and e.at >= s["next"]
    if e.kind == "restart":
        kept = s if e.item == s["instance"] else idle()
        return kept | {"instance": e.item, "active": None, "paused": False, "next": 0.0}
    if e.kind in ("pause", "resume"):
        return s | {"paused": e.kind == "pause"}
    if e.kind == "result" and s["active"] is not None and e.item == s["active"]:
        last = {"active": None, "last_item": e.item, "last_result": str(e.result)}
        if e.result == 1:
            return s | last | {"completed": s["completed"] + 1, "next": e.at}
        return s | last | {"retry": late | {e.item: e.at + DEFER}, "next": e.at + REQUEST_GAP}
    if e.kind == "none" and ready:
        return s | {"next": e.at + IDLE}
    if e.kind == "request" and ready and e.item not in late:
        if e.result == 1:
            return s | {"active": e.item, "next": e.at + REQUEST_GAP}
        return s | {"retry": late | {e.item: e.at + DEFER}, "last_item": e.item, "last_result": "request_rejected", "next": e.at + REQUEST_GAP}
    return s


def idle() -> dict:
    return {"active": None, "paused": False, "next": 0.0, "retry": {}, "completed": 0, "last_item": None, "last_result": None, "instance": None}


def schedules(events: DataFrame, keys: list[str]) -> DataFrame:
    """State of each session's scheduler after its events (at, seq, kind, item, result)."""
    kind = events.schema["item"].dataType.simpleString()
    schema = f"active {kind}, completed int, deferred int, last_item {kind}, last_result string, next_request double"
    return walked(events, keys, ["at", "seq"], idle, scheduled, schema, lambda s: (s["active"], s["completed"], len(s["retry"]), s["last_item"], s["last_result"], s["next"]))
