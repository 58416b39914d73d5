"""The queue's rules for starts, leases, cooldowns and acknowledgements."""

from collections import namedtuple

from kinsieve.operators import folds, queue
from kinsieve.streaming.queries import advance

STATE = "job string, item_id string, url string, position int, status string, attempts int, next_ts double, token string, error string"


def state(spark):
    return spark.createDataFrame(
        [
            ("j", "1", "u1", 0, "success", 2, 0.0, "t", ""), ("j", "2", "u2", 1, "failed", 3, 70.0, "t", "http_503"), ("j", "3", "u3", 2, "inflight", 1, 40.0, "t", ""),
            ("j", "4", "u4", 3, "queued", 0, 0.0, "", ""), ("k", "4", "u4", 0, "queued", 1, 5.0, "", ""), ("k", "5", "u5", 1, "queued", 0, 0.0, "", ""),
        ],
        STATE,
    )


def test_start(spark):
    wanted = spark.createDataFrame([("j", "2", "new", 0), ("j", "9", "u9", 1)], "job string, item_id string, url string, position int")
    got = {(r.job, r.item_id): (r.url, r.position, r.status, r.attempts, r.next_ts, r.token, r.error) for r in queue.resumed(state(spark).where("job = 'j'"), wanted).collect()}
    assert got["j", "1"] == ("u1", 0, "success", 2, 0.0, "t", "")
    assert got["j", "2"] == ("new", 0, "queued", 0, 0.0, "", "http_503")
    assert got["j", "3"][2:6] == ("queued", 0, 0.0, "")
    assert got["j", "9"][:6] == ("u9", 1, "queued", 0, 0.0, "")
    assert {r.item_id for r in queue.resumed(state(spark), wanted, restart=True).where("job = 'j'").collect()} == {"2", "9"}


def test_lease_of_each_job(spark):
    took = lambda **more: sorted((r.job, r.item_id) for r in queue.leased(state(spark), 50.0, 1, **more).collect())
    assert took() == [("j", "4"), ("k", "5")]
    assert took(cooldowns=spark.createDataFrame([("k", 60.0), ("j", 10.0)], "job string, cooldown double")) == [("j", "4")]


def test_stats(spark):
    r = queue.stats(state(spark), 30.0).where("job = 'j'").first()
    assert (r.left, r.pending, r.done, r.ok, r.fail, r.total) == (1, 1, 2, 1, 1, 4)
    assert queue.stats(state(spark), 50.0).where("job = 'j'").first().left == 2


def test_acknowledgement():
    class Ack:
        kind, at, ok, reason, token = "ack", 10.0, None, None, None

    assert advance(("inflight", 1, 90.0, "1", None), Ack) == ("queued", 1, 15.0, None, "unconfirmed_failure")
    Ack.ok = True
    assert advance(("inflight", 1, 90.0, "1", None), Ack) == ("success", 1, 0.0, None, None)


def test_one_event_each_is_the_fold(spark):
    """step() and advance() are one rule."""
    kinds = [("lease", None, None, None), ("ack", True, None, None), ("ack", False, "http_429", None), ("ack", None, None, "t"), ("ack", True, None, "other"), ("start", None, None, None)]
    states = [("queued", 0, 0.0, None, None), ("queued", 1, 70.0, None, "x"), ("inflight", 1, 90.0, "t", None), ("inflight", 3, 90.0, "t", None), ("inflight", 3, 40.0, "t", None), ("success", 1, 0.0, None, None), ("failed", 3, 60.0, None, "x")]
    rows = [(f"{i}-{j}", *s) for i, s in enumerate(states) for j in range(len(kinds))]
    state = spark.createDataFrame([*rows, ("none", *states[0])], "item_id string, status string, attempts int, next_ts double, token string, error string")
    events = spark.createDataFrame([(f"{i}-{j}", 50.0, *k) for i in range(len(states)) for j, k in enumerate(kinds)], "item_id string, at double, kind string, ok boolean, reason string, token string")
    got = {r.item_id: tuple(r)[1:] for r in queue.applied(state, events, ["item_id"]).collect()}
    Event = namedtuple("Event", "at kind ok reason token")
    assert got == {"none": states[0]} | {f"{i}-{j}": advance(s, Event(50.0, *k)) for i, s in enumerate(states) for j, k in enumerate(kinds)}


def walk(spark, rows):
    """The scheduler's state after events (at, kind, item, result) of one session."""
    events = spark.createDataFrame([("s", float(at), i, kind, item, result) for i, (at, kind, item, result) in enumerate(rows)], "session string, at double, seq int, kind string, item string, result int")
    return tuple(folds.schedules(events, ["session"]).first())[1:]


def test_scheduler(spark):
    one = [(0, "request", "a", 1), (1, "result", "b", 1)]
    assert walk(spark, one) == ("a", 0, 0, None, None, 1.0)  # others' results are ignored
    done = [*one, (2, "result", "a", 1), (2, "request", "b", 1)]
    assert walk(spark, done) == ("b", 1, 0, "a", "1", 3.0)  # at once after a success
    failed = [*done, (5, "result", "b", 2), (5.5, "request", "c", 1), (6, "request", "b", 1), (6, "request", "c", 2)]
    assert walk(spark, failed) == (None, 1, 2, "c", "request_rejected", 7.0)  # a second after a failure; b is deferred
    assert walk(spark, [*failed, (306, "request", "b", 1)])[:3] == ("b", 1, 0)
    assert walk(spark, [*failed, (8, "none", None, None), (12, "request", "d", 1)])[0] is None
    assert walk(spark, [*one, (2, "pause", None, None), (3, "result", "a", 1), (4, "request", "b", 1)])[:2] == (None, 1)
    assert walk(spark, [(0, "restart", "i", None), *done, (9, "restart", "i", None)])[:2] == (None, 1)
    assert walk(spark, [(0, "restart", "i", None), *done, (9, "restart", "k", None)])[:2] == (None, 0)


def test_walk_over_many_batches(spark):
    """State is carried from batch to batch; empty input gives no rows."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        events = spark.range(100).selectExpr("id % 2 as worker", "cast(id as double) at", "id as seq", "id % 10 <> 9 as ok", "'http_503' as reason")
        got = {r.worker: (r.gap, r.run, r.cooldown) for r in folds.gaps(events, ["worker"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    s = (50.0, 0, -1e9, 0.0)
    Event = namedtuple("Event", "at ok reason")
    for i in range(1, 100, 2):
        s = folds.paced(s, Event(float(i), i % 10 != 9, "http_503"))
    assert got[0] == (50.0, 50, 0.0) and got[1] == (s[0], s[1], s[3])
    assert folds.gaps(events.limit(0), ["worker"]).collect() == []
