"""A durable task queue: rules as native expressions, a fold over its events, and the scheduler's choice.

States: queued, inflight, success, failed. Events of an item in order of time:
start, lease, ack (ok, reason, token), expire. An ack of an item that isn't in
flight, or with another token, is ignored, which makes late and repeated acks
harmless; an ack of unknown outcome is a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import backoff, retry_hint_ms
from ..functions.text import lease_token
from .folds import walked

#: Seconds of a lease, and attempts at most.
LEASE, DELAY, ATTEMPTS = 90.0, 5.0, 3


def _state(status, attempts, next_ts, token, error) -> Column:
    return F.struct(status.alias("status"), attempts.alias("attempts"), next_ts.alias("next_ts"), token.alias("token"), error.alias("error"))


def step(s: Column, e: Column, lease: float = LEASE, delay: float = DELAY, most: int = ATTEMPTS) -> Column:
    """The state after an event (kind, at, ok, reason, token)."""
    text = F.lit(None).cast("string")
    expired = (s["status"] == "inflight") & (s["next_ts"] <= e["at"])
    back = lambda why, wait: _state(F.when(s["attempts"] >= most, "failed").otherwise("queued"), s["attempts"], e["at"] + wait, text, why)
    # a lease that ran out goes back to the queue before the event counts
    s1 = F.when(expired, back(F.lit("result_unconfirmed"), F.lit(delay))).otherwise(s)
    leased = _state(F.lit("inflight"), s1["attempts"] + 1, e["at"] + lease, F.coalesce(e["token"], (s1["attempts"] + 1).cast("string")), text)
    mine = (s1["status"] == "inflight") & ((F.coalesce(e["token"], F.lit("")) == "") | (e["token"] == s1["token"]))
    wait = backoff(s1["attempts"], delay, e["reason"])
    failed = _state(F.when(s1["attempts"] >= most, "failed").otherwise("queued"), s1["attempts"], e["at"] + wait, text, F.coalesce(F.nullif(e["reason"], F.lit("")), F.lit("unconfirmed_failure")))
    done = _state(F.lit("success"), s1["attempts"], F.lit(0.0), text, text)
    fresh = _state(F.lit("queued"), F.lit(0), F.lit(0.0), text, text)
    return (
        F.when((e["kind"] == "start") & (s1["status"] != "success"), fresh)
        .when((e["kind"] == "lease") & (s1["status"] == "queued") & (s1["next_ts"] <= e["at"]), leased)
        .when((e["kind"] == "ack") & mine, F.when(F.coalesce(e["ok"], F.lit(False)), done).otherwise(failed))
        .otherwise(s1)
    )


def applied(state: DataFrame, events: DataFrame, keys: list[str], **limits) -> DataFrame:
    """state after at most one event of each task, without Python; tasks without an event stay as they are."""
    fields = ["status", "attempts", "next_ts", "token", "error"]
    both = state.join(events.select(*keys, F.struct("at", "kind", "ok", "reason", "token").alias("_e")), keys, "left")
    after = F.when(F.col("_e").isNull(), F.struct(*fields)).otherwise(step(F.struct(*fields), F.col("_e"), **limits))
    return both.withColumn("_s", after).select(*[F.col("_s")[c].alias(c) if c in fields else F.col(c) for c in state.columns])


def _wait(attempts: int, reason: str | None, delay: float) -> float:
    plain = min(120.0, delay * 2.0 ** (attempts - 1))
    return max(plain, min(120.0, 10.0 * 2.0 ** (attempts - 1))) if reason and "429" in reason else plain


def advance(s: tuple, e, lease: float = LEASE, delay: float = DELAY, most: int = ATTEMPTS) -> tuple:
    """One event on (status, attempts, next_ts, token, error); the same rules as step(), for folds and streams."""
    status, attempts, next_ts, token, error = s
    back = lambda why, wait: ("failed" if attempts >= most else "queued", attempts, e.at + wait, None, why)
    if status == "inflight" and next_ts <= e.at:
        status, attempts, next_ts, token, error = back("result_unconfirmed", delay)
    if e.kind == "start" and status != "success":
        return ("queued", 0, 0.0, None, None)
    if e.kind == "lease" and status == "queued" and next_ts <= e.at:
        return ("inflight", attempts + 1, e.at + lease, e.token or str(attempts + 1), None)
    if e.kind == "ack" and status == "inflight" and (not e.token or e.token == token):
        return ("success", attempts, 0.0, None, None) if e.ok else back(e.reason or "unconfirmed_failure", _wait(attempts, e.reason, delay))
    return (status, attempts, next_ts, token, error)


def folded(events: DataFrame, keys: list[str], **limits) -> DataFrame:
    """The state of each task after its events (at, seq, kind, ok, reason, token), however many they are."""
    schema = "status string, attempts int, next_ts double, token string, error string"
    return walked(events, keys, ["at", "seq"], lambda: ("queued", 0, 0.0, None, None), lambda s, e: advance(s, e, **limits), schema)


def resumed(state: DataFrame, wanted: DataFrame, restart: bool = False) -> DataFrame:
    """Tasks after a start with wanted(job, item_id, and columns such as url and position, which it renews).

    Successes keep all they have; new tasks and all others, wanted or not, are queued without attempts,
    due at once and without a token, an old error still noted. A restart forgets every task of the jobs that start.
    """
    keys = ["job", "item_id"]
    old = state.join(wanted.select("job").distinct(), "job", "left_anti") if restart else state
    renewed = [c for c in wanted.columns if c not in keys]
    both = old.alias("o").join(wanted.alias("w"), keys, "full")
    own = F.col("o.status") == "success"
    fresh = {"status": F.lit("queued"), "attempts": F.lit(0), "next_ts": F.lit(0.0), "token": F.lit("")}
    kept = lambda c: F.when(own, F.col(f"o.{c}")).otherwise(fresh[c]) if c in fresh else F.coalesce(F.col(f"w.{c}"), F.col(f"o.{c}")) if c in renewed else F.col(f"o.{c}")
    return both.select(*keys, *(kept(c).alias(c) for c in state.columns if c not in keys))


def expired(state: DataFrame, now: float, delay: float = DELAY, most: int = ATTEMPTS) -> DataFrame:
    """Leases that ran out go back to the queue, or fail."""
    gone = (F.col("status") == "inflight") & (F.col("next_ts") <= now)
    return state.select(*[c for c in state.columns if c not in ("status", "next_ts")], F.when(gone, F.when(F.col("attempts") >= most, "failed").otherwise("queued")).otherwise(F.col("status")).alias("status"), F.when(gone, F.lit(now + delay)).otherwise(F.col("next_ts")).alias("next_ts"))


def leased(state: DataFrame, now: float, size: int, cooldowns: DataFrame | None = None, lease: float = LEASE) -> DataFrame:
    """The next `size` ready tasks of each job, fewest attempts then position first, in flight with a token; leases
    that ran out are ready again later, and a job in cooldowns(job, cooldown) beyond now leases nothing."""
    ready = expired(state, now).where((F.col("status") == "queued") & (F.col("next_ts") <= now))
    if cooldowns is not None:
        ready = ready.join(cooldowns.where(F.col("cooldown") > now).select("job"), "job", "left_anti")
    # the limit also applies before the shuffle, so a job with very many tasks sends few
    place = F.row_number().over(Window.partitionBy("job").orderBy("attempts", "position", "item_id"))
    ready = ready.withColumn("_place", place).where(F.col("_place") <= min(500, max(0, size))).drop("_place")
    attempt = F.col("attempts") + 1
    return ready.withColumn("status", F.lit("inflight")).withColumn("token", lease_token(F.col("job"), F.col("item_id").cast("string"), attempt)).withColumn("attempts", attempt).withColumn("next_ts", F.lit(now + lease))


def cooldowns(acks: DataFrame, delay: float = DELAY) -> DataFrame:
    """Until when each job may lease nothing: the latest wait that a 429 brought."""
    limited = acks.where(F.coalesce("reason", F.lit("")).contains("429"))
    return limited.groupBy("job").agg(F.max(F.col("at") + backoff(F.col("attempts"), delay, F.col("reason"))).alias("cooldown"))


def stats(state: DataFrame, now: float, cooldown: float = 0.0, keys: tuple[str, ...] = ("job",)) -> DataFrame:
    """Counts of each job once its leases that ran out are back: left are queued, pending in flight."""
    state = expired(state, now)
    n = lambda *names: F.count_if(F.col("status").isin(*names))
    waiting = F.min(F.when(F.col("status").isin("queued", "inflight"), F.col("next_ts")))
    return state.groupBy(*keys).agg(
        n("queued").alias("left"), n("inflight").alias("pending"), F.count_if(F.col("attempts") > 0).alias("assigned"), n("success", "failed").alias("done"), n("success").alias("ok"), n("failed").alias("fail"),
        F.count("*").alias("total"), F.sum("attempts").alias("attempts"), retry_hint_ms(F.lit(float(cooldown)), waiting, F.lit(float(now))).alias("retry_after_ms"),
    )


def outcome(left: Column, assigned: Column, done: Column, fail: Column, idle: Column) -> Column:
    """Exit code of a run: 0 done, 1 with failures, 2 idle with unconfirmed tasks, null still running."""
    return F.when((left == 0) & (assigned == done) & (done > 0), F.when(fail > 0, 1).otherwise(0)).when(idle, 2)


def eligible(state: Column, retry_at: Column, now: float) -> Column:
    """Bits: 1 subscribed, 2 and 4 installed or not in need of work, 8 needs an update."""
    bit = lambda b: state.bitwiseAND(b) != 0
    return bit(1) & ~bit(2) & (F.coalesce(retry_at, F.lit(0.0)) <= now) & (bit(8) | ~bit(4))


def scheduled(items: DataFrame, now: float, group: str) -> DataFrame:
    """The first eligible item of each session, by position, and how many are deferred."""
    deferred = items.groupBy(group).agg(F.count_if(F.col("retry_at") > now).alias("n_deferred"))
    first = items.where(eligible(F.col("state"), F.col("retry_at"), now)).groupBy(group).agg(F.min_by("item_id", F.struct("position", "item_id")).alias("item_id"))
    return deferred.join(first, group, "left")


def supervisor(running: Column, paused: Column, stopped: Column, ui_active: Column, downloads_paused: Column, error: Column) -> Column:
    return F.when(error, "error").when(stopped | ~running, "stopped").when(paused, "paused").when(ui_active, "yielding").when(downloads_paused, "downloads_paused").otherwise("active")


def liveness(status: Column, expired_flag: Column) -> Column:
    return F.when(status.isin(404, 409, 410) | F.coalesce(expired_flag, F.lit(False)), "stop").when(status == 200, "live").otherwise("offline")


def requests(ids: DataFrame, results: DataFrame) -> DataFrame:
    """Completed requests: ids (req_id, item_id, position) each new item once, results (item_id, ok)."""
    first = Window.partitionBy("item_id").orderBy("position", "req_id")
    new = ids.where(F.col("item_id").rlike("^[0-9]+$")).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    every = ids.select("req_id").distinct().join(new.join(results, "item_id", "left").select("req_id", "item_id", "ok"), "req_id", "left")
    done = every.groupBy("req_id").agg(F.count_if(F.col("item_id").isNotNull() & F.col("ok").isNull()).alias("pending"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("fail"))
    return done.where("pending = 0").drop("pending")
