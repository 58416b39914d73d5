"""Queries of folds over ordered events, and of the rules around runs, on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import archive, catalog, folds, groups, queue, store
from .media import ORACLE as MEDIA
from .media import keeper_order
from .records import _t, delta_filter, folder_counts
from .records import ORACLE as RECORDS


def _at(spark, sf_dir):
    """Each user's events in order of time."""
    return _t(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).withColumn("seq", F.col("event_id"))


def pace_fold(spark, sf_dir):
    """Users as workers, errors as failures."""
    reason = F.when(F.col("event_id") % 3 == 0, "http_503").when(F.col("event_id") % 3 == 1, "Timeout").otherwise("bad_response")
    answers = _at(spark, sf_dir).select("user_id", "at", "seq", F.col("event_type").isin("click", "view", "purchase").alias("ok"), reason.alias("reason"))
    return folds.gaps(answers, ["user_id"])


def control_fold(spark, sf_dir):
    commands = F.array(*map(F.lit, ("start", "pause", "resume", "pause-downloads", "resume-downloads", "stop", "status")))
    return folds.controls(_at(spark, sf_dir).select("user_id", "at", "seq", F.get(commands, (F.col("event_id") % 7).cast("int")).alias("kind")), ["user_id"])


def claim_fold(spark, sf_dir):
    """Users as jobs that three owners claim and release."""
    return folds.claims(_at(spark, sf_dir).select("user_id", "at", "seq", F.when(F.col("event_id") % 2 == 0, "claim").otherwise("release").alias("kind"), (F.col("event_id") % 3).cast("string").alias("owner")), ["user_id"])


def schedule_fold(spark, sf_dir):
    """Users as sessions: requests of three items, results of them, now and then a pause or a restart."""
    k = F.col("event_id")
    kind = F.when(k % 41 == 0, "restart").when(k % 37 == 0, "pause").when(k % 37 == 1, "resume").when(k % 2 == 0, "request").otherwise("result")
    item = F.when(k % 41 == 0, F.lit(7)).otherwise(F.col("user_id") % 3)
    return folds.schedules(_at(spark, sf_dir).select("user_id", "at", "seq", kind.alias("kind"), item.cast("string").alias("item"), F.when(k % 5 == 0, 2).otherwise(1).alias("result")), ["user_id"])


def queue_apply(spark, sf_dir):
    """Tasks after one acknowledgement of each task with an odd number."""
    k = F.col("event_id")
    tasks = _t(spark, sf_dir, "events").select(k.alias("item_id"), F.when(k % 3 == 0, "queued").when(k % 3 == 1, "inflight").otherwise("success").alias("status"), (k % 4).cast("int").alias("attempts"), (k % 100).cast("double").alias("next_ts"), F.lit("t").alias("token"), F.lit(None).cast("string").alias("error"))
    reason = F.when(k % 7 == 0, "http_429").when(k % 7 == 1, "timeout")
    acks = _t(spark, sf_dir, "events").where(k % 2 == 1).select(k.alias("item_id"), F.lit(50.0).alias("at"), F.lit("ack").alias("kind"), reason.isNull().alias("ok"), reason.alias("reason"), F.when(k % 11 == 0, "other").otherwise("t").alias("token"))
    return queue.applied(tasks, acks, ["item_id"])


def job_cooldowns(spark, sf_dir):
    k = F.col("event_id")
    acks = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (k % 1000).cast("double").alias("at"), (k % 4 + 1).cast("int").alias("attempts"), F.when(F.col("event_type") == "error", "http_429").otherwise("timeout").alias("reason"))
    return queue.cooldowns(acks)


def idle_polling(spark, sf_dir):
    polls = _at(spark, sf_dir).select("user_id", "event_id", "at", "seq", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("found"))
    return archive.idle_wait(polls, ["user_id"]).select("event_id", "wait")


def outbox_replay(spark, sf_dir):
    """Results of each user's items that no later purchase acknowledged."""
    e = _t(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 17).alias("item_id"), "event_type").distinct()
    return store.unreported(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id", "item_id"]).select("user_id", "item_id")


def update_counters(spark, sf_dir):
    return store.update_counters(delta_filter(spark, sf_dir))


def twin_chain(spark, sf_dir):
    """Every third customer has a feature of its own, every second an archived one, every fifth a backup."""
    k = F.col("c_custkey")
    place = lambda root: F.concat(F.lit(root), k.cast("string"))
    c = _t(spark, sf_dir, "customer")
    files = c.select("c_custkey", place("/content/").alias("path"), (k % 2).alias("size"), F.array(place("/local/"), place("/backup/")).alias("twin_paths"))
    of = lambda root, n, size: c.where(k % n == 0).select(place(root).alias("path"), size.alias("size"), F.concat(F.lit(root), k.cast("string")).alias("feature"))
    features = of("/content/", 3, k % 2).unionByName(of("/local/", 2, F.lit(0))).unionByName(of("/backup/", 5, k % 2))
    return store.with_twins(files, features, "feature").select("c_custkey", "feature", "mirrored")


def archive_manifest(spark, sf_dir):
    """Customers as folder keys: archived videos in two spellings, other files, other places."""
    k = F.col("c_custkey")
    root = F.when(k % 5 == 0, "C:\\lib\\Projects\\MyProjects\\").when(k % 5 == 1, "D:/x/projects/backup/").when(k % 5 == 2, "/lib/projects/defaultprojects/").otherwise("/lib/PROJECTS/myprojects/")
    name = F.when(k % 3 == 0, "a.MP4").when(k % 3 == 1, "b/c.webm").otherwise("preview.jpg")
    keys = _t(spark, sf_dir, "customer").select(F.explode(F.array(F.concat(root, (k % 500).cast("string"), F.lit("/"), name), F.upper(F.concat(root, (k % 500).cast("string"), F.lit("/"), name)))).alias("key"))
    return catalog.manifest(keys)


def media_gaps(spark, sf_dir):
    """Orders as archived items whose project names a line: by number, with a step upwards, or none."""
    k = F.col("o_orderkey")
    file = F.when(k % 11 == 0, F.lit(None)).when(k % 7 == 0, F.concat(F.lit("../"), (k % 5).cast("string"))).when(k % 3 == 0, F.concat(F.lit(".\\"), (k % 5).cast("string"))).otherwise((k % 5).cast("string"))
    target = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("rel"))
    return catalog.media_gaps(_t(spark, sf_dir, "orders").select(k.alias("item_id"), file.alias("file")), target)


def union_ids(spark, sf_dir):
    ids = lambda table, column: _t(spark, sf_dir, table).select(F.col(column).alias("item_id"))
    return catalog.union_ids(ids("orders", "o_custkey"), ids("events", "user_id"), ids("supplier", "s_suppkey"))


def json_rows(spark, sf_dir):
    return folder_counts(spark, sf_dir).select(F.to_json(F.struct("path", "n_items", "n_archived", "n_alive", "n_orphan")).alias("json"))


def dual_export(spark, sf_dir):
    """Orders of each customer in keeper order, as links and as folders, with the number of their group."""
    members = keeper_order(spark, sf_dir)
    group, item = members.columns[0], "item_id"
    members = members.withColumn("_link", F.concat(F.lit("l/"), F.col(item).cast("string"))).withColumn("_folder", F.concat(F.lit("f/"), F.col(item).cast("string")))
    links, folders = groups.dual_export(members, "_link", "_folder", group)
    out = lambda df, name: df.select("seq", F.col("rank").cast("long").alias("rank"), F.lit(name).alias("sheet"), F.col(name).alias("value"))
    return out(links, "link").unionByName(out(folders, "folder"))


def run_rules(spark, sf_dir):
    """State of a run and mode of the next one's log, readiness of stored sound, values as TOML, outcome of removals."""
    k = F.col("event_id")
    state = archive.final_state(F.when(k % 13 == 0, F.lit(None)).otherwise(k % 3))
    digest, raw = F.when(k % 3 != 0, "d").when(k % 2 == 0, ""), F.when(k % 5 != 0, "r")
    pages = F.array(*map(F.lit, ("subscribed", "not_subscribed", "unknown")))
    page = lambda n: F.get(pages, (F.floor(k / n) % 3).cast("int"))
    gone = archive.removal_outcome(k % 17 != 0, k % 5 == 0, F.when(k % 7 == 0, 500).otherwise(200), k % 11 != 0, page(3), page(9), k % 2 == 0)
    return _t(spark, sf_dir, "events").select(
        "event_id", state.alias("state"), archive.log_mode(F.when(k % 4 != 0, state)).alias("log_mode"), archive.audio_ready(digest, raw, True, False).alias("keyed"), archive.audio_ready(digest, raw, False, True).alias("rescued"),
        archive.audio_ready(digest, raw, False, False).alias("silent"), T.toml_scalar(F.col("props"), "string").alias("text"), T.toml_scalar(k % 2 == 0, "boolean").alias("flag"), T.toml_scalar(k, "int").alias("number"),
        gone["success"].alias("success"), gone["verified"].alias("verified"), gone["reason"].alias("reason"),
    )


QUERIES = {f.__name__: f for f in (
    pace_fold, control_fold, claim_fold, schedule_fold, queue_apply, job_cooldowns, idle_polling, outbox_replay, update_counters, twin_chain, archive_manifest, media_gaps, union_ids, json_rows, dual_export, run_rules,
)}


def _fold(events: str, start: str, after: str, columns: str) -> str:
    """SQL that walks each user's events: e adds columns to them, f holds the state after n of them."""
    return f"""with recursive e as (select *, row_number() over (partition by user_id order by ts, event_id) n, epoch_us(ts) / 1e6 t, {events} from events),
f as (select distinct user_id, cast(0 as bigint) n, {start} from events union all select f.user_id, e.n, {after} from f join e on e.user_id = f.user_id and e.n = f.n + 1)
select {columns} from f qualify row_number() over (partition by user_id order by n desc) = 1"""


ORACLE = {
    "queue_fold": _fold(
        "event_id % 2 = 1 as lease, case event_type when 'error' then 'http_503' when 'signup' then 'http_429' end reason",
        "'queued' status, cast(0 as bigint) attempts, cast(0 as double) next_ts, cast(null as varchar) error",
        """case when lease and status = 'queued' and next_ts <= t then 'inflight' when not lease and status = 'inflight' then case when reason is null then 'success' when attempts >= 3 then 'failed' else 'queued' end else status end,
case when lease and status = 'queued' and next_ts <= t then attempts + 1 else attempts end,
case when lease and status = 'queued' and next_ts <= t then t + 1e9 when not lease and status = 'inflight' then case when reason is null then 0 else t + case when reason like '%429%' then least(120, 10 * pow(2, attempts - 1)) else least(120, 5 * pow(2, attempts - 1)) end end else next_ts end,
case when lease and status = 'queued' and next_ts <= t then null when not lease and status = 'inflight' then reason else error end""",
        "user_id item_id, status, attempts, error",
    ),
    "pace_fold": _fold(
        "event_type in ('click', 'view', 'purchase') as ok, event_id % 3 < 2 as narrow",
        "cast(50 as double) gap, cast(0 as integer) run, cast(-1e9 as double) grown, cast(0 as double) cooldown",
        "case when ok then case when (run + 1) % 5 = 0 then greatest(50, floor(gap * 0.85)) else gap end when t - grown >= 1 then least(2000, gap * 2) else gap end, cast(case when ok then run + 1 else 0 end as integer), case when not ok and t - grown >= 1 then t else grown end, case when not ok and narrow then greatest(cooldown, t + 10) else cooldown end",
        "user_id, gap, run, cooldown",
    ),
    "control_fold": _fold(
        "event_id % 7 as c",
        "false running, false paused, false downloads_paused",
        "case when c = 0 then true when c = 5 then false else running end, case when c = 0 then false when running and c = 1 then true when running and c = 2 then false else paused end, case when running and c = 3 then true when running and c = 4 then false else downloads_paused end",
        "user_id, running, paused, downloads_paused",
    ),
    "claim_fold": _fold(
        "event_id % 2 = 0 as claim, cast(event_id % 3 as varchar) who",
        "cast(null as varchar) as owner, cast(0 as integer) runs, cast(0 as integer) refused",
        "case when claim then coalesce(owner, who) when owner = who then null else owner end, cast(runs + case when claim and owner is null then 1 else 0 end as integer), cast(refused + case when claim and owner is not null then 1 else 0 end as integer)",
        "user_id, owner, runs, refused",
    ),
    "schedule_fold": _fold(
        "case when event_id % 41 = 0 then 'restart' when event_id % 37 = 0 then 'pause' when event_id % 37 = 1 then 'resume' when event_id % 2 = 0 then 'request' else 'result' end kind, cast(user_id % 3 as varchar) item, event_id % 5 > 0 fine",
        "cast(null as varchar) active, false paused, cast(0 as double) nxt, cast(null as double) retry, cast(0 as integer) completed, cast(null as varchar) last_item, cast(null as varchar) last_result, false known",
        """case when kind = 'restart' or kind = 'result' then null when kind = 'request' and active is null and not paused and t >= nxt and not coalesce(retry > t, false) and fine then item else active end,
case kind when 'restart' then false when 'pause' then true when 'resume' then false else paused end,
case when kind = 'restart' then 0 when kind = 'result' and active is not null then case when fine then t else t + 1 end when kind = 'request' and active is null and not paused and t >= nxt and not coalesce(retry > t, false) then t + 1 else nxt end,
case when kind = 'restart' and not known then null when not fine and (kind = 'result' and active is not null or kind = 'request' and active is null and not paused and t >= nxt and not coalesce(retry > t, false)) then t + 300 when retry > t then retry end,
cast(case when kind = 'restart' and not known then 0 when kind = 'result' and active is not null and fine then completed + 1 else completed end as integer),
case when kind = 'restart' and not known then null when kind = 'result' and active is not null then item when kind = 'request' and active is null and not paused and t >= nxt and not coalesce(retry > t, false) and not fine then item else last_item end,
case when kind = 'restart' and not known then null when kind = 'result' and active is not null then case when fine then '1' else '2' end when kind = 'request' and active is null and not paused and t >= nxt and not coalesce(retry > t, false) and not fine then 'request_rejected' else last_result end,
known or kind = 'restart'""",
        "user_id, active, completed, cast(case when retry is null then 0 else 1 end as integer) deferred, last_item, last_result, nxt next_request",
    ),
    "queue_apply": """with t as (select event_id k, case event_id % 3 when 0 then 'queued' when 1 then 'inflight' else 'success' end s, cast(event_id % 4 as integer) a, cast(event_id % 100 as double) x from events),
u as (select k, a, case when k % 2 = 1 and s = 'inflight' and x <= 50 then case when a >= 3 then 'failed' else 'queued' end else s end s, k % 2 = 1 and s = 'inflight' and x <= 50 gone, k % 2 = 1 and s = 'inflight' and x > 50 and k % 11 <> 0 mine, case k % 7 when 0 then 'http_429' when 1 then 'timeout' end r, x from t)
select k item_id, case when mine then case when r is null then 'success' when a >= 3 then 'failed' else 'queued' end else s end status, a attempts,
case when gone then 55.0 when mine then case when r is null then 0.0 when r = 'http_429' then 50 + least(120, 10 * pow(2, a - 1)) else 50 + least(120, 5 * pow(2, a - 1)) end else x end next_ts, case when gone or mine then null else 't' end as token, case when gone then 'result_unconfirmed' when mine then r end error from u""",
    "job_cooldowns": "select user_id job, max(event_id % 1000 + least(120, 10 * pow(2, event_id % 4))) cooldown from events where event_type = 'error' group by 1",
    "idle_polling": """with s as (select *, count(case when event_type = 'purchase' then 1 end) over (partition by user_id order by ts, event_id) g from events),
c as (select event_id, count(case when event_type <> 'purchase' then 1 end) over (partition by user_id, g order by ts, event_id) n from s)
select event_id, cast(case least(n, 6) when 0 then 2500 when 1 then 3500 when 2 then 4900 when 3 then 6860 when 4 then 9604 when 5 then 13446 else 15000 end as integer) wait from c""",
    "outbox_replay": "select distinct user_id, event_id % 17 item_id from events where event_type = 'click' except select user_id, event_id % 17 from events where event_type = 'purchase'",
    "update_counters": f"with d as ({RECORDS['delta_filter']}) select count(*) received, count(case when not keep then 1 end) unchanged from d",
    "twin_chain": "select c_custkey, case when c_custkey % 3 = 0 then '/content/' || c_custkey when c_custkey % 2 = 0 then '/local/' || c_custkey when c_custkey % 5 = 0 then '/backup/' || c_custkey end feature, c_custkey % 3 <> 0 and (c_custkey % 2 = 0 or c_custkey % 5 = 0) mirrored from customer",
    "archive_manifest": """with k as (select case c_custkey % 5 when 0 then 'C:/lib/Projects/MyProjects/' when 1 then 'D:/x/projects/backup/' when 2 then '/lib/projects/defaultprojects/' else '/lib/PROJECTS/myprojects/' end || (c_custkey % 500) || '/' || case c_custkey % 3 when 0 then 'a.MP4' when 1 then 'b/c.webm' else 'preview.jpg' end p from customer),
r as (select regexp_extract(x, '(?i)(/projects/(?:myprojects|backup)/([0-9]+)/.+)$', 1) rel, regexp_extract(x, '(?i)(/projects/(?:myprojects|backup)/([0-9]+)/.+)$', 2) item_id from (select p x from k union all select upper(p) from k))
select item_id, min(rel) rel from r where item_id <> '' and regexp_matches(lower(rel), '[.](mp4|webm)$') group by item_id, lower(rel)""",
    "media_gaps": "select o_orderkey item_id from orders where o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_linenumber = o_orderkey % 5)",
    "union_ids": "select o_custkey item_id from orders union select user_id from events union select s_suppkey from supplier",
    "json_rows": f"""with f as ({RECORDS['folder_counts']}) select '{{"path":"' || path || '","n_items":' || n_items || ',"n_archived":' || n_archived || ',"n_alive":' || n_alive || ',"n_orphan":' || n_orphan || '}}' json from f""",
    "dual_export": f"""with k as ({MEDIA['keeper_order']}), g as (select *, dense_rank() over (order by group_id) seq from k)
select seq, rank, 'link' sheet, 'l/' || item_id as value from g union all select seq, rank, 'folder', 'f/' || item_id from g""",
    "run_rules": """with e as (select event_id k, props, event_id % 13 <> 0 and event_id % 3 = 0 done, event_id // 3 % 3 b, event_id // 9 % 3 a, event_id % 3 <> 0 d from events),
o as (select *, k % 17 = 0 nosession, k % 5 = 0 fast, k % 7 = 0 bad, k % 11 = 0 no, k % 2 = 0 last from e)
select k event_id, case when done then 'completed' else 'incomplete' end state, case when k % 4 <> 0 and done then 'w' else 'a' end log_mode, d keyed, d and k % 5 <> 0 rescued, true silent, to_json(props)::varchar as text, case when k % 2 = 0 then 'true' else 'false' end flag, cast(k as varchar) number,
case when nosession then false when fast then not bad and not no when b = 1 then true when bad or no then false when a = 1 then true when not last then false else a = 2 end success,
case when nosession or fast then false when b = 1 then true when bad or no then false else a = 1 end verified,
case when nosession then 'no_sessionid' when fast then case when bad then 'http_500' when no then 'bad_response' else 'fast' end when b = 1 then 'already_not_subscribed' when not bad and not no and a = 1 then null when not last then 'again' when bad then 'http_500' when no then 'bad_response' when a = 2 then 'verify_unknown' else 'still_subscribed' end reason from o""",
}
