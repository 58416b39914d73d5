"""Queries of the rules around runs, archives and requests on the provided tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import archive, blocking, catalog, groups, queue, store
from .records import ORACLE as RECORDS
from .records import _t, archive_states, classify_items


def value_rules(spark, sf_dir):
    """Scalar rules: worker clamp, duration of streams, exit code, supervisor state, liveness, kind of removal."""
    k, v, bad = F.col("event_id"), F.col("value"), F.col("event_type") == "error"
    return _t(spark, sf_dir, "events").select(
        "event_id", N.workers(F.when(F.col("event_type") != "view", F.col("user_id") % 20)).alias("workers"),
        N.container_duration(F.when(k % 3 == 0, v).otherwise(-1.0), F.array(v, v * 2, F.lit(None), F.lit(float("nan")))).alias("duration"),
        queue.outcome(k % 2, k % 3, k % 5 % 3, k % 4, bad).alias("exit_code"), queue.supervisor(k % 2 == 0, k % 3 == 0, k % 11 == 0, k % 5 == 0, k % 7 == 0, bad).alias("state"),
        queue.liveness(F.when(k % 4 == 0, 404).when(k % 4 == 1, 200).otherwise(500), k % 13 == 0).alias("session"), catalog.unsubscribe_case(k % 2, k % 3).alias("removal"),
    )


def path_rules(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    uri = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("file:///a%20b/"), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("FILE://host/x+y/"), k)).otherwise(F.concat(F.lit("/plain/"), k))
    pairs = T.pair_list(F.array(F.concat(k, F.lit("|5")), F.concat(F.lit("5 , "), k), F.concat(k, F.lit("|"), k), F.lit("x|")))
    return _t(spark, sf_dir, "customer").select(
        "c_custkey", T.file_uri_path(uri).alias("path"), T.joined_path(F.lit("/f/"), F.concat(F.lit("/"), k)).alias("joined"), F.array_join(F.transform(pairs, lambda p: F.array_join(p, "|")), ";").alias("pairs")
    )


def best_files(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").cast("string").alias("path"), F.col("l_quantity").cast("double").alias("size"))
    return groups.best_files(li)


def insert_absent(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("item_id"), F.lit("old").alias("state"))
    return store.inserted_first(old, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), F.lit("new").alias("state")), ["item_id"])


def prune_features(spark, sf_dir):
    """Events as features of their user's file; files of every other customer exist."""
    path = lambda k: F.concat(F.lit("/f/"), F.col(k).cast("string")).alias("path")
    return store.pruned(_t(spark, sf_dir, "events").select(path("user_id"), "event_id"), _t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(path("c_custkey")))


def signature_states(spark, sf_dir):
    """Error tags of signatures, and which of them may be compared, with audio required and without."""
    k = F.col("event_id")
    files = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", "1.0").alias("bucket"), F.when(k % 3 != 0, k).alias("hashes"), F.when(k % 5 != 0, k).alias("audio"))
    tags = lambda both: F.array_join(archive.signature_errors(F.col("bucket"), F.col("hashes"), F.col("audio"), both), ",")
    fit = lambda both, name: archive.eligible_signatures(files, both).select("event_id", F.lit(True).alias(name))
    tagged = files.select("event_id", tags(False).alias("errors"), tags(True).alias("errors_both"))
    return tagged.join(fit(False, "fit"), "event_id", "left").join(fit(True, "fit_both"), "event_id", "left").fillna(False, ["fit", "fit_both"])


def _protected(spark, sf_dir):
    s, c = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "customer")
    folder = lambda k, root: F.concat(F.lit(root), F.col(k).cast("string"), F.lit("/a.mp4")).alias("file")
    archives = s.select(F.col("s_suppkey").alias("id"), folder("s_suppkey", "C:\\Projects\\MyProjects\\"), (F.col("s_suppkey") % 3 != 0).alias("verified"))
    k = F.col("c_custkey")
    visible = c.select(k.alias("id"), folder("c_custkey", "c:/projects/myprojects/"), F.when(k % 5 == 0, "pending").otherwise("installed").alias("status"), (k % 2 == 0).alias("overlaid"))
    return archive.protected(archives, visible)


def protected_requests(spark, sf_dir):
    """Orders of protected customers are no requests."""
    return archive.unprotected_requests(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("id")), _protected(spark, sf_dir)).select("req_id", "id")


def path_redirect(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    path = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.lit("/elsewhere/"), k)).otherwise(F.concat(F.lit("/lib/workshop/content/77/"), k, F.lit("/v.mp4")))
    return archive.redirected(_t(spark, sf_dir, "customer").select("c_custkey", path.alias("path")), _protected(spark, sf_dir))


def outside_visible(spark, sf_dir):
    """Each user's events a batch; items of low numbers are visible."""
    k = F.col("event_id")
    status = F.when(k % 97 == 0, "broken").otherwise("pending")
    updates = _t(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), (k % 3001).alias("id"), status.alias("status"), (k % 89 == 0).alias("local"), F.lit(None).cast("boolean").alias("ispreset"))
    return archive.outside_visible(updates, _t(spark, sf_dir, "customer").where("c_custkey < 20").select(F.col("c_custkey").alias("id")))


def delete_plan(spark, sf_dir):
    k = F.col("o_custkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("C:\\p\\MyProjects\\"), k.cast("string"), F.lit("\\"))).when(k % 4 == 1, "/p/myprojects").when(k % 4 == 2, F.concat(F.lit("/p/myprojects/"), k.cast("string"), F.lit("/x"))).otherwise(F.concat(F.lit("/q/"), k.cast("string")))
    return archive.delete_plan(_t(spark, sf_dir, "orders").select(path.alias("path")))


def archive_counters(spark, sf_dir):
    """Counters of an archive run over each nation's customers."""
    k = F.col("item_id")
    plan = archive_states(spark, sf_dir).join(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), "c_nationkey"), "item_id")
    return archive.run_counters(plan.withColumn("failed", k % 9 == 0).withColumn("added", k % 2 == 0), "c_nationkey")


def detection_totals(spark, sf_dir):
    return archive.detection_totals(classify_items(spark, sf_dir))


def folder_runs(spark, sf_dir):
    """Each nation a run over its customers as folders, and the stage after it."""
    k = F.col("c_custkey")
    ran = archive.folder_runs(_t(spark, sf_dir, "customer").select("c_nationkey", (k % 4).alias("alive"), F.when(k % 29 == 0, 1).otherwise(0).alias("rc")), "c_nationkey")
    after = lambda name, done: archive.next_stage(F.lit(name), F.lit("archive"), done)
    return ran.withColumn("stage", after("folder", F.when(F.col("advance"), "archive"))).withColumn("delisted_stage", after("delisted", F.when(F.col("c_nationkey") % 2 == 0, "archive").otherwise("unsub")))


def request_completion(spark, sf_dir):
    e, c = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "customer")
    ids = e.select(F.col("user_id").alias("req_id"), (F.col("event_id") % 500).cast("string").alias("item_id"), F.col("event_id").alias("position"))
    return queue.requests(ids, c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("item_id"), (F.col("c_custkey") % 5 != 0).alias("ok")))


def cleanup_plan(spark, sf_dir):
    """Folder entries that stay once the customers with a lost order are gone."""
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("item_id"))
    return catalog.without_items(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), "c_nationkey"), gone)


def queue_positions(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey")
    return blocking.numbered(c, F.col("c_mktsegment"), F.col("c_custkey"), into="position").select("c_custkey", "position")


QUERIES = {f.__name__: f for f in (
    value_rules, path_rules, best_files, insert_absent, prune_features, signature_states, protected_requests, path_redirect, outside_visible, delete_plan, archive_counters,
    detection_totals, folder_runs, request_completion, cleanup_plan, queue_positions,
)}

_SAFE = "sa as (select s_suppkey id from supplier join customer on c_custkey = s_suppkey where s_suppkey % 3 <> 0 and c_custkey % 5 <> 0 and c_custkey % 2 = 0)"

ORACLE = {
    "value_rules": """select event_id, cast(greatest(1, least(16, coalesce(case when event_type <> 'view' then user_id % 20 end, 8))) as integer) workers, case when value > 0 then case when event_id % 3 = 0 then value else value * 2 end end duration,
cast(case when event_id % 2 = 0 and event_id % 3 = event_id % 5 % 3 and event_id % 5 % 3 > 0 then case when event_id % 4 > 0 then 1 else 0 end when event_type = 'error' then 2 end as integer) exit_code,
case when event_type = 'error' then 'error' when event_id % 11 = 0 or event_id % 2 <> 0 then 'stopped' when event_id % 3 = 0 then 'paused' when event_id % 5 = 0 then 'yielding' when event_id % 7 = 0 then 'downloads_paused' else 'active' end state,
case when event_id % 4 = 0 or event_id % 13 = 0 then 'stop' when event_id % 4 = 1 then 'live' else 'offline' end session,
case when event_id % 2 = 0 then case when event_id % 3 = 0 then 'none' else 'orphan_only' end when event_id % 3 > 0 then 'active_and_orphan' else 'active' end removal from events""",
    "path_rules": """with c as (select c_custkey, cast(c_custkey as varchar) k from customer) select c_custkey, case c_custkey % 3 when 0 then '/a b/' || k when 1 then '//host/x+y/' || k end path, '/f/' || k joined, case when k = '5' then '' else least(k, '5') || '|' || greatest(k, '5') end pairs from c""",
    "best_files": "select l_orderkey item_id, cast(l_linenumber as varchar) path, cast(l_quantity as double) size from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, cast(l_linenumber as varchar)) = 1",
    "insert_absent": "select c_custkey item_id, 'old' state from customer where c_custkey % 3 = 0 union all select distinct o_custkey, 'new' from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0)",
    "prune_features": "select '/f/' || user_id path, event_id from events where user_id in (select c_custkey from customer where c_custkey % 2 = 0)",
    "signature_states": """with f as (select event_id, event_type <> 'view' and event_id % 3 <> 0 v, event_id % 5 <> 0 a from events)
select event_id, case when v then '' else 'no_visual_signature' end errors, case when v and a then '' else 'incomplete_signature' end errors_both, v fit, v and a fit_both from f""",
    "protected_requests": f"with {_SAFE} select o_orderkey req_id, o_custkey id from orders where o_custkey not in (select id from sa)",
    "path_redirect": f"""with {_SAFE}, p as (select c_custkey, case when c_custkey % 7 = 0 then '/elsewhere/' || c_custkey else '/lib/workshop/content/77/' || c_custkey || '/v.mp4' end path from customer)
select c_custkey, path, case when c_custkey % 7 <> 0 and c_custkey in (select id from sa) then 'C:\\Projects\\MyProjects\\' || c_custkey || '/a.mp4' else path end target from p""",
    "outside_visible": "select user_id batch, bool_and(event_id % 97 <> 0 and event_id % 89 <> 0 and event_id % 3001 not in (select c_custkey from customer where c_custkey < 20)) outside from events group by 1",
    "delete_plan": "select distinct case o_custkey % 4 when 0 then 'C:/p/MyProjects/' || o_custkey when 1 then '/p/myprojects' when 2 then '/p/myprojects/' || o_custkey || '/x' else '/q/' || o_custkey end path, case o_custkey % 4 when 0 then 'delete' when 3 then 'skip_outside' else 'skip_depth' end action from orders",
    "archive_counters": """with s as (select c_custkey k, c_nationkey, case when c_custkey in (select o_custkey from orders where o_orderkey % 2 = 0) and c_custkey in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select o_custkey from orders where o_orderstatus = 'P') then 'skip' when c_custkey not in (select o_custkey from orders where o_orderstatus <> 'O') then 'warn' else 'copy' end a from customer)
select c_nationkey, count(case when a = 'copy' and k % 9 <> 0 then 1 end) copied, count(case when a = 'copy' and k % 9 <> 0 and k % 2 = 0 then 1 end) added, count(case when a = 'skip' then 1 end) skipped_already, count(case when a = 'warn' then 1 end) skipped_missing, count(case when a = 'copy' and k % 9 = 0 then 1 end) failed from s group by 1""",
    "detection_totals": f"with de as ({RECORDS['classify_items']}) select reason, count(*) n from de group by rollup (reason)",
    "folder_runs": """with f as (select c_nationkey, count(*) planned, count(case when c_custkey % 29 <> 0 then 1 end) succeeded from customer where c_custkey % 4 > 0 group by 1)
select *, planned = succeeded advance, case when planned = succeeded then 'unsub' else 'archive' end stage, case when c_nationkey % 2 = 0 then 'unsub' else 'archive' end delisted_stage from f""",
    "request_completion": """with i as (select user_id req_id, cast(event_id % 500 as varchar) item_id, event_id p from events), n as (select req_id, item_id from i qualify row_number() over (partition by item_id order by p, req_id) = 1)
select r.req_id, count(case when c_custkey % 5 <> 0 then 1 end) ok, count(case when c_custkey % 5 = 0 then 1 end) fail from (select distinct req_id from i) r left join n on n.req_id = r.req_id left join customer on cast(c_custkey as varchar) = n.item_id and c_custkey % 3 <> 0 group by 1 having count(case when n.item_id is not null and c_custkey is null then 1 end) = 0""",
    "cleanup_plan": "select c_custkey item_id, c_nationkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')",
    "queue_positions": "select c_custkey, row_number() over (order by c_mktsegment, c_custkey) - 1 as position from customer",
}
