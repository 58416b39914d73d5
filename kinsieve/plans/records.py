"""Queries of the catalogue, text, store and queue operators on the provided tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import text as T
from ..operators import blocking, catalog, features, queue, store
from ..operators.scratch import shared_folder, written
from ..streaming import delta


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mode_extraction(spark, sf_dir):
    h = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(T.hrefs(F.col("html"))).alias("at", "href"))
    return catalog.first_mode(h, "page_id", "href", "at")


def url_params(spark, sf_dir):
    u = F.col("url")
    p = _t(spark, sf_dir, "pages").select("page_id", u)
    moved = T.set_query(u, "id", F.col("page_id").cast("string"))
    return p.select("page_id", T.url_id(u).alias("own_id"), moved.alias("moved"), T.url_id(moved).alias("moved_id"), T.set_fragment(u, "job", F.lit("7")).alias("flagged"), T.is_link(u).alias("is_link"))


def path_ids(spark, sf_dir):
    k, n = F.col("c_custkey").cast("string"), F.col("c_custkey") % 4
    path = F.when(n == 0, F.concat(F.lit("//host/lib/workshop/content/77/"), k, F.lit("/a.mp4"))).when(n == 1, F.concat(F.lit("C:\\x\\Projects\\MyProjects\\"), k, F.lit("\\b.mp4"))).when(n == 2, k).otherwise(F.concat(F.lit("/projects/backup/"), k, F.lit("/c.mp4")))
    c = _t(spark, sf_dir, "customer").select("c_custkey", path.alias("path"))
    p = F.col("path")
    return c.select("c_custkey", T.key_id(p).alias("item_id"), T.local_name(p).alias("local_name"), T.archive_id(F.lit(True), F.lit(""), p, p).alias("archive_id"), T.path_key(p).alias("path_key"), T.item_url(F.when(n == 1, F.concat(F.lit("mp:"), k)).otherwise(k), p, "https://items.example/?id=").alias("url"))


def twin_fallback(spark, sf_dir):
    """Every other event has a feature, under its own path or its twin's."""
    e = _t(spark, sf_dir, "events").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "/content/").otherwise("/local/projects/"), F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") / 2).cast("long").cast("string")).alias("path"), F.lit(1).alias("size"), "value")
    files = e.withColumn("twin_path", F.get(T.twin_paths(F.col("path"), "/content", "/local/projects"), F.lit(0)))
    features = e.where("event_id % 2 = 0").select("path", "size", F.col("value").alias("feature"))
    return store.with_twin(files.select("event_id", "path", "twin_path", "size"), features, "feature").select("event_id", "feature", "mirrored")


def cache_join(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    files = e.select("event_id", F.concat(F.lit("/f/"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") % 5).alias("size"), F.lit("v2").alias("cfg_hash"))
    features = e.select(F.concat(F.lit("/f/"), F.col("event_id").cast("string")).alias("path"), (F.col("event_id") % 3).alias("size"), F.when(F.col("event_type") == "view", "v1").otherwise("v2").alias("cfg_hash"), F.col("value").alias("feature"))
    return store.looked_up(files, features, "feature").select("event_id", "feature", F.col("feature").isNull().alias("to_compute"))


def delta_index(spark, sf_dir):
    """Events as updates of local videos, a batch for each remainder of the user, the second handed on twice, then compacted; and what its index holds."""
    e, item = _t(spark, sf_dir, "events"), (F.col("event_id") * 7 % 997).cast("string")
    place = F.when(F.col("event_id") % 3 == 0, "backup").otherwise("myprojects")
    status = F.when(F.col("event_type") == "error", "unsubscribed").when(F.col("event_type") == "signup", "pending").otherwise("installed")
    file = F.concat(F.lit("D:\\Projects\\"), place, F.lit("\\"), item, F.lit("\\V.mp4"))
    updates = e.select("user_id", F.col("event_id").alias("seq"), F.lit(None).cast("string").alias("workshopid"), F.lit(True).alias("local"), F.lit(None).cast("string").alias("project"), file.alias("file"), status.alias("status"), F.lit("Video").alias("type"))
    index = delta.DeltaIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    for batch in (0, 1, 1, 2):
        index.apply(delta.archive_changes(updates.where(F.col("user_id") % 3 == batch)), batch)
    index.compact()
    return index.entries().join(index.best().select("item_id", F.col("file").alias("best")), "item_id").select("item_id", "key", "file", "best")


def profile_search(spark, sf_dir):
    """Customers as configurations of two profiles, whose lists of folders lie in one of two places or are none."""
    k = F.col("c_custkey")
    part = lambda name, folders: F.concat(F.lit(f'"{name}":'), folders)
    titles = F.concat(F.lit('[{"title":"f'), k.cast("string"), F.lit('"}]'))
    browser = F.concat(F.lit("{"), part("browser", F.concat(F.lit("{"), part("folders", F.when(k % 3 == 0, titles).otherwise(F.lit("{}"))), F.lit("}"))), F.lit(","), part("folders", F.when(k % 5 == 0, F.lit("[]")).otherwise(F.lit("null"))), F.lit("}"))
    general = F.concat(F.lit("{"), part("folders", F.when(k % 7 == 0, F.lit("7")).otherwise(titles)), F.lit("}"))
    config = F.concat(F.lit('{"version":3,"p":{"general":'), browser, F.lit('},"q":{"general":'), general, F.lit("}}"))
    return catalog.profile_folders(_t(spark, sf_dir, "customer").select(k.alias("id"), config.alias("config"))).select("id", "folders")


def feature_merge(spark, sf_dir):
    """Customers as files: durations from finished orders, hashes from open ones, made anew with other settings for every third, then mirrored for every tenth."""
    kinds = {"duration": features.KINDS["duration"], "visual": "part string, visual_hash string"}
    table = features.FeatureTable(spark, f"{shared_folder(spark)}/features-{uuid.uuid4().hex}", kinds, 16)
    k, o = F.col("o_custkey"), _t(spark, sf_dir, "orders")
    about = [F.concat(F.lit("w/"), k.cast("string")).alias("path"), (k % 7).alias("size"), F.lit(0).cast("long").alias("mtime"), k.cast("string").alias("item_id"), F.lit(None).cast("string").alias("url"), F.col("o_orderkey").alias("updated")]
    table.merge("duration", o.where("o_orderstatus = 'F'").select(*about, F.col("o_totalprice").cast("double").alias("duration")))
    hashed = lambda status, setting: o.where(F.col("o_orderstatus") == status).select(*about, F.col("o_orderpriority").alias("part"), F.lit(setting).alias("visual_hash"))
    table.merge("visual", hashed("O", "v1"))
    table.merge("visual", hashed("O", "v2").where("cast(item_id as long) % 3 = 0"))
    twins = table.rows().where("cast(item_id as long) % 10 = 0").select(F.col("path").alias("source"), F.concat(F.lit("m/"), F.col("item_id")).alias("path"), "size", "mtime", F.concat(F.lit("mp:"), F.col("item_id")).alias("item_id"), "url", F.lit(-1).cast("long").alias("updated"))
    table.mirror(twins)
    known = table.looked_up(table.rows().select("path", "size", "item_id", "updated", F.col("duration").alias("secs")), "visual", "v2")
    return known.select("path", "item_id", "updated", "secs", F.col("part"), "known")


def feature_resume(spark, sf_dir):
    """Orders as files, finished ones first, then all, of which every fourth has grown; the lines of some can't be read while their size is odd."""
    table = features.FeatureTable(spark, f"{shared_folder(spark)}/features-{uuid.uuid4().hex}", {"lines": "quantity double, lines_hash string"}, 16)
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("item_id")).agg(F.sum(F.col("l_quantity").cast("double")).alias("quantity"), F.bool_or(F.col("l_returnflag") == "R").alias("odd"))
    lines = written(lines)  # every piece of every run reads them
    k = F.col("o_orderkey")

    def listed(run):
        about = [F.concat(F.lit("o/"), k.cast("string")).alias("path"), (k % 7 + F.when(k % 4 == 0, run).otherwise(0)).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"), k.cast("string").alias("item_id"), F.lit(None).cast("string").alias("url"), F.lit(run).cast("long").alias("updated")]
        return _t(spark, sf_dir, "orders").where(F.lit(run == 1) | (F.col("o_orderstatus") == "F")).select(*about)

    def compute(files):
        read = files.join(lines, "item_id", "left").withColumn("error", F.when(F.col("odd") & (F.col("size") % 2 == 1), "unreadable"))
        return read.withColumn("quantity", F.when(F.col("error").isNull(), F.col("quantity"))).drop("odd")

    for run in (0, 1):
        table.fill(listed(run), "lines", compute, "v1", pieces=2)
    return table.rows().select("path", "size", "updated", "quantity")


def manifest_check(spark, sf_dir):
    """Orders as entries of a manifest: some without a numeric id, outside the known folders, with a step upwards, or twice in another case."""
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 7
    item = F.when(n == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise((k / 2).cast("long").cast("string"))
    folder = F.when(n == 1, "projects/other/").when(k % 2 == 0, "projects/myprojects/").otherwise("projects/backup/")
    file = F.when(n == 2, "/../v.mp4").when(n == 3, "/V.MP4").otherwise("/v.mp4")
    entries = _t(spark, sf_dir, "orders").select(item.alias("item_id"), F.concat(folder, (k % 1000).cast("string"), file).alias("rel"))
    return catalog.safe_manifest(entries)


def folder_search(spark, sf_dir):
    """Nations and hundreds as folders of customers: every folder that holds the customer of a day's first order."""
    c = _t(spark, sf_dir, "customer").select(F.concat(F.lit("n/"), F.col("c_nationkey").cast("string")).alias("path"), F.col("c_custkey").cast("string").alias("key"))
    both = c.unionByName(c.select(F.concat(F.lit("h/"), (F.col("key").cast("long") / 100).cast("long").cast("string")).alias("path"), "key"))
    wanted = _t(spark, sf_dir, "orders").groupBy("o_orderdate").agg(F.min_by("o_custkey", "o_orderkey").cast("string").alias("key"))
    return catalog.in_folders(both, wanted.select("key").distinct())


def upsert_latest(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return store.upserted(e.where("value < 50"), e.where("value >= 50"), ["user_id", "event_type"], "event_id")


def classify_items(spark, sf_dir):
    """Customers as requested items; their orders as replies, the first of each counts."""
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    replies = o.select(F.col("o_custkey").alias("item_id"), k.alias("rank"), F.when(k % 11 == 0, 9).when(k % 13 == 0, 15).when(k % 17 == 0, F.lit(None)).otherwise(1).alias("result"), F.when(k % 7 == 0, 1).otherwise(0).alias("banned"), F.when(k % 19 == 0, "rule").alias("ban_reason"), F.when(k % 5 == 0, (k / 5 % 4).cast("int") - 1).otherwise(0).alias("visibility"), F.when(k % 3 == 0, "  ").otherwise(F.col("o_orderstatus")).alias("title"))
    return catalog.delisted(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id")), replies)


def alive_orphan(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), "c_nationkey")
    return catalog.alive_state(c, _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"))).groupBy("c_nationkey", "state").agg(F.count("*").alias("n"))


def folder_items(spark, sf_dir):
    """(path, item_id): regions as folders, nations as their subfolders, customers as entries of nations."""
    c, n, r = (_t(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    region, nation = (lambda k: F.concat(F.lit("r"), F.col(k).cast("string"))), (lambda k: F.concat(F.lit("n"), F.col(k).cast("string")))
    folders = r.select(region("r_regionkey").alias("folder_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    folders = folders.unionByName(n.select(nation("n_nationkey").alias("folder_id"), F.coalesce(region("n_regionkey"), F.lit("r?")).alias("parent_id"), F.col("n_name").alias("title")))
    return catalog.item_rows(c.select(nation("c_nationkey").alias("folder_id"), F.col("c_custkey").cast("string").alias("key")), catalog.folder_paths(folders))


def folder_counts(spark, sf_dir):
    ids = folder_items(spark, sf_dir)
    o = _t(spark, sf_dir, "orders")
    alive, archived = o.select(F.col("o_custkey").cast("string").alias("item_id")), o.where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("item_id"))
    return catalog.folder_counts(ids, alive, archived)


def completeness_check(spark, sf_dir):
    """Orders whose lines a copy lacks or holds in another size."""
    li = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("rel"), F.col("l_quantity").alias("size"), "l_shipdate")
    copy = li.select("item_id", "rel", F.when((F.col("item_id") + F.col("rel")) % 50 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return catalog.incomplete(li, copy)


def archive_states(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"))
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item_id"), "o_orderstatus", "o_orderkey")
    states = catalog.archive_state(c, o.where("o_orderkey % 2 = 0"), o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"))
    return catalog.archive_plan(states, o.where("o_orderstatus <> 'O'"))


def delta_filter(spark, sf_dir):
    """Each user's last event as the current record; all other events as updates."""
    e = _t(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by("props", "event_id").alias("props"), F.max("event_id").alias("_last"))
    ups = e.join(last.select("user_id", "_last"), "user_id").where("event_id < _last").groupBy("user_id").agg(F.max("event_id").alias("event_id")).join(e.select("event_id", "props", "event_type"), "event_id")
    updates = ups.select(F.col("event_id").alias("update_id"), F.col("user_id").alias("id"), "props", F.when(F.col("event_type") == "error", "error").otherwise("pending").alias("status"), F.lit(False).alias("local"), F.lit(False).alias("ispreset"))
    return store.changed_updates(updates, last.select(F.col("user_id").alias("id"), "props")).select("update_id", "id", "keep")


def delta_containment(spark, sf_dir):
    """Customers' records five levels deep against updates that repeat, shorten or change them."""
    k = F.col("c_custkey")
    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    record = text('{"a":{"b":[{"c":{"d":[', k % 3, ",", k % 5, ']}},"x"],"n":null},"e":', k, '.0,"f":{}}')
    update = text('{"a":{"b":[{"c":{"d":[', k % 3, F.when(k % 2 == 0, text(",", k % 7)).otherwise(""), F.when(k % 13 == 0, ',"y"').otherwise(""), "]}}]", F.when(k % 4 == 0, ',"n":null').otherwise(""), '},"e":', k + (k % 11 == 0).cast("int"), F.when(k % 17 == 0, ',"f":[]').otherwise(""), "}")
    c = _t(spark, sf_dir, "customer")
    updates = c.select(k.alias("update_id"), k.alias("id"), update.alias("props"), F.lit("pending").alias("status"), F.lit(False).alias("local"), F.lit(False).alias("ispreset"))
    return store.changed_updates(updates, c.select(k.alias("id"), record.alias("props"))).select("update_id", "keep")


def overlay_priority(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    k = F.col("p_partkey")
    records = p.select(k.alias("id"), F.concat(F.lit("/c/"), k.cast("string")).alias("file"), F.lit("p").alias("project"), F.col("p_size").cast("long").alias("filesize"), F.when(k % 7 == 0, "pending").otherwise("").alias("status"), F.col("p_type").alias("type"), (k % 11 == 0).alias("ispreset"))
    s = _t(spark, sf_dir, "supplier")
    n = F.col("s_suppkey")
    archives = s.select((n * 3 % 500).alias("id"), F.concat(F.when(n % 2 == 0, "/projects/myprojects/").otherwise("/projects/backup/"), n.cast("string")).alias("file"), F.lit("a").alias("project"), F.when(n % 5 == 0, 0).otherwise(n).cast("long").alias("size"))
    return catalog.overlaid(records, archives)


def _events(spark, sf_dir):
    """Each user an item; its events in order: odd ones lease, even ones acknowledge."""
    e = _t(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    reason = F.when(F.col("event_type") == "error", "http_503").when(F.col("event_type") == "signup", "http_429")
    return e.select(F.lit("j").alias("job"), F.col("user_id").alias("item_id"), at.alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 1, "lease").otherwise("ack").alias("kind"), reason.isNull().alias("ok"), reason.alias("reason"), F.lit(None).cast("string").alias("token"))


def queue_fold(spark, sf_dir):
    return queue.folded(_events(spark, sf_dir), ["job", "item_id"], lease=1e9).select("item_id", "status", F.col("attempts").cast("long").alias("attempts"), "error")


def _tasks(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = F.col("event_id")
    status = F.when(k % 5 < 2, "queued").when(k % 5 == 2, "inflight").when(k % 5 == 3, "success").otherwise("failed")
    return e.select(F.concat(F.lit("j"), (F.col("user_id") % 3).cast("string")).alias("job"), k.alias("item_id"), k.alias("position"), status.alias("status"), (k % 4).cast("int").alias("attempts"), (k % 1000).cast("double").alias("next_ts"))


def queue_stats(spark, sf_dir):
    return queue.stats(_tasks(spark, sf_dir), 500.0)


def lease_batch(spark, sf_dir):
    """A lease of 200 tasks, the feature being its size."""
    return queue.leased(_tasks(spark, sf_dir), 500.0, 200).select("job", "item_id", "status", "attempts", "next_ts", "token")


def lease_expiry(spark, sf_dir):
    return queue.expired(_tasks(spark, sf_dir), 500.0).groupBy("job", "status").agg(F.count("*").alias("n"))


def backoff(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    n = (F.col("event_id") % 9 + 1).cast("int")
    reason = F.when(F.col("event_type") == "signup", "http_429").otherwise("timeout")
    return e.select("event_id", N.backoff(n, 5.0, reason).alias("wait"), T.status_ok(F.lit(None).cast("boolean"), F.col("event_type")).alias("ok"), N.format_bytes(F.col("value") * 100000).alias("size"), N.lenient_int(F.col("event_type"), 4).alias("number"))


def scheduler_pick(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    k = F.col("event_id")
    items = e.select("user_id", k.alias("item_id"), k.alias("position"), (k % 16).cast("int").alias("state"), F.when(F.col("event_type") == "error", 900.0).otherwise(0.0).alias("retry_at"))
    return queue.scheduled(items, 500.0, "user_id")


def page_state(spark, sf_dir):
    p = _t(spark, sf_dir, "pages")
    body = F.regexp_replace("html", "<[^>]*>", " ")
    return p.select("page_id", T.subscription_state(F.col("html")).alias("state"), T.is_gone(F.regexp_extract("html", "<title>([^<]*)", 1), body, F.lit(False), F.col("html")).alias("gone"))


def id_extraction(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.ids_in_text(F.col("text")), ",").alias("ids"), T.response_ok(F.col("text")).alias("is_ok"))


def job_identity(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    # ids once each before they meet in one row
    return e.select("event_type", F.col("user_id").cast("string").alias("user_id")).distinct().groupBy("event_type").agg(T.job_id(F.collect_list("user_id")).alias("job"))


def request_batches(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item_id"))
    return blocking.batches(c, "item_id").groupBy("batch").agg(F.count("*").alias("n"), F.min(F.col("item_id").cast("long")).alias("first_id"))


QUERIES = {f.__name__: f for f in (
    mode_extraction, url_params, path_ids, twin_fallback, cache_join, upsert_latest, feature_merge, feature_resume, manifest_check, folder_search, delta_index, profile_search, classify_items, alive_orphan, folder_counts, completeness_check, archive_states,
    delta_filter, delta_containment, overlay_priority, queue_fold, queue_stats, lease_batch, lease_expiry, backoff, scheduler_pick, page_state, id_extraction, job_identity, request_batches,
)}

_GONE = " or ".join(f"contains(low, '{p}')" for p in T.GONE)
_TASKS = "t as (select 'j' || (user_id % 3) job, event_id item_id, event_id position, case when event_id % 5 < 2 then 'queued' when event_id % 5 = 2 then 'inflight' when event_id % 5 = 3 then 'success' else 'failed' end status, cast(event_id % 4 as integer) attempts, cast(event_id % 1000 as double) next_ts from events)"

ORACLE = {
    "mode_extraction": "with h as (select page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1)) href, generate_subscripts(regexp_extract_all(html, '(?i)href=\"([^\"]+)\"', 1), 1) k from pages), g as (select page_id, href, count(*) n, min(k) k from h group by 1, 2) select page_id, href, n from g qualify row_number() over (partition by page_id order by n desc, k, href) = 1",
    "url_params": """with u as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) base, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) q, regexp_extract(url, '#(.*)$', 1) fr, regexp_extract(url, '(#.*)$', 1) rest, regexp_extract(url, '^([^#]*)', 1) nofr from pages),
p as (select *, list_filter(string_split(q, '&'), lambda x: contains(x, '=') and not ends_with(x, '=') and not starts_with(x, 'id=')) kept, list_filter(string_split(fr, '&'), lambda x: contains(x, '=') and not ends_with(x, '=') and not starts_with(x, 'job=')) fkept from u)
select page_id, trim(regexp_extract(url, '^[^?#]*\\?(?:[^#]*?&)?id=([^&#]*)', 1)) own_id, base || '?' || array_to_string(list_append(kept, 'id=' || page_id), '&') || rest moved, cast(page_id as varchar) moved_id, nofr || '#' || array_to_string(list_append(fkept, 'job=7'), '&') flagged, starts_with(url, 'http') is_link from p""",
    "path_ids": """with c as (select c_custkey, case c_custkey % 4 when 0 then '//host/lib/workshop/content/77/' || c_custkey || '/a.mp4' when 1 then 'C:\\x\\Projects\\MyProjects\\' || c_custkey || '\\b.mp4' when 2 then cast(c_custkey as varchar) else '/projects/backup/' || c_custkey || '/c.mp4' end path from customer)
select c_custkey, case when c_custkey % 4 in (0, 2) then cast(c_custkey as varchar) end item_id, case when c_custkey % 4 = 1 then cast(c_custkey as varchar) end local_name, case when c_custkey % 4 in (1, 3) then cast(c_custkey as varchar) end archive_id, lower(replace(path, '\\', '/')) path_key, case when c_custkey % 4 = 1 then 'file://' || path else 'https://items.example/?id=' || c_custkey end url from c""",
    "twin_fallback": "select a.event_id, coalesce(case when a.event_id % 2 = 0 then a.value end, b.value) feature, a.event_id % 2 = 1 and b.value is not null mirrored from events a left join events b on a.event_id % 2 = 1 and b.event_id = a.event_id - 1 and b.user_id = a.user_id",
    "cache_join": "select event_id, case when event_id % 5 = event_id % 3 and event_type <> 'view' then value end feature, not (event_id % 5 = event_id % 3 and event_type <> 'view') to_compute from events",
    "delta_index": r"""with u as (select event_id seq, user_id % 3 b, cast(event_id * 7 % 997 as varchar) item_id, case when event_id % 3 = 0 then 'backup' else 'myprojects' end place, event_type from events where event_type <> 'signup'),
n as (select *, 'D:\Projects\' || place || '\' || item_id || '\V.mp4' file from u),
l as (select * from n qualify row_number() over (partition by item_id, place order by b desc, seq desc) = 1),
h as (select item_id, lower(replace(file, '\', '/')) key, file from l where event_type <> 'error')
select h.item_id, key, file, (select min_by(x.file, (case when contains(x.key, '/projects/myprojects/') then 0 else 1 end) || x.key) from h x where x.item_id = h.item_id) best from h""",
    "profile_search": """select c_custkey id, case when c_custkey % 3 = 0 then '[{"title":"f' || c_custkey || '"}]' when c_custkey % 5 = 0 then '[]' when c_custkey % 7 = 0 then null else '[{"title":"f' || c_custkey || '"}]' end folders from customer""",
    "delta_containment": """with c as (select c_custkey k from customer),
t as (select k, '{"a":{"b":[{"c":{"d":[' || k % 3 || ',' || k % 5 || ']}},"x"],"n":null},"e":' || k || '.0,"f":{}}' record,
  '{"a":{"b":[{"c":{"d":[' || k % 3 || case when k % 2 = 0 then ',' || k % 7 else '' end || case when k % 13 = 0 then ',"y"' else '' end || ']}}]' || case when k % 4 = 0 then ',"n":null' else '' end || '},"e":' || k + case when k % 11 = 0 then 1 else 0 end || case when k % 17 = 0 then ',"f":[]' else '' end || '}' upd from c),
r as (select k, fullkey, case when type in ('OBJECT', 'ARRAY', 'NULL') then type when type in ('VARCHAR', 'BOOLEAN') then type || atom else 'n' || cast(atom as double) end value from t, json_tree(t.record)),
u as (select k, fullkey, case when type in ('OBJECT', 'ARRAY', 'NULL') then type when type in ('VARCHAR', 'BOOLEAN') then type || atom else 'n' || cast(atom as double) end value from t, json_tree(t.upd)),
n as (select distinct k from (select k, fullkey, value from u except select k, fullkey, value from r))
select k update_id, k in (select k from n) keep from c""",
    "feature_merge": """with d as (select o_custkey k, arg_max(o_totalprice, o_orderkey) secs, max(o_orderkey) u from orders where o_orderstatus = 'F' group by 1),
v as (select o_custkey k, arg_max(o_orderpriority, o_orderkey) part, max(o_orderkey) u from orders where o_orderstatus = 'O' group by 1),
b as (select k, coalesce(v.u, d.u) updated, cast(secs as double) secs, case when k % 3 = 0 then part end part, k % 3 = 0 and v.u is not null known from d full join v using (k))
select 'w/' || k path, cast(k as varchar) item_id, updated, secs, part, known from b union all select 'm/' || k, 'mp:' || k, -1, secs, part, known from b where k % 10 = 0""",
    "feature_resume": """with l as (select l_orderkey k, sum(l_quantity) q, bool_or(l_returnflag = 'R') r from lineitem group by 1),
o as (select o_orderkey k, o_orderstatus = 'F' and not (coalesce(r, false) and o_orderkey % 7 % 2 = 1) stored, o_orderkey % 7 s0, o_orderkey % 7 + case when o_orderkey % 4 = 0 then 1 else 0 end s1, q, coalesce(r, false) r from orders left join l on l.k = o_orderkey),
f as (select *, (not stored or s0 <> s1) and not (r and s1 % 2 = 1) again from o)
select 'o/' || k path, case when again then s1 else s0 end size, case when again then 1 else 0 end updated, cast(q as double) quantity from f where again or stored""",
    "manifest_check": """with e as (select case when o_orderkey % 7 = 0 then 'x' || o_orderkey else cast(o_orderkey // 2 as varchar) end item_id,
case when o_orderkey % 7 = 1 then 'projects/other/' when o_orderkey % 2 = 0 then 'projects/myprojects/' else 'projects/backup/' end || (o_orderkey % 1000) || case o_orderkey % 7 when 2 then '/../v.mp4' when 3 then '/V.MP4' else '/v.mp4' end rel from orders)
select item_id, rel from e where item_id not like 'x%' and rel not like 'projects/other/%' and not contains(rel, '/../')
qualify row_number() over (partition by lower(rel) order by item_id, rel) = 1""",
    "folder_search": """with c as (select 'n/' || c_nationkey path, c_custkey k from customer union all select 'h/' || (c_custkey // 100), c_custkey from customer),
w as (select distinct arg_min(o_custkey, o_orderkey) k from orders group by o_orderdate)
select distinct cast(k as varchar) as key, path from c join w using (k)""",
    "upsert_latest": "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
    "classify_items": """with r as (select o_custkey item_id, o_orderkey k, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderkey) = 1),
x as (select c_custkey item_id, k, case when k % 11 = 0 then 9 when k % 13 = 0 then 15 when k % 17 = 0 then 0 else 1 end res, k % 7 = 0 or k % 19 = 0 ban, case when k % 5 = 0 then (k // 5) % 4 - 1 else 0 end vis, case when k % 3 = 0 then '' else o_orderstatus end title from customer left join r on c_custkey = item_id),
y as (select item_id, case when k is null then 'api_no_response' when res = 9 then 'not_found' when res <> 1 then 'result_' || res when ban then 'banned' when vis = -1 then 'no_metadata' when vis = 1 then 'friends_only' when vis = 2 then 'private' when vis <> 0 then 'visibility_' || vis when title = '' then 'no_title' end reason from x)
select item_id, reason from y where reason is not null""",
    "alive_orphan": "select c_nationkey, case when c_custkey in (select o_custkey from orders) then 'alive' else 'orphan' end state, count(*) n from customer group by 1, 2",
    "folder_counts": "select r_name || '/' || n_name path, count(*) n_items, count(case when c_custkey in (select o_custkey from orders where o_orderstatus = 'F') then 1 end) n_archived, count(case when c_custkey in (select o_custkey from orders) then 1 end) n_alive, count(case when c_custkey not in (select o_custkey from orders) then 1 end) n_orphan from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1",
    "completeness_check": "with c as (select l_orderkey k, l_linenumber r, case when (l_orderkey + l_linenumber) % 50 = 0 then l_quantity + 1 else l_quantity end s from lineitem) select distinct l_orderkey item_id from lineitem where not exists (select 1 from c where k = l_orderkey and r = l_linenumber and s = l_quantity)",
    "archive_states": """with s as (select c_custkey item_id, case when c_custkey not in (select o_custkey from orders where o_orderkey % 2 = 0) then 'orphan' when c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') then 'missing' when c_custkey in (select o_custkey from orders where o_orderstatus = 'P') then 'incomplete' else 'archived' end state from customer)
select item_id, state, case when state = 'archived' then 'skip' when item_id not in (select o_custkey from orders where o_orderstatus <> 'O') then 'warn' else 'copy' end action from s""",
    "delta_filter": """with l as (select user_id, max(event_id) last from events group by 1), u as (select e.user_id, max(e.event_id) id from events e join l using (user_id) where e.event_id < last group by 1)
select u.id update_id, u.user_id id, not ((select count(*) from u) >= 50 and x.event_type <> 'error' and x.props = y.props) keep from u join events x on x.event_id = u.id join l on l.user_id = u.user_id join events y on y.event_id = l.last""",
    "overlay_priority": """with a as (select s_suppkey * 3 % 500 id, case when s_suppkey % 2 = 0 then '/projects/myprojects/' else '/projects/backup/' end || s_suppkey file, s_suppkey size from supplier where s_suppkey % 5 <> 0 and s_suppkey > 0 qualify row_number() over (partition by s_suppkey * 3 % 500 order by s_suppkey % 2, file) = 1),
r as (select p_partkey id, '/c/' || p_partkey file, cast(p_size as bigint) filesize, case when p_partkey % 7 = 0 then 'pending' else '' end status, p_type, a.file af, a.size, a.file is not null and p_partkey % 11 <> 0 and p_partkey % 7 <> 0 use from part left join a on a.id = p_partkey)
select id, case when use then af else file end file, case when use then 'a' else 'p' end project, case when use then size else filesize end filesize, case when use then 'installed' else status end status, case when use then 'Video' else p_type end type, use overlaid from r""",
    "queue_stats": f"with {_TASKS}, e as (select job, attempts, case when status = 'inflight' and next_ts <= 500 then case when attempts >= 3 then 'failed' else 'queued' end else status end status, case when status = 'inflight' and next_ts <= 500 then 505.0 else next_ts end next_ts from t) select job, count(case when status = 'queued' then 1 end) \"left\", count(case when status = 'inflight' then 1 end) pending, count(case when attempts > 0 then 1 end) assigned, count(case when status in ('success', 'failed') then 1 end) done, count(case when status = 'success' then 1 end) ok, count(case when status = 'failed' then 1 end) fail, count(*) total, cast(sum(attempts) as bigint) attempts, greatest(250, least(5000, cast(trunc((greatest(0.0, coalesce(min(case when status in ('queued', 'inflight') then next_ts end), 500.0)) - 500.0) * 1000) as bigint))) retry_after_ms from e group by 1",
    "lease_batch": f"with {_TASKS} select job, item_id, 'inflight' status, attempts + 1 attempts, cast(590 as double) next_ts, sha1(job || ':' || item_id || ':' || (attempts + 1)) token from t where status = 'queued' and next_ts <= 500 qualify row_number() over (partition by job order by attempts, position, item_id) <= 200",
    "lease_expiry": f"with {_TASKS} select job, case when status = 'inflight' and next_ts <= 500 then case when attempts >= 3 then 'failed' else 'queued' end else status end status, count(*) n from t group by 1, 2",
    "backoff": "select event_id, case when event_type = 'signup' then greatest(least(120.0, 5.0 * pow(2, event_id % 9)), least(120.0, 10.0 * pow(2, event_id % 9))) else least(120.0, 5.0 * pow(2, event_id % 9)) end wait, event_type <> 'error' ok, case when value * 100000 < 1024 then printf('%.1f B', value * 100000) when value * 100000 < 1048576 then printf('%.1f KB', value * 100000 / 1024) else printf('%.1f MB', value * 100000 / 1048576) end size, cast(4 as bigint) number from events",
    "scheduler_pick": "with i as (select user_id, event_id, event_id % 16 s, case when event_type = 'error' then 900.0 else 0 end r from events) select user_id, count(case when r > 500 then 1 end) n_deferred, min(case when s & 1 <> 0 and s & 2 = 0 and r <= 500 and (s & 8 <> 0 or s & 4 = 0) then event_id end) item_id from i group by 1",
    "page_state": f"with b as (select page_id, html, lower(regexp_replace(html, '<[^>]*>', ' ', 'g')) low, lower(regexp_extract(html, '<title>([^<]*)', 1)) title from pages) select page_id, case when regexp_matches(html, '{T.CAN_REMOVE}') and not regexp_matches(html, '{T.CAN_ADD}') then 'subscribed' when regexp_matches(html, '{T.CAN_ADD}') and not regexp_matches(html, '{T.CAN_REMOVE}') then 'not_subscribed' else 'unknown' end state, regexp_matches(title, '错误|error') or {_GONE} or (length(low) between 1 and 199 and regexp_matches(low, 'error|错误|not\\s*found|removed')) or regexp_matches(html, '{T.ERROR_BOX.replace(chr(39), chr(39) * 2)}') gone from b",
    "id_extraction": "with m as (select doc_id, regexp_extract_all(text, '[0-9]+') x, text from documents) select doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ',') ids, trim(text) in ('1', 'true') is_ok from m",
    "job_identity": "select event_type, sha256('[\"' || array_to_string(list_sort(list_distinct(list(cast(user_id as varchar)))), '\",\"') || '\"]') job from events group by 1",
    "request_batches": "with r as (select c_custkey, (row_number() over (order by c_custkey) - 1) // 80 batch from customer) select batch, count(*) n, min(c_custkey) first_id from r group by 1",
}
