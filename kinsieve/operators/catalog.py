"""Catalogue reconciliation: status classes, folder trees, alive and orphan partitions, completeness, overlays."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import key_id
from .scratch import written

# Endings of archived videos.
ARCHIVED = ("mp4", "webm", "mkv", "avi", "wmv", "mov", "m4v")


def item_reason(result: Column, banned: Column, ban_reason: Column, visibility: Column, title: Column) -> Column:
    """Why an item is delisted; null if it isn't. Missing values count as 0, 0, '', -1 and ''."""
    r, b, v = F.coalesce(result, F.lit(0)), F.coalesce(banned, F.lit(0)), F.coalesce(visibility, F.lit(-1))
    hidden = F.when(v == -1, "no_metadata").when(v == 1, "friends_only").when(v == 2, "private").otherwise(F.concat(F.lit("visibility_"), v.cast("string")))
    return (
        F.when(r != 1, F.when(r == 9, "not_found").otherwise(F.concat(F.lit("result_"), r.cast("string"))))
        .when((b != 0) | (F.coalesce(ban_reason, F.lit("")) != ""), "banned")
        .when(v != 0, hidden)
        .when(F.trim(F.coalesce(title, F.lit(""))) == "", "no_title")
    )


def delisted(requested: DataFrame, replies: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, reason) of requested items that are delisted or that no reply names; the first reply (least rank) of an item counts."""
    first = replies.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("rank"))).where("_n = 1")
    reason = item_reason(*(F.col(c) for c in ("result", "banned", "ban_reason", "visibility", "title")))
    named = requested.join(first, key, "left").withColumn("reason", F.when(F.col("_n").isNull(), "api_no_response").otherwise(reason))
    return named.where(F.col("reason").isNotNull()).select(key, "reason")


def require_complete(batches: DataFrame) -> DataFrame:
    """batches(ok); running the result fails if any batch did."""
    failed = batches.agg(F.count_if(~F.coalesce("ok", F.lit(False))).alias("n"))
    return failed.select(F.when(F.col("n") > 0, F.raise_error(F.lit("a batch of the status request failed"))).otherwise(F.lit("complete")).alias("state"))


def flattened(spark, tree: DataFrame, column: str = "tree", depth: int = 32) -> DataFrame:
    """(path, title, items) of every folder of JSON trees [{title, items: {key: n}, subfolders: [...]}], by a recursive query; fails if folders lie below the depth."""
    view = f"_folder_trees_{uuid.uuid4().hex}"  # two calls at once don't meet
    tree.select(F.parse_json(column).alias("tree")).createOrReplaceTempView(view)
    return spark.sql(
        f"""
        with recursive f(path, title, node, level) as (
          select variant_get(value, '$.title', 'string'), variant_get(value, '$.title', 'string'), value, 1 from {view}, lateral variant_explode(tree)
          union all
          select f.path || '/' || variant_get(s.value, '$.title', 'string'), variant_get(s.value, '$.title', 'string'), s.value, f.level + 1
          from f, lateral variant_explode_outer(variant_get(f.node, '$.subfolders', 'variant')) s where s.value is not null and f.level < {depth})
        select path, title, cast(variant_get(node, '$.items', 'map<string,int>') as map<string,int>) items from f
        where case when level = {depth} and variant_get(node, '$.subfolders[0]', 'variant') is not null then cast(raise_error('folders lie deeper than {depth} levels') as boolean) else true end
        """
    )


def profile_folders(configs: DataFrame, column: str = "config") -> DataFrame:
    """configs with folders: of the first profile, in the order of names, that has a list of folders, that list as JSON; null if none has.

    A profile is any object of the configuration; its browser's list goes before its general one.
    """
    parts = configs.sparkSession.tvf.variant_explode(F.col("_config").outer()).select("key", F.col("value").alias("_profile"))
    named = configs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_config", F.try_parse_json(column))
    named = written(named.select(*configs.columns, "_row", F.to_json("_config").alias("_text")))
    profiles = named.where("_text like '{%'").select("_row", F.parse_json("_text").alias("_config")).lateralJoin(parts).where("_profile is not null")
    # a list only counts as such
    found = lambda path: F.when(F.schema_of_variant(F.try_variant_get("_profile", path, "variant")).startswith("ARRAY"), F.to_json(F.try_variant_get("_profile", path, "variant")))
    lists = profiles.select("_row", "key", F.coalesce(found("$.general.browser.folders"), found("$.general.folders")).alias("folders")).where("folders is not null")
    first = lists.groupBy("_row").agg(F.min_by("folders", "key").alias("folders"))
    return named.join(first, "_row", "left").select(*configs.columns, "folders")


def folder_paths(folders: DataFrame, depth: int = 1000) -> DataFrame:
    """(folder_id, path) of folders(folder_id, parent_id, title) as rows, level by level until none is left; fails beyond the depth, so on cycles below a root."""
    level = written(folders.where("parent_id is null").select("folder_id", F.col("title").alias("path")))
    levels = [level]
    while True:
        below = folders.join(level.select(F.col("folder_id").alias("parent_id"), F.col("path").alias("_above")), "parent_id")
        level = written(below.select("folder_id", F.concat("_above", F.lit("/"), "title").alias("path")))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        if len(levels) >= depth:
            raise ValueError(f"folders lie deeper than {depth} levels")
        levels.append(level)


def item_rows(entries: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, item_id) of entries(folder_id, key) that name an item, each key of a folder once."""
    return entries.join(paths, "folder_id").select("folder_id", "path", "key").distinct().select("path", key_id(F.col("key")).alias("item_id")).where("item_id is not null")


def folder_ids(folders: DataFrame) -> DataFrame:
    """(path, item_id) of the folders' keys that name an item."""
    return folders.select("path", F.explode(F.map_keys(F.coalesce("items", F.expr("cast(map() as map<string,int>)")))).alias("key")).select("path", key_id(F.col("key")).alias("item_id")).where("item_id is not null")


def with_item(folders: DataFrame, key: str) -> DataFrame:
    """Every folder that holds a key."""
    return folders.where(F.array_contains(F.map_keys("items"), key))


def in_folders(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, path) of every folder of entries(path, key) that holds one of the keys; a key may lie in several."""
    return entries.join(keys.select("key").distinct(), "key", "left_semi").select("key", "path").distinct()


def alive_state(ids: DataFrame, alive: DataFrame, key: str = "item_id") -> DataFrame:
    """ids with state alive or orphan."""
    known = alive.select(key).distinct().withColumn("_alive", F.lit(True))
    return ids.join(known, key, "left").withColumn("state", F.when(F.col("_alive"), "alive").otherwise("orphan")).drop("_alive")


def folder_counts(ids: DataFrame, alive: DataFrame, archived: DataFrame, key: str = "item_id") -> DataFrame:
    there = archived.select(key).distinct().withColumn("_archived", F.lit(True))
    s = alive_state(ids, alive, key).join(there, key, "left")
    return s.groupBy("path").agg(F.count("*").alias("n_items"), F.count_if("_archived").alias("n_archived"), F.count_if(F.col("state") == "alive").alias("n_alive"), F.count_if(F.col("state") == "orphan").alias("n_orphan"))


def incomplete(source: DataFrame, target: DataFrame, item: str = "item_id") -> DataFrame:
    """Items with a source file that the target lacks or has in another size; more target files are allowed."""
    return source.select(item, "rel", "size").join(target.select(item, "rel", "size"), [item, "rel", "size"], "left_anti").select(item).distinct()


def archive_state(ids: DataFrame, alive: DataFrame, archive: DataFrame, gaps: DataFrame, key: str = "item_id") -> DataFrame:
    """ids as archived, incomplete, missing or orphan."""
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    s = ids.join(flag(alive, "_a"), key, "left").join(flag(archive, "_c"), key, "left").join(flag(gaps, "_g"), key, "left")
    state = F.when(F.col("_a").isNull(), "orphan").when(F.col("_c").isNull(), "missing").when(F.col("_g"), "incomplete").otherwise("archived")
    return s.withColumn("state", state).drop("_a", "_c", "_g")


def archive_plan(states: DataFrame, sources: DataFrame, key: str = "item_id") -> DataFrame:
    """What to do with each item: skip what is complete, warn where the source is gone, copy the rest. Nothing is copied here."""
    there = sources.select(key).distinct().withColumn("_s", F.lit(True))
    action = F.when(F.col("state") == "archived", "skip").when(F.col("_s").isNull(), "warn").otherwise("copy")
    return states.join(there, key, "left").withColumn("action", action).drop("_s")


def with_entries(entries: DataFrame, plan: DataFrame, folder: str, key: str = "item_id") -> DataFrame:
    """entries(folder_id, key) and, for each item that the plan copies or finds complete, its entry in the folder, unless it is there."""
    wanted = plan.where("action in ('copy', 'skip')").select(F.lit(folder).alias("folder_id"), F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    return entries.unionByName(wanted.join(entries.select("folder_id", "key"), ["folder_id", "key"], "left_anti"), allowMissingColumns=True)


def without_items(entries: DataFrame, gone: DataFrame, key: str = "item_id") -> DataFrame:
    """Folder entries whose item is not gone; entries that name no item stay."""
    return entries.join(gone.select(key).distinct(), key, "left_anti")


def unsubscribe_case(active: Column, orphan: Column) -> Column:
    return F.when((active == 0) & (orphan == 0), "none").when(active == 0, "orphan_only").otherwise(F.when(orphan > 0, "active_and_orphan").otherwise("active"))


def manifest(keys: DataFrame, key: str = "key") -> DataFrame:
    """(item_id, rel) of folder keys that name a video of an archived item; each path once, whatever its case."""
    path = F.replace(F.col(key), F.lit("\\"), F.lit("/"))
    part = lambda n: F.regexp_extract(path, r"(?i)(/projects/(?:myprojects|backup)/([0-9]+)/.+)$", n)
    found = keys.select(part(2).alias("item_id"), part(1).alias("rel")).where((F.col("item_id") != "") & F.lower(F.substring_index("rel", ".", -1)).isin(*ARCHIVED))
    return found.groupBy(F.lower("rel").alias("_rel")).agg(F.min(F.struct("rel", "item_id")).alias("_m")).select("_m.item_id", "_m.rel")


def media_gaps(projects: DataFrame, target: DataFrame, key: str = "item_id") -> DataFrame:
    """Items of projects (key, file) whose media file isn't among target (key, rel): none named, not there, or with a step upwards."""
    file = F.replace(F.col("file"), F.lit("\\"), F.lit("/"))
    named = projects.select(key, F.when(~F.array_contains(F.split(file, "/"), ".."), F.regexp_replace(file, r"^(\./)+", "")).alias("rel"))
    return named.join(target.select(key, "rel"), [key, "rel"], "left_anti").select(key).distinct()


def union_ids(*lists: DataFrame, key: str = "item_id") -> DataFrame:
    """Every id of the lists once."""
    return reduce(DataFrame.unionByName, (x.select(key) for x in lists)).distinct()


def safe_manifest(entries: DataFrame) -> DataFrame:
    """Entries (item_id, rel) with a numeric id, a known start, no step upwards; each path once, whatever its case."""
    ok = F.col("item_id").rlike("^[0-9]+$") & F.col("rel").rlike(r"^projects/(?:myprojects|backup)/[0-9]+/") & ~F.array_contains(F.split("rel", "/"), "..")
    first = Window.partitionBy(F.lower("rel")).orderBy("item_id", "rel")
    return entries.where(ok).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def overlaid(records: DataFrame, archives: DataFrame) -> DataFrame:
    """Records (id, file, project, filesize, status, type, ispreset) under their archive (id, file, project, size): current before backup, only those of size > 0, none on presets or in transfer."""
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.when(F.lower("file").contains("/projects/myprojects/"), 0).otherwise(1), "file"))
    best = archives.where("size > 0").withColumn("_n", rank).where("_n = 1").select("id", F.col("file").alias("_file"), F.col("project").alias("_project"), F.col("size").alias("_size"))
    use = F.col("_file").isNotNull() & ~F.coalesce("ispreset", F.lit(False)) & ~F.coalesce("status", F.lit("")).isin("pending", "downloading", "error")
    pick = lambda a, b: F.when(use, a).otherwise(b)
    joined = records.join(best, "id", "left")
    return joined.select(
        "id", pick(F.col("_file"), F.col("file")).alias("file"), pick(F.col("_project"), F.col("project")).alias("project"), pick(F.col("_size"), F.col("filesize")).alias("filesize"),
        pick(F.lit("installed"), F.col("status")).alias("status"), pick(F.lit("Video"), F.col("type")).alias("type"), use.alias("overlaid"),
    )


def first_mode(values: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """The most frequent value of each group, the first seen among equals."""
    n = values.groupBy(group, value).agg(F.count("*").alias("n"), F.min(position).alias("_at"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "_at", value))).where("_r = 1").select(group, value, "n")
