"""Incremental feature tables: latest row of a key, lookups, twins, deletion; partial updates of a catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key; changes win over rows of the same version."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def inserted_first(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table and the rows whose key it lacks."""
    return table.unionByName(rows.join(table.select(*keys), keys, "left_anti").dropDuplicates(keys))


def looked_up(files: DataFrame, features: DataFrame, value: str, keys: tuple[str, ...] = ("path", "size", "cfg_hash")) -> DataFrame:
    """files with a feature where path, size and configuration agree, else null: what is left to compute."""
    return files.join(features.select(*keys, value), list(keys), "left")


def with_twin(files: DataFrame, features: DataFrame, value: str, twin: str = "twin_path") -> DataFrame:
    """The feature of a file's own path, else of its twin; mirrored says that it came from there."""
    own = features.select("path", "size", F.col(value).alias("_own"))
    other = features.select(F.col("path").alias(twin), "size", F.col(value).alias("_twin"))
    both = files.join(own, ["path", "size"], "left").join(other, [twin, "size"], "left")
    return both.withColumn(value, F.coalesce("_own", "_twin")).withColumn("mirrored", F.col("_own").isNull() & F.col("_twin").isNotNull()).drop("_own", "_twin")


def with_twins(files: DataFrame, features: DataFrame, value: str, twins: str = "twin_paths") -> DataFrame:
    """The feature of a file's own path, else of the first of its twin paths (an array, null or empty: none) that has one of the same size."""
    places = F.concat(F.array("path"), F.coalesce(twins, F.expr("cast(array() as array<string>)")))
    tried = files.select("path", "size", places.alias("_places")).distinct().select(F.col("path").alias("_path"), "size", F.posexplode("_places").alias("_at", "path"))
    hits = tried.join(features.where(F.col(value).isNotNull()).select("path", "size", F.struct(F.col(value)).alias("_f")), ["path", "size"])
    best = hits.groupBy(F.col("_path").alias("path"), "size").agg(F.min_by("_f", "_at")[value].alias(value), (F.min("_at") > 0).alias("mirrored"))
    return files.join(best, ["path", "size"], "left").withColumn("mirrored", F.coalesce("mirrored", F.lit(False)))


def unreported(outbox: DataFrame, acked: DataFrame, keys: list[str]) -> DataFrame:
    """Results that no acknowledgement covers, to be sent again before new work is asked for; replays are harmless, see the queue."""
    return outbox.join(acked.select(*keys).distinct(), keys, "left_anti")


def update_counters(changed: DataFrame, *keys: str) -> DataFrame:
    """Counts of changed_updates(): received, and unchanged that nothing need redraw."""
    return changed.groupBy(*keys).agg(F.count("*").alias("received"), F.count_if(~F.col("keep")).alias("unchanged"))


def pruned(features: DataFrame, existing: DataFrame) -> DataFrame:
    return features.join(existing.select("path").distinct(), "path", "left_semi")


def leaves(records: DataFrame, key: str, props: str) -> DataFrame:
    """(key, path, value): every node of JSON texts of any depth, objects and arrays by their kind, scalars by kind and value; texts that are no JSON have none.

    Level by level, each written once; only whether there is a next one is asked by the driver. Numbers are equal as doubles.
    """
    json = records.select(F.col(key).alias("_id"), F.lit("").alias("path"), F.try_parse_json(props).alias("v")).where("v is not null")
    levels = []
    while True:
        kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
        level = written(json.withColumn("kind", kind))
        text = F.try_variant_get("v", "$", "string")
        number = F.concat(F.lit("n:"), F.try_variant_get("v", "$", "double").cast("string"))
        value = F.when(F.col("kind").isin("OBJECT", "ARRAY", "VOID"), F.col("kind")).when(F.col("kind").isin("STRING", "BOOLEAN"), F.concat(F.substring("kind", 1, 1), F.lit(":"), text)).otherwise(number)
        levels.append(level.select(F.col("_id").alias(key), "path", value.alias("value")))
        inner = level.where("kind in ('OBJECT', 'ARRAY')")
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        # a name tells its length, so that no other name and no place reads like it
        step = F.when(F.col("kind") == "OBJECT", F.concat(F.lit("."), F.length("key").cast("string"), F.lit(":"), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string")))
        parts = records.sparkSession.tvf.variant_explode(F.col("v").outer())
        json = inner.lateralJoin(parts.select("pos", "key", F.col("value").alias("part"))).select("_id", F.concat("path", step).alias("path"), F.col("part").alias("v"))


def changed_updates(updates: DataFrame, current: DataFrame, key: str = "id", props: str = "props", least: int = 50) -> DataFrame:
    """updates with keep: false only where a queued update of one record says nothing new.

    updates: update_id, key, props, status, local, ispreset; current: key, props and maybe ispreset. Of several
    records of a key each must hold what the update says, at every depth, arrays place by place, and none may be a
    preset. Batches under `least` rows pass whole.
    """
    updates = written(updates)  # read more than once, planned once
    large = updates.count() >= least
    twice = updates.groupBy(key).agg((F.count("*") > 1).alias("_twice"))
    news = leaves(updates.select(F.struct("update_id", key).alias("u"), props), "u", props).select("u.update_id", F.col(f"u.{key}").alias(key), "path", "value")
    held = leaves(current, key, props).groupBy(key, "path", "value").agg(F.count("*").alias("_held"))
    preset = F.coalesce("ispreset", F.lit(False)) if "ispreset" in current.columns else F.lit(False)
    known = current.groupBy(key).agg(F.count("*").alias("_known"), F.bool_or(preset).alias("_preset"))
    lacking = news.join(known, key).join(held, [key, "path", "value"], "left").where(F.coalesce("_held", F.lit(0)) < F.col("_known"))
    differs = lacking.select("update_id").distinct().withColumn("_differs", F.lit(True))
    joined = updates.join(twice, key, "left").join(differs, "update_id", "left").join(known, key, "left")
    queued = F.coalesce("status", F.lit("")).isin("pending", "downloading")
    drop = F.lit(large) & queued & ~F.coalesce("local", F.lit(False)) & ~F.coalesce("ispreset", F.lit(False)) & ~F.coalesce("_twice", F.lit(True)) & F.col("_known").isNotNull() & ~F.coalesce("_preset", F.lit(True)) & F.col("_differs").isNull()
    return joined.withColumn("keep", ~drop).select(*updates.columns, "keep")
