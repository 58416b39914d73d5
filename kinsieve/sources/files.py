"""Sources and sinks: file listings by metadata only, JSON and sheet readers, fingerprints, run states."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import VIDEO, is_link


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, rel, size and mtime of every file below a folder; contents are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    base = root.rstrip("/").removeprefix("file://")
    return found.withColumn("path", F.regexp_replace("path", "^file:/+", "/")).withColumn("rel", F.substring("path", F.lit(len(base) + 2), F.length("path")))


def videos(spark: SparkSession, content_root: str, local_root: str | None = None) -> DataFrame:
    """item_id, path, size and mtime: numbered folders of the first root, any folder (as mp:name) of the second."""
    folder, suffix = F.substring_index("rel", "/", 1), F.lower(F.substring_index("rel", ".", -1))
    own = listing(spark, content_root).where(folder.rlike("^[0-9]+$") & F.col("rel").contains("/")).withColumn("item_id", folder)
    if local_root:
        own = own.unionByName(listing(spark, local_root).where(F.col("rel").contains("/")).withColumn("item_id", F.concat(F.lit("mp:"), folder)))
    return own.where(suffix.isin(*VIDEO)).select("item_id", "path", "size", "mtime")


def numbered(names: DataFrame, name: str) -> DataFrame:
    """All-digit names in numeric order."""
    return names.where(F.col(name).rlike("^[0-9]+$")).orderBy(F.col(name).cast("decimal(38,0)"))


def latest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def sheet(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a CSV sheet: its url column, or of each row of links all but the first."""
    rows = spark.read.option("header", "true").csv(path)
    if "url" in rows.columns:
        return rows.select("url").where(F.col("url").isNotNull())
    links = F.filter(F.array(*(F.col(f"`{c}`") for c in rows.columns)), is_link)
    return rows.select(F.explode(F.slice(links, F.lit(2), F.greatest(F.size(links), F.lit(1)))).alias("url"))


def id_file(spark: SparkSession, path: str) -> DataFrame:
    """Ids of JSON that is a list, or an object with archived_wids or wids."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = F.coalesce(F.expr("try_variant_get(v, '$.archived_wids', 'array<string>')"), F.expr("try_variant_get(v, '$.wids', 'array<string>')"), F.expr("try_variant_get(v, '$', 'array<string>')"))
    return text.select(F.explode(lists).alias("item_id"))


def project_file(text: Column) -> Column:
    """The file field of a project's JSON, with or without a byte order mark."""
    return F.get_json_object(F.regexp_replace(text, "^\ufeff", ""), "$.file")


def fingerprint(output: Column) -> Column:
    """(digest, words) of a line FINGERPRINT=n,n,..., the words as unsigned 32 bits; null without one."""
    line = F.nullif(F.regexp_extract(output, r"(?m)^FINGERPRINT=(.+)$", 1), F.lit(""))
    words = F.transform(F.split(line, ","), lambda x: F.trim(x).try_cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(line.isNotNull(), F.struct(F.sha1(line.cast("binary")).alias("digest"), words.alias("words")))


def detection_summary(found: DataFrame, total: int) -> DataFrame:
    """One JSON row: how many were asked, how many are delisted, and which."""
    items = F.sort_array(F.collect_list(F.struct("item_id", "reason")))
    return found.agg(F.to_json(F.struct(F.lit(total).alias("total_subscribed"), F.count("*").alias("delisted_count"), items.alias("items"))).alias("json"))


def url_list(ids: DataFrame, prefix: str) -> DataFrame:
    return ids.select(F.concat(F.lit(prefix), F.col("item_id")).alias("url"))


def write_json(path: str, value: dict) -> None:
    """A small JSON file of the driver, replaced at once."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w") as out:
        json.dump(value, out)
    os.replace(name, path)


def read_json(path: str, fallback: dict) -> dict:
    """The object in a file, or the fallback if it can't be read or is no object."""
    try:
        with open(path, encoding="utf-8-sig") as f:
            value = json.load(f)
    except (OSError, ValueError):
        return fallback
    return value if isinstance(value, dict) else fallback
