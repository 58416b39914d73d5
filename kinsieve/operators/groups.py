"""Groups of matching items: components, manual overrides, keepers and export frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocking import numbered
from .components import connected_components
from .scratch import written


def item_groups(matches: DataFrame, a: str = "a_item", b: str = "b_item") -> DataFrame:
    """(group_id, item_id): clusters that share an item are one; group_id is the least item. Items alone stay for the overrides."""
    return connected_components(matches, a, b).select(F.col("component").alias("group_id"), F.col("node").alias("item_id"))


def several_items(groups: DataFrame) -> DataFrame:
    """Only groups of two items or more."""
    return groups.join(groups.groupBy("group_id").agg(F.countDistinct("item_id").alias("n")).where("n >= 2").select("group_id"), "group_id", "left_semi")


def force_split(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The second item of each pair (a, b) inside one group leaves it, with all its rows, for a group of its own."""
    own = groups.select("group_id", "item_id").distinct()
    inside = pairs.select("a", "b").join(own.withColumnRenamed("item_id", "a"), "a").join(own.withColumnRenamed("item_id", "b"), ["b", "group_id"])
    evicted = inside.select("group_id", F.col("b").alias("item_id"), F.lit(True).alias("out")).distinct()
    named = F.when(F.col("out"), F.concat(F.col("group_id").cast("string"), F.lit("#"), F.col("item_id").cast("string"))).otherwise(F.col("group_id").cast("string"))
    return groups.join(evicted, ["group_id", "item_id"], "left").withColumn("group_id", named).select(*groups.columns)


def force_merge(groups: DataFrame, pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Groups of both items of each pair become one; items of `known` without a group are pulled in (other columns null), others skip the pair."""
    valid = pairs.select("a", "b").join(known.select(F.col("item_id").alias("a")).distinct(), "a", "left_semi").join(known.select(F.col("item_id").alias("b")).distinct(), "b", "left_semi")
    named = lambda x: valid.select(F.col(x).alias("item_id")).distinct()
    missing = named("a").union(named("b")).distinct().join(groups.select("item_id"), "item_id", "left_anti")
    every = written(groups.withColumn("group_id", F.col("group_id").cast("string")).unionByName(missing.select(F.col("item_id").cast("string").alias("group_id"), "item_id"), allowMissingColumns=True))
    at = lambda x: every.select(F.col("item_id").alias(x), F.col("group_id").alias(f"g{x}")).distinct()
    merged = connected_components(valid.join(at("a"), "a").join(at("b"), "b").select("ga", "gb"), "ga", "gb")
    return every.join(merged, every["group_id"] == merged["node"], "left").withColumn("group_id", F.coalesce("component", "group_id")).select(*every.columns).distinct()


def best_files(files: DataFrame, keys: list[str] | tuple[str, ...] = ("item_id",), tie: str = "path") -> DataFrame:
    """The largest file of each item; the least path among equals."""
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), tie)
    return files.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def ranked(members: DataFrame, group: str = "group_id") -> DataFrame:
    """Keeper order in a group: larger, local (mp:) first, older, then the item id; rank 1 is the keeper."""
    order = Window.partitionBy(group).orderBy(F.desc("size"), F.when(F.col("item_id").cast("string").startswith("mp:"), 0).otherwise(1), "mtime", "item_id")
    return members.withColumn("rank", F.row_number().over(order)).withColumn("is_keeper", F.col("rank") == 1)


def export_links(members: DataFrame, value: str | Column, group: str = "group_id") -> DataFrame:
    """(seq, group, rank, link): the export as rows, groups numbered from 1 in their order; no group has to fit into one row."""
    number = numbered(members.select(group).distinct(), F.col(group), into="_seq")
    return members.join(number, group).select((F.col("_seq") + 1).alias("seq"), group, "rank", (F.col(value) if isinstance(value, str) else value).alias("link"))


def dual_export(members: DataFrame, links: str, folders: str, group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """The export as rows of links and as rows of folders, groups and ranks numbered alike."""
    both = export_links(members.withColumn("_both", F.struct(F.col(links).alias("link"), F.col(folders).alias("folder"))), "_both", group)
    return tuple(both.select("seq", group, "rank", F.col("link")[name].alias(name)) for name in ("link", "folder"))


def export_rows(members: DataFrame, value: str, group: str = "group_id") -> DataFrame:
    """One row for each group: its values in keeper order."""
    return members.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias("links"))


def export_wide(rows: DataFrame, width: int | None = None) -> DataFrame:
    """links as columns link_1 to link_width, as a sheet has them; without a width as many as the largest group has links."""
    if width is None:
        rows = written(rows)
        width = rows.agg(F.max(F.size("links"))).first()[0] or 0
    return rows.select(*[c for c in rows.columns if c != "links"], *(F.get("links", F.lit(i)).alias(f"link_{i + 1}") for i in range(width)))


def targets_of(sheet: DataFrame) -> DataFrame:
    """Of sheets with a list of links a row keeps the first; the rest are targets."""
    return sheet.select(F.explode(F.slice("links", F.lit(2), F.size("links"))).alias("url")).where(F.col("url").isNotNull())
