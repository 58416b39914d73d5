"""Candidate pairs: buckets that can match, pairs inside a bucket, across neighbouring buckets, or by true durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import nearest_bucket, valid_duration
from .scratch import written

#: Rows of one bucket that meet in one task; a larger bucket is dealt over several.
BLOCK_ROWS = 4096


def bucketed(files: DataFrame, mode: str = "nearest_0.5") -> DataFrame:
    """Rows with a valid duration, and their bucket."""
    return files.where(valid_duration(F.col("duration"))).withColumn("bucket", nearest_bucket(F.col("duration"), mode))


def bucket_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("bucket").agg(F.count("*").alias("n_files"), F.countDistinct("item_id").alias("n_items"))


def candidates(files: DataFrame) -> DataFrame:
    """Files of buckets with two files and two items at least: only these are worth their signatures."""
    return files.join(bucket_counts(files).where("n_files >= 2 and n_items >= 2").select("bucket"), "bucket", "left_semi")


def _blocks(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))


def dealt(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, rows: int = BLOCK_ROWS, heavy: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on keys with _i and _j, blocks of about `rows` rows of a heavy key's left and right side; join on keys, _i and _j.

    Each pair of blocks of a key is a join key of its own, so a key with very many rows spreads over many tasks; rows of
    a light key stay as they are. Only heavy keys, at most a row for each `rows` rows, are looked up.
    """
    if heavy is None:
        heavy = _blocks(left, keys, rows).withColumnRenamed("_blocks", "_left").join(_blocks(right, keys, rows).withColumnRenamed("_blocks", "_right"), keys).where("_left > 1 or _right > 1")

    def deal(df: DataFrame, id_: str, own: str, n: str, other: str, m: str) -> DataFrame:
        some = df.join(heavy, keys, "left").fillna(1, ["_left", "_right"])
        return some.withColumn(own, F.pmod(F.xxhash64(id_), F.col(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(m) - 1))).drop("_left", "_right")

    return deal(left, a, "_i", "_left", "_j", "_right"), deal(right, b, "_j", "_right", "_i", "_left")


def met(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, rows: int = BLOCK_ROWS, heavy: DataFrame | None = None) -> DataFrame:
    """left joined with right on keys, heavy keys dealt into blocks by the ids a and b."""
    x, y = dealt(left, right, keys, a, b, rows, heavy)
    return x.join(y, [*keys, "_i", "_j"]).drop("_i", "_j")


def bucket_pairs(files: DataFrame, keep: list[str] | None = None, key: str = "bucket", rows: int = BLOCK_ROWS) -> DataFrame:
    """a_ and b_ columns of the pairs of one bucket with a_file_id < b_file_id."""
    keep = [c for c in (keep or files.columns) if c != key]
    side = lambda x: files.select(F.col(key), *(F.col(c).alias(f"{x}_{c}") for c in keep))
    # both sides are the same rows: counted once
    heavy = _blocks(files, [key], rows).where("_blocks > 1").select(key, F.col("_blocks").alias("_left"), F.col("_blocks").alias("_right"))
    return met(side("a"), side("b"), [key], "a_file_id", "b_file_id", rows, heavy).where("a_file_id < b_file_id")


def pair_counts(files: DataFrame, key: str = "bucket") -> DataFrame:
    """key and n_pairs, how many pairs bucket_pairs() has of it, from the counts of its ids; a key without pairs has no row."""
    ids = files.where(F.col("file_id").isNotNull()).groupBy(key, "file_id").agg(F.count("*").alias("_m"))
    n = F.sum("_m")
    return ids.groupBy(key).agg(F.shiftright(n * n - F.sum(F.col("_m") * F.col("_m")), 1).alias("n_pairs")).where(F.col(key).isNotNull() & (F.col("n_pairs") > 0))


def cross_bucket_counts(files: DataFrame, tolerance: float) -> DataFrame:
    """bucket, next_bucket and n_pairs, how many pairs cross_bucket_pairs() has of them, from the counts of the buckets."""
    n = files.groupBy("bucket").agg(F.count("*").alias("_n"))
    left, right = n.withColumnRenamed("_n", "_left"), n.select(F.col("bucket").alias("next_bucket"), F.col("_n").alias("_right"))
    return neighbours(n, tolerance).join(left, "bucket").join(right, "next_bucket").select("bucket", "next_bucket", (F.col("_left") * F.col("_right")).alias("n_pairs"))


def neighbours(buckets: DataFrame, tolerance: float) -> DataFrame:
    """(bucket, next_bucket) of distinct bucket labels next to each other by value, no further apart than tolerance.

    Labels are few; they are ordered inside stretches of their value, and the last of each stretch meets the first of the next.
    """
    value = F.col("bucket").cast("double")
    labels = buckets.select("bucket").distinct().withColumn("v", value)
    # the next label within the tolerance lies in the same or the next stretch of that length
    cell = F.floor(F.col("v") / tolerance)
    near = labels.select("bucket", "v", F.explode(F.array(cell, cell + 1)).alias("cell"))
    pairs = near.alias("a").join(labels.select("bucket", "v", cell.alias("cell")).alias("b"), "cell").where((F.col("b.v") > F.col("a.v")) & (F.col("b.v") - F.col("a.v") <= tolerance))
    return pairs.groupBy(F.col("a.bucket").alias("bucket")).agg(F.min_by(F.col("b.bucket"), F.col("b.v")).alias("next_bucket"))


def cross_bucket_pairs(files: DataFrame, keep: list[str], tolerance: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of files of neighbouring buckets; those of one bucket come from bucket_pairs()."""
    near = neighbours(files, tolerance)
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in keep]
    # labels are few beside their files; a bucket has one neighbour
    left = files.select("bucket", *side("a")).join(near, "bucket")
    return met(left, files.select(F.col("bucket").alias("next_bucket"), *side("b")), ["next_bucket"], "a_file_id", "b_file_id", rows)


def duration_pairs(files: DataFrame, keep: list[str], tolerance: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs whose true durations differ by at most tolerance, by an equi-join on cells of that length."""
    cell = F.floor(F.col("duration") / tolerance)
    side = lambda x, c: [c.alias("_cell"), F.col("duration").alias(f"{x}_duration"), *(F.col(k).alias(f"{x}_{k}") for k in keep if k != "duration")]
    left, right = files.select(*side("a", F.explode(F.array(cell - 1, cell, cell + 1)))), files.select(*side("b", cell))
    return met(left, right, ["_cell"], "a_file_id", "b_file_id", rows).where((F.col("a_file_id") < F.col("b_file_id")) & (F.abs(F.col("a_duration") - F.col("b_duration")) <= tolerance)).drop("_cell")


def numbered(rows: DataFrame, *order, into: str = "place") -> DataFrame:
    """rows with their number from 0 in an order of unique values, counted over ranges instead of in one task."""
    # written once: two plans of it need not number their partitions alike
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row for each partition
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_place") - 1 + F.col("_before")).alias(into))


def batches(ids: DataFrame, key: str, size: int = 80) -> DataFrame:
    """Ids in numeric order with their batch number."""
    return numbered(ids, F.length(key), F.col(key)).select(key, F.floor(F.col("place") / size).alias("batch"))
