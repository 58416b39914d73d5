"""An index kept by micro-batches, each of which counts once however often it is handed on.

A batch's changes lie in a partition of its own number, which a replay overwrites with the same rows; the index is the
last change of each key over all batches, and its revision the number of the last batch that changed something.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import archive_id, path_key
from ..operators import store
from ..operators.scratch import dropped, written

CHANGE = "item_id string, key string, file string, verified boolean, seq long, present boolean"

# The callback of a finished download, and the bits of an item's state.
DOWNLOADED = 3406
STATE_BITS = {"subscribed": 1, "legacy": 2, "installed": 4, "needs_update": 8, "downloading": 16, "waiting": 32}


def archive_changes(updates: DataFrame, verified: Column | bool = True) -> DataFrame:
    """CHANGE rows of updates (seq, workshopid, local, project, file, status, type): installed local videos enter, unsubscribed ones leave; the rest says nothing of the index."""
    own = F.when(F.coalesce("workshopid", F.lit("")) == "", archive_id(F.coalesce("local", F.lit(False)), F.lit(None).cast("string"), F.col("project"), F.col("file")))
    gone, there = F.col("status") == "unsubscribed", (F.col("status") == "installed") & (F.lower("type") == "video")
    known = updates.withColumn("item_id", own).where(F.col("item_id").isNotNull() & (F.coalesce("file", F.lit("")) != "") & (gone | there))
    return known.select("item_id", path_key(F.col("file")).alias("key"), "file", (verified if isinstance(verified, Column) else F.lit(verified)).alias("verified"), F.col("seq").cast("long").alias("seq"), there.alias("present"))


@dataclass(frozen=True)
class DeltaIndex:
    """The index below a folder; at most one stream writes it."""

    spark: SparkSession
    at: str

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.at)

    def _log(self) -> DataFrame:
        schema = StructType.fromDDL(f"{CHANGE}, batch long")
        there = self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(self._path())
        return self.spark.read.schema(schema).parquet(self.at) if there else self.spark.createDataFrame([], schema)

    def apply(self, changes: DataFrame, batch: int) -> None:
        """Stores the last change of each key of a batch under its number; the same batch again changes nothing."""
        names = [f.name for f in StructType.fromDDL(CHANGE)]
        last = changes.groupBy("item_id", "key").agg(F.max_by(F.struct(*names), F.struct("seq", "present")).alias("c")).select("c.*", F.lit(batch).cast("long").alias("batch"))
        last.write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.at)

    def entries(self) -> DataFrame:
        """(item_id, key, file, verified, revision): what the index holds, and the batch that each entry is from."""
        last = self._log().groupBy("item_id", "key").agg(F.max_by(F.struct("file", "verified", "present", "batch"), F.struct("batch", "seq")).alias("c"))
        return last.where("c.present").select("item_id", "key", "c.file", "c.verified", F.col("c.batch").alias("revision"))

    def best(self) -> DataFrame:
        """(item_id, file, verified): of each item the current archive, before a backup, by key among equals."""
        order = F.struct(~F.col("key").contains("/projects/myprojects/"), "key")
        return self.entries().groupBy("item_id").agg(F.min_by(F.struct("file", "verified"), order).alias("c")).select("item_id", "c.file", "c.verified")

    def revision(self) -> int:
        """The last batch that changed something, -1 before any."""
        last = self._log().agg(F.max("batch")).first()[0]
        return -1 if last is None else last

    def compact(self) -> None:
        """One partition instead of many; entries and revision stay, keys that left are forgotten. For when no stream runs."""
        last = self.revision()
        if last < 0:
            return
        whole = written(self._log().groupBy("item_id", "key").agg(F.max_by(F.struct("file", "verified", "seq", "present"), F.struct("batch", "seq")).alias("c")).select("item_id", "key", "c.file", "c.verified", "c.seq", "c.present"))
        # the newest partition takes all, then the others are superseded
        self.apply(whole, last)
        system = self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for folder in system.listStatus(self._path()):
            if folder.getPath().getName().startswith("batch=") and folder.getPath().getName() != f"batch={last}":
                system.delete(folder.getPath(), True)
        dropped(whole)


def indexing(index: DeltaIndex, current: Callable[[], DataFrame], also: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: drops updates that say nothing new against current(), read anew for each batch, and applies the rest to the index.

    updates: update_id, id, props, status, local, ispreset, and what archive_changes() reads; `also` gets the updates that were kept.
    """
    def run(updates: DataFrame, batch: int) -> None:
        kept = store.changed_updates(updates, current()).where("keep").drop("keep")
        kept = written(kept)
        index.apply(archive_changes(kept), batch)
        if also:
            also(kept, batch)
        dropped(kept)

    return run


def item_state(state: Column) -> Column:
    """The bits of an item's state by name; null counts as none."""
    s = F.coalesce(state, F.lit(0))
    return F.struct(*((s.bitwiseAND(bit) != 0).alias(name) for name, bit in STATE_BITS.items()))


def downloads(callbacks: DataFrame, app_id: int, subscribed: DataFrame, states: DataFrame, progress: DataFrame) -> DataFrame:
    """Finished downloads among callbacks (callback, app_id, item_id, result) of one application, with what the side tables say of the item.

    subscribed(item_id), states(item_id, state), progress(item_id, done, total): one row for an item each; share is null without a total.
    """
    own = callbacks.where((F.col("callback") == DOWNLOADED) & (F.col("app_id") == app_id)).select("item_id", "result")
    rows = own.join(subscribed.select("item_id", F.lit(True).alias("listed")), "item_id", "left").join(states, "item_id", "left").join(progress, "item_id", "left")
    share = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.col("done") / F.col("total")))
    return rows.select("item_id", "result", F.coalesce("listed", F.lit(False)).alias("listed"), item_state(F.col("state")).alias("state"), share.alias("share"))
