"""A stored table of file features that batches of one kind of feature are merged into.

A row is a file by its path; each kind of feature has columns of its own, among them the hash of the settings it was made
with (options.feature_hash). A batch renews what is known of a file and the columns of its kind, no others. The table lies in
buckets by a hash of the path; a merge reads and writes only the buckets that the batch touches, by dynamic partition
overwrite of rows staged before, so a lost executor repeats a task and a failed merge leaves the table as it was. One merge at a time.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import dropped, written

#: What is known of a file, whatever its features.
ABOUT = "path string, size long, mtime long, item_id string, url string, updated long"
#: Kinds of features and their columns.
KINDS = {
    "duration": "duration double",
    "visual": "phash_parts array<string>, color_histogram array<double>, visual_hash string",
    "audio": "audio_digest string, audio_words array<long>, audio_hash string",
    "semantic": "frames array<array<float>>, semantic_hash string",
    "patch": "patches array<array<array<float>>>, patch_hash string",
}


def latest(rows: DataFrame, own: list[str], into: str = "_new") -> DataFrame:
    """(path, into: the columns `own`) of the last updated row of each path; rows without a path go."""
    order = F.struct("updated", "mtime", "size", F.xxhash64(*own))
    return rows.where("path is not null").groupBy("path").agg(F.max_by(F.struct(*own), order).alias(into))


def _names(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).fieldNames()


@dataclass(frozen=True)
class FeatureTable:
    """kinds: columns of each kind of feature; buckets stays as it was when the table was first written."""

    spark: SparkSession
    at: str
    kinds: dict[str, str]
    buckets: int = 64

    @property
    def columns(self) -> list[str]:
        return [*_names(ABOUT), *(c for ddl in self.kinds.values() for c in _names(ddl))]

    def _exists(self) -> bool:
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(self.at)
        return path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)

    def _stored(self) -> DataFrame:
        schema = StructType.fromDDL(", ".join([ABOUT, *self.kinds.values(), "bucket int"]))
        return self.spark.read.schema(schema).parquet(self.at) if self._exists() else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._stored().drop("bucket")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(self.buckets)).cast("int"))

    def _merge(self, batch: DataFrame, own: list[str]) -> int:
        """Renews the columns `own` of the batch's rows; of several rows of a path the last updated. Returns how many buckets were written."""
        news = written(self._bucketed(latest(batch, own)))
        # no more numbers than buckets
        touched = sorted(r.bucket for r in news.select("bucket").distinct().collect())
        if touched:
            old = self._stored().where(F.col("bucket").isin(touched))
            both = old.join(news, ["bucket", "path"], "full")
            new = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c))
            staged = written(both.select("path", *((new(c) if c in own else F.col(c)).alias(c) for c in self.columns if c != "path"), "bucket"))
            # a bucket is one file, if it isn't large
            staged.repartition("bucket").write.partitionBy("bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.at)
            dropped(staged)
        dropped(news)
        return len(touched)

    def merge(self, kind: str, batch: DataFrame) -> int:
        """Merges rows of ABOUT and one kind's columns; a null feature is stored like any other."""
        return self._merge(batch, [c for c in [*_names(ABOUT), *_names(self.kinds[kind])] if c != "path"])

    def mirror(self, pairs: DataFrame) -> int:
        """Copies all features of the stored file `source` to the path it is also found under; pairs: source and ABOUT.

        Only a source of the same size counts; one that isn't stored, or is the path itself, gives nothing.
        """
        features = [c for c in self.columns if c not in _names(ABOUT)]
        stored = self.rows().select(F.col("path").alias("source"), "size", *features)
        return self._merge(pairs.where("source <> path").join(stored, ["source", "size"]), [c for c in self.columns if c != "path"])

    def looked_up(self, files: DataFrame, kind: str, wanted: str | None = None) -> DataFrame:
        """files (path, size) with the kind's columns and known: stored for this size and, where the kind has a hash, with the wanted one."""
        own = _names(self.kinds[kind])
        stored = self.rows().select("path", "size", *own, F.lit(True).alias("known"))
        if f"{kind}_hash" in own:
            stored = stored.where(F.col(f"{kind}_hash") == wanted)
        return files.join(stored, ["path", "size"], "left").withColumn("known", F.coalesce("known", F.lit(False)))

    def fill(self, files: DataFrame, kind: str, compute: Callable[[DataFrame], DataFrame], wanted: str | None = None, pieces: int = 1) -> tuple[int, int]:
        """Computes a kind's features of the files (ABOUT) that the table lacks for their size and settings, and merges them; (stored, failed) rows.

        compute gets files and returns ABOUT, the kind's columns but its hash, and error. A row with an error is not stored, so that the next run
        tries it again; a null feature without one is stored. The files go in `pieces`, each with buckets of its own: only those are read, and a run
        that was broken off goes on after the last piece that was merged. Of several rows of a path the last updated counts.
        """
        hashed = f"{kind}_hash" in _names(self.kinds[kind])
        about = _names(ABOUT)
        # once, not for each piece
        listed = written(self._bucketed(latest(files, about, "_file").select("_file.*")))
        done = failed = 0
        for i in range(pieces):
            own = F.col("bucket").between(i * self.buckets // pieces, (i + 1) * self.buckets // pieces - 1)
            stored = self._stored().where(own)
            # without a hash nothing tells a stored null from none, so it is computed again
            has = F.col(f"{kind}_hash") == wanted if hashed else F.coalesce(*_names(self.kinds[kind])).isNotNull()
            todo = listed.where(own).join(stored.where(has).select("path", "size"), ["path", "size"], "left_anti").select(*about)
            found = written(compute(todo))
            good = found.where("error is null").drop("error")
            n = found.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
            self.merge(kind, good.withColumn(f"{kind}_hash", F.lit(wanted)) if hashed else good)
            dropped(found)
            done, failed = done + n[0], failed + n[1]
        dropped(listed)
        return done, failed
