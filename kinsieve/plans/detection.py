"""The whole detection on the provided tables: a run of ten vectors is a file, the event of its number gives duration, item and sound."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection
from ..options import SCALED as O  # noqa: N814
from . import media

#: Items are users modulo this; durations lie between 20 and 24.
ITEMS = 40


def signed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("file_id"), (F.col("user_id") % ITEMS).alias("item_id"), (F.col("value") % 4 + 20).alias("duration"), F.col("event_type").alias("audio"), F.col("value").alias("size"), F.col("ts").alias("mtime")
    )
    return media.frame_files(spark, sf_dir).drop("bucket").join(e, "file_id")


def item_pairs(files: DataFrame, every: int, rest: int, step: int) -> DataFrame:
    """(a, b): an item of each `every` and the one `step` after it."""
    return files.where(F.col("item_id") % every == rest).select(F.col("item_id").alias("a"), (F.col("item_id") + step).alias("b")).distinct()


def detection_plan(spark, sf_dir):
    files = signed_files(spark, sf_dir)
    return detection.detect(files, O, 4, item_pairs(files, 4, 0, 1), item_pairs(files, 7, 2, 3))


QUERIES = {"detection_plan": detection_plan}

_CC = """bo{1} as (select a, b from {0} union select b, a from {0}), re{1}(node, r) as (select a, a from bo{1} union select bo{1}.b, re{1}.r from re{1} join bo{1} on bo{1}.a = re{1}.node), cc{1} as (select node, min(r) component from re{1} group by 1)"""
_FILES = f"""fr as (select vec_id // 10 f, vec_id % 10 k, cast(embedding as double[]) v from embeddings),
ev as (select event_id f, user_id % {ITEMS} item, value % 4 + 20 duration, value size, ts mtime, cast(round_even((value % 4 + 20) * 2, 0) / 2 as varchar) bucket from events where event_id in (select f from fr)),
bk as (select bucket, cast(bucket as double) v from ev group by 1 having count(*) > 1 and count(distinct item) > 1),
nb as (select bucket, bucket other from bk union all select bucket, lead(bucket) over (order by v) from bk qualify lead(v) over (order by v) - v <= {O.duration_cross_bucket_tolerance}),
ok as (select x.f a, y.f b from nb join ev x on x.bucket = nb.bucket join ev y on y.bucket = nb.other where nb.bucket <> nb.other or x.f < y.f),
pr as (select a, b, x.k, x.v va, y.v vb from ok join fr x on x.f = a join fr y on y.f = b and x.k = y.k)"""
_RANK = "cast(row_number() over (partition by g order by size desc, mtime, item) as bigint)"
_SCORED = media._SCORE.removeprefix(media._PAIRS)

ORACLE = {
    "detection_plan": f"""with recursive {_FILES}{_SCORED}, {media._VERDICT},
fe as (select x.item a, y.item b, x.f fa, y.f fb from gt join ev x on x.f = gt.a join ev y on y.f = gt.b where g like 'YES%'), {_CC.format("fe", 1)},
mb as (select distinct cast(component as varchar) g, item, f from (select a item, fa f from fe union select b, fb from fe) join cc1 on node = item),
pi as (select distinct item a from ev),
sp as (select distinct x.g, y.item from pi join mb x on x.item = pi.a join mb y on y.item = pi.a + 1 and y.g = x.g where pi.a % 4 = 0),
ms as (select case when sp.item is not null then mb.g || '#' || mb.item else mb.g end g, mb.item, f from mb left join sp on sp.g = mb.g and sp.item = mb.item),
mp as (select a, a + 3 b from pi where a % 7 = 2 and a + 3 in (select a from pi)),
al as (select * from ms union all select cast(item as varchar), item, ev.f from ev where item in (select a from mp union select b from mp) and item not in (select item from ms)),
me as (select distinct x.g a, y.g b from mp join al x on x.item = mp.a join al y on y.item = mp.b), {_CC.format("me", 2)},
fin as (select coalesce(component, al.g) g, item, f from al left join cc2 on node = al.g),
best as (select g, item, f, size, mtime from fin join ev using (f, item) qualify row_number() over (partition by g, item order by size desc, f) = 1),
lg as (select * from best qualify count(*) over (partition by g) > 1)
select dense_rank() over (order by g) seq, g group_id, {_RANK} rank, {_RANK} = 1 is_keeper, item item_id, f file_id from lg""",
}
