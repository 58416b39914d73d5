"""Operator 11: how filters interact in every order they may be applied in, by long-form window evaluation.

Each document gets a mask of the filters it fails. Documents are summed into
cells (part, mask) before anything is unpivoted, so the size of a source or of a
group of copies does not matter later: at most 32 cells of a part are laid out
against the steps of all orders. A running bit-or over the earlier steps of an
order tells which documents are gone already; conditional sums give the metrics
of a step, a window total over all orders a filter's Shapley count.

Copies are found by groups of (digest of the text, part, mask): each group keeps its
count, its least doc_id and how many rows have that id, so no group of copies is gathered.

Cases: a null text is empty, a null source the part ''. A null doc_id has no labels, is
never a copy and makes none. Repeated rows count each; rows of one id are no copies of each other.
Of several labels of a document, any 1 counts. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, read

FILTERS = "ABCDE"
#: Bit of each filter in a mask.
BITS = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 2
SPACE, SYMBOL = WORD.replace("^", ""), r"[#$%&*|]"
KEPT, REMOVED = "kept", "removed"


def text_mask(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    fails = {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct.cast("long") < MIN_DISTINCT * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > MAX_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(SYMBOL),
    }
    return sum((F.when(fail, BITS[f]).otherwise(0) for f, fail in fails.items()), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part that fail exactly the filters of the mask, and how many of them have the labels."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), F.md5(text.cast("binary")).alias("md"), F.crc32(text.cast("binary")).alias("crc"), text_mask(text).alias("mask"))
    # rows without id have no label: spread, they meet in no task
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("md", F.spark_partition_id())).otherwise(0))
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    labelled = rows.join(said, ["id", "salt"], "left").fillna(0, ["good", "toxic"])
    text_keys, flags = ["md", "crc"], ["part", "mask", "good", "toxic"]
    by_id = labelled.groupBy("id", "salt", *text_keys, *flags).agg(F.count("*").alias("n"))
    first = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    groups = by_id.groupBy(*text_keys, *flags).agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy(*text_keys))
    groups = groups.withColumn("fresh", F.col("nameless") + F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0))
    kinds = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("fresh").alias("n")), F.struct((F.col("mask") + BITS["E"]).alias("mask"), (F.col("n") - F.col("fresh")).alias("n"))))
    split = groups.select("part", "good", "toxic", kinds.alias("k")).select("part", "good", "toxic", "k.mask", "k.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def interactions(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The metrics of each part, order and step, from cells()."""
    orders = F.array(*(F.lit("".join(p)) for p in permutations(filters)))
    long = found.select("*", F.explode(orders).alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter"))
    bit = F.element_at(F.create_map(*(F.lit(x) for f in filters for x in (f, BITS[f]))), F.col("filter"))
    fails = F.col("mask").bitwiseAND(bit)
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("bit", bit).withColumn("fails", fails).withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    gone, failing = F.col("earlier") != 0, F.col("fails") != 0
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    steps = long.groupBy("part", "filter_order", "filter", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(~gone & ~failing).alias(KEPT), total(~gone & failing).alias(REMOVED), total(gone & failing).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(~gone & failing, "good").alias("good_lost"), total(~gone & failing, "toxic").alias("toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum(REMOVED).over(Window.partitionBy("part", "filter"))).select("part", "filter_order", "step", KEPT, REMOVED, "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over the whole of documents."""
    return interactions(cells(read(spark, sf_dir, "documents", "doc_id", "source", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")))


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by 1),
f as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)] fails
  from d left join l on l.doc_id = d.doc_id),
c as (select part, fails, count(*) n, sum(good) good, sum(toxic) toxic from f group by 1, 2),
k as (select unnest(['A', 'B', 'C', 'D', 'E']) x),
o as (
  select a.x || b.x || c.x || d.x || e.x filter_order from k a, k b, k c, k d, k e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, unnest(range(1, 6)) step from o),
x as (
  select part, filter_order, step, filter_order[step] own, n, good, toxic, fails[instr('ABCDE', filter_order[step])] fail,
    len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) > 0 gone, len(list_filter(fails, lambda y: y)) = 1 one
  from c, s),
m as (
  select part, filter_order, step, own, coalesce(sum(n) filter (not gone and not fail), 0) kept, coalesce(sum(n) filter (not gone and fail), 0) removed,
    coalesce(sum(n) filter (gone and fail), 0) redundant, coalesce(sum(n) filter (fail and one), 0) unique_fails,
    coalesce(sum(good) filter (not gone and fail), 0) good_lost, coalesce(sum(toxic) filter (not gone and fail), 0) toxic_lost
  from x group by all)
select part, filter_order, cast(step as integer) step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant,
  cast(unique_fails as bigint) unique_fails, cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost,
  cast(sum(removed) over (partition by part, own) as bigint) shapley
from m
"""
