"""Operator 7: documents that hold benchmark passages, by spaced-seed hashing, in DataFrame expressions only.

Words are the lower-cased runs of letters and digits. Each fixed mask ignores
some positions of a stretch of words; the hashes of what it keeps, at every
position of every document, are joined with those of the benchmark items. A hit
fixes how document and item lie on each other; there the stretch around it is
compared word by word, and a document is contaminated if WINDOW consecutive
words of the item (all of a shorter one) agree in PERCENT of a hundred or more.

The masks hit every such alignment at the default WINDOW and PERCENT, whatever
the length of the item (tests enumerate all layouts); other values keep the
check but not that promise.

Cases: null and empty texts hit nothing; items of up to four words are found as
they are, longer ones with a fifth of their words replaced. Repeated rows count once; rows with one id and
other texts are apart, and both appear under the id. Null ids are kept. Empty
tables give an empty result. Extra columns are ignored, and kept by without_contaminated(), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free, read

#: Fixed masks: positions that count. The first two hit every layout of 3 substitutions in 15 words and of a fifth of an item of 7 to 14 words.
MASKS = ("1111", "11101", "10111", "11011")
#: Words of the items that need a mask, least and most. Items below the shortest of MASKS have masks of their own length.
LENGTHS = {"1": (1, 1), "11": (2, 2), "111": (3, 3), **dict(zip(MASKS, ((4, 2**31 - 1), (5, 2**31 - 1), (5, 6), (5, 5)), strict=True))}
WINDOW, PERCENT = 15, 80
#: Benchmark seeds are broadcast up to this many (24 bytes each); beyond it the join shuffles seeds and positions, no words.
MAX_BROADCAST = 1_000_000
#: Words of a piece of a document that such a join's hits look words up in, but for the overlap.
PIECE = 4096


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seeds(words: Column, at: Column, masks: list[str], item: bool = False) -> Column:
    """One hash for each mask at a position; of an item only for the masks that its length needs."""
    hashed = lambda mask: F.xxhash64(F.lit(mask), *(F.get(words, at + i) for i, bit in enumerate(mask) if bit == "1"))
    needed = lambda mask: F.size(words).between(*LENGTHS[mask]) if item else F.lit(True)
    return F.array(*(F.when((at + len(mask) <= F.size(words)) & needed(mask), hashed(mask)) for mask in masks))


def _positions(words: Column, masks: list[str]) -> Column:
    last = F.size(words) - min(map(len, masks))
    return F.when(last >= 0, F.sequence(F.lit(0), last))


def _looked_up(hits: DataFrame, d: DataFrame, longest: int) -> DataFrame:
    """The words at each hit, from pieces of the documents that overlap by the longest item."""
    pieces = d.where(F.size("words") > 0).select("doc_id", "h", "words", F.explode(F.sequence(F.lit(0), ((F.size("words") - 1) / PIECE).cast("int"))).alias("block"))
    pieces = pieces.select(F.col("doc_id").alias("of"), F.col("h").alias("hash"), "block", F.slice("words", F.col("block") * PIECE + 1, F.lit(PIECE + longest)).alias("words"))
    at = hits.withColumn("at", (F.col("from") / PIECE).cast("int"))
    same = at["doc_id"].eqNullSafe(pieces["of"]) & (at["h"] == pieces["hash"]) & (at["at"] == pieces["block"])
    return at.join(pieces, same).select("doc_id", "h", "item_id", "lie", F.slice("words", F.col("from") - F.col("block") * PIECE + 1, F.lit(longest)).alias("piece"))


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, percent: int = PERCENT) -> DataFrame:
    """doc_id, h (hash of the text), item_id, start (of the best window, in words), n_equal and n_window."""
    bench = items.select(F.col(item_key).alias("item_id"), words_of(F.col(item_text)).alias("item")).where(F.size("item") > 0)
    # the item's longest extent; documents are hashed only by masks that some item needs
    longest, *needed = bench.agg(F.max(F.size("item")), *(F.max(F.size("item").between(*LENGTHS[m])) for m in LENGTHS)).first()
    longest, masks = longest or 0, [m for m, some in zip(LENGTHS, needed, strict=True) if some] or list(MASKS)
    seeds = bench.select("item_id", "item", F.explode(_positions(F.col("item"), masks)).alias("p"))
    seeds = seeds.select("item_id", "p", F.explode(_seeds(F.col("item"), F.col("p"), masks, item=True)).alias("seed")).where("seed is not null")
    bounded = seeds.count() <= MAX_BROADCAST
    small = F.broadcast if bounded else lambda df: df

    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), words_of(F.col(text)).alias("words"))
    lie = F.col("at") - F.col("p")
    hit = ("doc_id", "h", "item_id", lie.alias("lie"), F.greatest(lie, F.lit(0)).alias("from"))
    placed = d.select("doc_id", "h", "words", F.explode(_positions(F.col("words"), masks)).alias("at"))
    placed = placed.select("doc_id", "h", "words", "at", F.explode(_seeds(F.col("words"), F.col("at"), masks)).alias("seed")).where("seed is not null")
    # the item's words follow after the join below
    if bounded:
        hits = placed.join(small(seeds), "seed").select(*hit, "words")
        stretches = hits.select("doc_id", "h", "item_id", "lie", F.slice("words", F.col("from") + 1, F.lit(longest)).alias("piece"))
    else:
        hits = placed.drop("words").join(seeds, "seed").select(*hit).distinct()
        stretches = _looked_up(hits, d, longest)
    stretches = stretches.groupBy("doc_id", "h", "item_id", "lie").agg(F.first("piece").alias("piece"))

    item = F.col("item")
    skipped = F.greatest(-F.col("lie"), F.lit(0))
    equal = F.transform(F.sequence(F.lit(0), F.size(item) - 1), lambda j: F.when(j < skipped, 0).otherwise(F.coalesce((F.get(item, j) == F.get(F.col("piece"), j - skipped)).cast("int"), F.lit(0))))
    n = F.least(F.size("equal"), F.lit(window))
    sums = F.transform(F.sequence(F.lit(0), F.size("equal") - n), lambda j: F.struct(F.aggregate(F.slice("equal", j + 1, n), F.lit(0), lambda a, x: a + x).alias("n_equal"), (-j).alias("j")))
    compared = stretches.join(small(bench), "item_id").select("doc_id", "h", "item_id", "lie", equal.alias("equal")).select("doc_id", "h", "item_id", "lie", n.alias("n_window"), F.array_max(sums).alias("best"))
    found = compared.where(100 * F.col("best.n_equal") >= percent * F.col("n_window")).select("doc_id", "h", "item_id", F.struct(F.col("best.n_equal").alias("n_equal"), (F.col("best.j") - F.col("lie")).alias("minus"), "n_window").alias("m"))
    best = found.groupBy("doc_id", "h", "item_id").agg(F.max("m").alias("m"))
    return best.select("doc_id", "h", "item_id", (-F.col("m.minus")).cast("long").alias("start"), F.col("m.n_equal").cast("long").alias("n_equal"), F.col("m.n_window").cast("long").alias("n_window"))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs but for those that hold a benchmark passage."""
    found = contaminated(docs, items).select("doc_id", "h").distinct()
    own = free(docs, "_h")
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return keyed.join(found, keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed[own] == found["h"]), "left_anti").drop(own)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents, one row for each with each of its items."""
    docs, items = read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    return contaminated(docs, items).drop("h")


# The twin knows nothing of seeds: it counts the agreeing words of every alignment that has any.
OP7_SQL = f"""
with t as (select distinct doc_id, text from documents where text is not null),
d as (select row_number() over () k, doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from t),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w from benchmark where text is not null),
bp as (select item_id, len(w) m, unnest(w) word, unnest(range(0, len(w))) p from b),
dp as (select k, unnest(w) word, unnest(range(0, len(w))) p from d),
hits as (
  select dp.k, bp.item_id, dp.p - bp.p lie from dp join bp on dp.word = bp.word
  group by all having 100 * count(*) >= {PERCENT} * least(any_value(bp.m), {WINDOW})),
eq as (
  select h.k, d.doc_id, h.item_id, h.lie, len(b.w) m,
    list_transform(range(0, len(b.w)), lambda j: case when h.lie + j >= 0 and coalesce(b.w[j + 1] = d.w[h.lie + j + 1], false) then 1 else 0 end) e
  from hits h join b on b.item_id = h.item_id join d on d.k = h.k),
win as (select *, least(m, {WINDOW}) n, unnest(range(0, m - least(m, {WINDOW}) + 1)) j from eq),
sums as (select *, list_sum(e[j + 1 : j + n]) s from win)
select doc_id, item_id, cast(lie + j as bigint) start, cast(s as bigint) n_equal, cast(n as bigint) n_window
from sums where 100 * s >= {PERCENT} * n
qualify row_number() over (partition by k, item_id order by s desc, lie + j) = 1
"""
