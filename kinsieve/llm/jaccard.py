"""Operator 6: documents linked by the Jaccard similarity of their shingle sets, by a grouped prefix join.

Documents with equal sets are one class. Two sets with similarity >= t share a
shingle within their first n - ceil(t n) + 1 in any global order; here shingles
that no other class has come first, then those of low hash, rarest first, then
the others. Shingles of no other class are counted exactly: first among those of
low hash, over all documents, then, for classes that these do not rule out,
among the rest. A class with more of them than it may miss drops out.

What is left is collapsed into groups of equal prefixes, sizes and counts. Per
prefix shingle and size range all groups are paired with one hub, the group with
the fewest shingles of its own; filtered pairs are expanded and verified. Then
all components that share a prefix shingle and may pass the size and positional
filters are expanded and verified, component by component, in tasks
where each set stands once for each block of partners. No pair of linked copies but those
of a spanning forest leaves a task. Components of the links give the result.

Cases: null, empty and blank texts have the empty set and link with nothing.
Rows with equal ids are documents of their own; a null id is nobody's component
unless it stands alone. Copies link. Shingles and sets are compared by 64-bit
hashes. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocking import bucket_pairs
from ..operators.components import connected_components
from .common import dropped, hash64, mixed, read, shingled, written

SHINGLE, PERCENT = 5, 80
BASE = 0x9FB21C651E98DF25
#: Shingles below this share of the hash range are counted over all documents; a prefix is a fifth of a set.
LOW = 0.25
#: Words hashed at a time.
CHUNK = 250_000
#: Shingles that one verifying task holds, about; members of a hub or block that meet in one.
UNIT_SHINGLES, MEMBERS = 1_500_000, 500
#: Sizes whose logarithms to this base have one floor share a hub.
RANGE = 1.25


def sets_of(batches, column: int, size: int):
    """(batch, first row, list of each row's sorted shingle hashes) for stretches of rows."""
    for batch in batches:
        texts = batch.column(column)
        first, rows, n = 0, [], 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            words = text.encode().lower().split() if text else []
            rows.append(words)
            n += len(words)
            if n >= CHUNK or i + 1 == len(texts):
                hashes = np.fromiter(map(hash64, chain.from_iterable(rows)), np.uint64, n)  # most words stand once: a cache of them costs memory and more time
                every = shingled(hashes, size, BASE)
                sets, at = [], 0
                for r in rows:
                    if len(r) >= size:
                        sets.append(np.unique(every[at : at + len(r) - size + 1]))
                    elif r:
                        sets.append(mixed(shingled(hashes[at : at + len(r)], len(r), BASE) + np.uint64(len(r))))
                    else:
                        sets.append(np.empty(0, np.uint64))
                    at += len(r)
                yield batch, first, sets
                first, rows, n = i + 1, [], 0


def _prints(sets: list[np.ndarray], k: int) -> np.ndarray:
    """A 64-bit hash of each set, the k-th of its kind."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros(len(sets), np.uint64)
    if sizes.sum():
        weighed = mixed(np.concatenate(sets) + np.uint64(k))
        full = np.flatnonzero(sizes)
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = (np.bitwise_xor if k == 1 else np.add).reduceat(weighed, starts)
    return out.view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def _allowed(percent: int) -> Column:
    """The length of the prefix of a set of n shingles."""
    return F.expr(f"n - ({percent} * n + 99) div 100 + 1")


def _similar(percent: int, na: Column, nb: Column, common: Column) -> Column:
    """Whether sets of these sizes with that many shingles in common are similar enough."""
    return 100 * common >= percent * (na + nb - common)


def _alone(tokens: DataFrame) -> DataFrame:
    """(cid, alone): how many of a class's tokens(token, cid) no other class has."""
    owners = tokens.groupBy("token").agg(F.min("cid").alias("cid"), F.max("cid").alias("last"))
    return owners.where("cid = last").groupBy("cid").agg(F.count("*").alias("alone"))


def _hub(xs: list[int], ys: list[int], tokens: np.ndarray, cuts: np.ndarray):
    """For each x of xs the number of shingles it shares with each of ys; set i is tokens[cuts[i] : cuts[i + 1]]."""
    held = [tokens[cuts[y] : cuts[y + 1]] for y in ys]
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(ys)), [len(h) for h in held])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for x in xs:
        mine = tokens[cuts[x] : cuts[x + 1]]
        lo, hi = np.searchsorted(flat, mine, "left"), np.searchsorted(flat, mine, "right")
        n = hi - lo
        places = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield x, np.bincount(owner[places], minlength=len(ys))


def links_of(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) between the sets of side 0 and of side 1 of each star, as a spanning forest; those of one component are skipped."""
    star, side, cid, comp, sizes = (table.column(c).to_numpy() for c in ("star", "side", "cid", "comp", "n"))
    shingles = table.column("shingles").combine_chunks()
    cuts, tokens = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    a, b = [], []
    order = np.lexsort((cid, side, star))
    for own in np.split(order, np.flatnonzero(np.diff(star[order])) + 1):
        xs, ys = own[side[own] == 0], own[side[own] == 1]
        if not len(xs) or not len(ys):
            continue
        ny, by = sizes[ys], comp[ys]
        for x, common in _hub(xs.tolist(), ys.tolist(), tokens, cuts):
            for y in ys[(100 * common >= percent * (sizes[x] + ny - common)) & (by != comp[x])].tolist():
                p, q = find(int(comp[x])), find(int(comp[y]))
                if p != q:
                    root[p] = q
                    a.append(cid[x])
                    b.append(cid[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(ship: DataFrame, sets: DataFrame, percent: int, unit: int) -> DataFrame:
    """Links (a, b) of the stars in ship(star, side, cid, comp)."""
    sides = written(ship)
    total = sides.join(sets.select("cid", "n"), "cid").agg(F.sum("n")).first()[0] or 0
    tasks = int(max(1, -(-total // unit), min(2 * ship.sparkSession.sparkContext.defaultParallelism, total // 50_000)))
    full = sides.join(sets.select("cid", "n", F.concat("low", "high").alias("shingles")).hint("merge"), "cid").withColumn("task", F.pmod(F.xxhash64("star"), F.lit(tasks)))
    out = written(full.groupBy("task").applyInArrow(lambda table: links_of(table, percent), "a long, b long"))
    dropped(sides)
    return out


def _opened(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Classes with fewer shingles of their own, among those of low hash, than they may miss."""
    limit = np.uint64(int(LOW * 2**64))

    def low(batches):
        for _, _, sets in sets_of(batches, 0, size):
            mine = [s[: np.searchsorted(s, limit)] for s in sets]
            ids = np.repeat(_prints(sets, 1), [len(m) for m in mine])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(mine).view(np.int64)), pa.array(ids)], names=["token", "cid"])

    alone = _alone(docs.where("doc_id is not null").select("text").mapInArrow(low, "token long, cid long"))
    return classes.join(alone, classes["p1"] == alone["cid"], "left").where(F.coalesce("alone", F.lit(0)) < _allowed(percent)).select(F.col("p1").alias("cid"), "p2", "n", "rep", F.coalesce("alone", F.lit(0)).alias("u"))


def _sets(docs: DataFrame, opened: DataFrame, size: int) -> DataFrame:
    """(cid, n, low, high): the sets of those classes, by hash; a class may stand there twice if its row does."""
    limit = np.uint64(int(LOW * 2**64))

    def run(batches):
        for batch, first, sets in sets_of(batches, 2, size):
            cid = _prints(sets, 1)
            own = np.flatnonzero(cid == batch.column(0).slice(first, len(sets)).to_numpy())
            kept = [sets[i] for i in own]
            if not kept:
                continue
            at = [np.searchsorted(s, limit) for s in kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[own]), pa.array([len(s) for s in kept], pa.int64()), _lists([s[:k] for s, k in zip(kept, at, strict=True)]), _lists([s[k:] for s, k in zip(kept, at, strict=True)])],
                names=["cid", "n", "low", "high"],
            )

    # merged at every size: what is open grows with the input
    wanted = docs.join(opened.select("cid", F.col("rep").alias("doc_id")).hint("merge"), "doc_id").select("cid", "doc_id", "text")
    return wanted.mapInArrow(run, "cid long, n long, low array<long>, high array<long>")


def _prefixes(own: DataFrame, percent: int) -> DataFrame:
    """(cid, n, u, tokens, ranked): of each class the prefix without what no other class has; the first `ranked` are in order of frequency."""
    lows = own.select("cid", F.explode("low").alias("token"))
    shared = lows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = lows.join(shared, "token").groupBy("cid").agg(F.array_sort(F.collect_set(F.struct("df", "token"))).alias("by_df"))
    found = own.join(ranked, "cid", "left").withColumn("by_df", F.coalesce(F.transform("by_df", lambda x: x["token"]), F.array().cast("array<long>")))
    found = found.withColumn("u", F.size("low") - F.size("by_df") + F.col("rest")).withColumn("k", (_allowed(percent) - F.col("u")).cast("int")).where("k > 0")
    more = F.col("k") - F.size("by_df")
    # of the others it isn't known which no other class has, only how many
    tokens = F.when(more > 0, F.concat("by_df", F.slice("high", F.lit(1), (F.greatest(more, F.lit(0)) + F.col("rest")).cast("int")))).otherwise(F.slice("by_df", F.lit(1), F.col("k")))
    return found.select("cid", "n", "u", tokens.alias("tokens"), F.least("k", F.size("by_df")).alias("ranked")).dropDuplicates(["cid"])


def _links(sets: DataFrame, percent: int, unit: int) -> DataFrame:
    """(cid, component): the classes with links, by the prefix join of groups."""
    placed = written(_prefixes(sets, percent))
    keys = ["h1", "h2", "n", "u"]
    keyed = placed.withColumn("h1", F.xxhash64("tokens")).withColumn("h2", F.xxhash64(F.lit(1), "tokens"))
    groups = written(keyed.groupBy(*keys).agg(F.min("cid").alias("gid"), F.count("*").alias("classes"), F.first("tokens").alias("tokens"), F.first("ranked").alias("ranked")))
    members = written(keyed.select("cid", *keys).join(groups.select("gid", *keys), keys).select("gid", "cid"))
    place = F.when(F.col("pos") < F.col("ranked"), F.col("pos")).otherwise(0)
    postings = groups.select("gid", "n", "u", "ranked", F.posexplode("tokens").alias("pos", "token")).select("token", F.col("gid").alias("file_id"), "n", "u", place.alias("at"))

    # each group against the hub of its shingle and size range
    ranges = postings.withColumn("range", F.floor(F.log(RANGE, "n")))
    hubs = ranges.groupBy("token", "range").agg(F.min(F.struct("u", "file_id", "n")).alias("hub"), F.count("*").alias("df")).where("df > 1").select("token", "range", F.col("hub.file_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.u").alias("hub_u"))
    paired = ranges.withColumnsRenamed({"n": "own_n", "u": "own_u"}).join(hubs, ["token", "range"]).where((F.col("hub") != F.col("file_id")) & _similar(percent, F.col("hub_n"), F.col("own_n"), F.least(F.col("hub_n") - F.col("hub_u"), F.col("own_n") - F.col("own_u")))).select("hub", F.col("file_id").alias("gid"))
    paired = paired.unionByName(groups.where("classes > 1").select(F.col("gid").alias("hub"), "gid")).distinct()
    spokes = written(paired.join(members, "gid").where("hub <> cid").select("hub", "cid"))
    dealt = spokes.join(spokes.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("parts")), "hub").select("hub", "cid", F.xxhash64("hub", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("star"))
    ship = dealt.select("star", F.lit(1).alias("side"), "cid").unionByName(dealt.select("star", F.lit(0).alias("side"), F.col("hub").alias("cid")).distinct())
    near_by = _verified(ship.withColumn("comp", F.col("cid")), sets, percent, unit)
    first = written(connected_components(near_by).withColumnsRenamed({"node": "cid"}))

    # components that are not connected yet, each once for a shingle, with the most that any of its groups may have in common
    labelled = written(members.join(first, "cid", "left").select("gid", "cid", F.coalesce("component", "cid").alias("comp")))
    bounds = [F.min("n").alias("n"), F.max(F.col("n") - F.col("u")).alias("most"), F.max("at").alias("before"), F.max(F.col("n") - F.col("u") - F.col("at")).alias("after")]
    spans = postings.join(labelled.select(F.col("gid").alias("file_id"), "comp").distinct(), "file_id").groupBy("token", F.col("comp").alias("file_id")).agg(*bounds)
    spans = written(spans)
    several = spans.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    pairs = bucket_pairs(spans.join(several, "token"), ["file_id", "n", "most", "before", "after"], "token", 4 * MEMBERS)
    common = F.least("a_most", "b_most", F.least("a_before", "b_before") + F.least("a_after", "b_after"))
    pairs = pairs.where(_similar(percent, F.col("a_n"), F.col("b_n"), common)).select(F.col("a_file_id").alias("a"), F.col("b_file_id").alias("b")).distinct()
    sizes = labelled.groupBy("comp").agg(F.count("*").alias("classes"))
    parts = F.ceil(F.col("classes") / MEMBERS).cast("int")
    n_blocks = max(1, -(-placed.count() // MEMBERS))
    block = lambda c, i: F.pmod(F.xxhash64(c, i), F.lit(n_blocks))
    split = lambda x: sizes.select(F.col("comp").alias(x), F.explode(F.sequence(F.lit(0), parts - 1)).alias(f"{x}_part"))
    stars = pairs.join(split("a"), "a").join(split("b"), "b").withColumn("star", F.xxhash64(block("a", "a_part"), block("b", "b_part")))
    stars = written(stars.select("star", "a", "a_part", "b", "b_part"))
    by_part = labelled.join(sizes.select("comp", parts.alias("parts")), "comp").select("comp", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "cid")
    side = lambda k, x: stars.select("star", F.lit(k).alias("side"), F.col(x).alias("comp"), F.col(f"{x}_part").alias("part")).distinct()
    far = _verified(side(0, "a").unionByName(side(1, "b")).join(by_part, ["comp", "part"]).select("star", "side", "cid", "comp"), sets, percent, unit)

    ends = far.join(first.withColumnRenamed("cid", "node").alias("a_"), F.col("a") == F.col("a_.node"), "left").join(first.withColumnRenamed("cid", "node").alias("b_"), F.col("b") == F.col("b_.node"), "left")
    ends = ends.select(F.coalesce("a_.component", "a").alias("a"), F.coalesce("b_.component", "b").alias("b"))
    second = connected_components(ends).withColumnsRenamed({"node": "comp", "component": "joined"})
    out = written(labelled.select("cid", "comp").join(second, "comp", "left").select("cid", F.coalesce("joined", "comp").alias("component")))
    for table in (placed, groups, members, spokes, near_by, first, labelled, spans, stars, far):
        dropped(table)
    return out


def components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, unit: int = UNIT_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text)."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch, first, sets in sets_of(batches, 1, size):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(_prints(sets, 1)), pa.array(_prints(sets, 2))], names=["doc_id", "n", "p1", "p2"])

    rows = written(docs.mapInArrow(run, f"doc_id {kind}, n long, p1 long, p2 long"))
    keys = ["p1", "p2", "n"]
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("rep"))
    opened = written(_opened(docs, classes, size, percent))
    sets = written(_sets(docs, opened, size))
    rest = _alone(sets.select(F.explode("high").alias("token"), "cid"))
    near = opened.join(rest, "cid", "left").withColumn("rest", F.coalesce("alone", F.lit(0))).where(F.col("u") + F.col("rest") < _allowed(percent)).select("cid", "rest")
    near = written(sets.join(near.hint("merge"), "cid"))
    dropped(sets)
    links = _links(near, percent, unit)
    linked = opened.join(links, "cid")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    found = written(linked.join(least, "component").select(F.col("cid").alias("p1"), "p2", "n", "least"))
    for table in (opened, near, links):
        dropped(table)
    ids = classes.join(found, keys, "left").select(*keys, F.coalesce("least", "rep").alias("component"))
    return (
        rows.alias("r").join(ids, keys, "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents", "doc_id", "text"))
