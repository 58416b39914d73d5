"""Operator 13: approximate nearest neighbours by inner product, in a forest of random-projection trees.

Vectors get one more component that makes them equally long, so that the largest inner
product is the least distance. Each tree splits them along random orthogonal directions, at
medians of a bounded sample; every row is put into a leaf of every tree. A query walks all trees at once by one
priority queue of the splits it has passed by, nearest first, until the leaves it has met hold enough rows.
Rows and queries meet in blocks of neighbouring leaves: there the leaves that a query asked for are scored exactly, and the
best of each block are merged. A block with many rows or queries is dealt into parts, each part of one side meeting each of the other.

How many rows a query looks at is WORK * n ** GROWTH, the law that kept recall over 0.9 for vectors without
any structure from 500 to 200,000 rows; with as many as that, small tables are searched whole. The
sample takes the rows of least hash, SAMPLE components at most, so it also bounds the trees that are broadcast.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows with a
null id. Shorter vectors end in zeros. Equal vectors are one candidate with their k + 1 least ids, which
is all that a result of k can hold, so a group of copies costs one row. A repeated row counts once, an id with several
vectors once for each of its scores, and never in its own result; a repeated query id is one query for all of its vectors. Ties go to the smaller id. Without queries or candidates the result is empty.
Scores are sums of products in the order of components, in double precision. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, written

TREES, LEAF_ROWS, MAX_DEPTH = 4, 64, 12
#: Rows a query looks at, counted in every tree that shows them: WORK * n ** GROWTH.
WORK, GROWTH = 4.5, 5 / 6
#: Components of the sample that the splits are fitted on.
SAMPLE = 2**22
#: Components of the rows, and queries, that meet in one part of a block, about.
BLOCK_CELLS, BLOCK_QUERIES = 2**22, 2048


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and v of the rows that take part."""
    x = F.col(vector)
    sound = F.col(key).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(x, lambda v: v.cast("double")).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and ids: each vector once, with its k + 1 least ids; the rank bounds a group before it is shuffled."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    return rows.distinct().withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows as a dense matrix; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass(frozen=True)
class Forest:
    """Trees over vectors of `width` components, lengthened to `norm`; directions[t]: width + 1 by depth, cuts[t][l]: the medians of level l."""

    width: int
    norm: float
    depth: int
    directions: list[np.ndarray]
    cuts: list[list[np.ndarray]]

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        x = self.lengthened(x)
        out = np.zeros((len(x), len(self.cuts)), np.int64)
        for t, (r, cuts) in enumerate(zip(self.directions, self.cuts, strict=True)):
            p = x @ r
            for level, cut in enumerate(cuts):
                out[:, t] = 2 * out[:, t] + (p[:, level] > cut[out[:, t]])
        return out

    def projected(self, q: np.ndarray) -> list[np.ndarray]:
        """The queries, as long as all rows, on each tree's directions."""
        q = np.c_[q * (self.norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros(len(q))]
        return [q @ r for r in self.directions]

    def visited(self, place: list[np.ndarray], sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the squared distance already passed by, from one queue over all trees, until the leaves hold `wanted` rows.

        place: the query's projections in each tree; sizes: rows of each leaf of each tree.
        """
        queue = [(0.0, t, 0, 0) for t in range(len(self.cuts))]
        out, seen = [], 0
        while queue and seen < wanted:
            passed, t, level, node = heapq.heappop(queue)
            cuts, at = self.cuts[t], place[t]
            while level < self.depth:
                gap = at[level] - cuts[level][node]
                side = gap > 0
                heapq.heappush(queue, (passed + gap * gap, t, level + 1, 2 * node + (not side)))
                node, level = 2 * node + side, level + 1
            if sizes[t][node]:
                out.append((t, node))
                seen += sizes[t][node]
        return out


def fitted(sample: np.ndarray, norm: float, rows: int, trees: int = TREES, seed: int = 13) -> Forest:
    """Trees whose leaves hold LEAF_ROWS of `rows` each, if the sample has two for each leaf."""
    width = sample.shape[1]
    depth = int(np.clip(round(np.log2(max(1, min(rows / LEAF_ROWS, len(sample) / 2)))), 0, min(MAX_DEPTH, width + 1)))
    bare = Forest(width, norm, 0, [], [])
    x, rng = bare.lengthened(sample), np.random.default_rng(seed)
    directions, every = [], []
    for _ in range(trees):
        r = np.linalg.qr(rng.normal(size=(width + 1, width + 1)))[0][:, :depth]
        p, node, cuts = x @ r, np.zeros(len(x), np.int64), []
        for level in range(depth):
            order = np.argsort(node, kind="stable")
            parts = np.split(p[order, level], np.searchsorted(node[order], np.arange(1, 2**level)))
            cuts.append(np.array([np.median(part) if len(part) else 0.0 for part in parts]))
            node = 2 * node + (p[:, level] > cuts[level][node])
        directions.append(r)
        every.append(cuts)
    return Forest(width, norm, depth, directions, every)


def scored(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of q and x, pair by pair, added in the order of components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


def best_of_block(q_ids: np.ndarray, q: np.ndarray, asked: list[np.ndarray], leaf: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int):
    """(query, id, score) columns: the k best of the rows in the leaves that each query asked for."""
    order = np.argsort(leaf, kind="stable")
    leaf, x = leaf[order], np.ascontiguousarray(x[order])
    longest = np.sqrt((x * x).sum(1).max())
    alone: dict[int, list[int]] = {}
    for row, c in enumerate(order):
        if len(ids[c]) == 1:
            alone.setdefault(ids[c][0], []).append(row)
    found = ([], [], [])
    for query, own, leaves in zip(q_ids.tolist(), q, asked, strict=True):
        # neighbouring leaves are one stretch of rows
        first = np.flatnonzero(np.r_[True, np.diff(leaves) > 1])
        starts = np.searchsorted(leaf, leaves[first], "left")
        ends = np.searchsorted(leaf, leaves[np.r_[first[1:] - 1, len(leaves) - 1]], "right")
        rough = np.concatenate([x[s:e] @ own for s, e in zip(starts, ends, strict=True)])
        rows = np.concatenate([np.arange(s, e) for s, e in zip(starts, ends, strict=True)])
        if query in alone:
            others = ~np.isin(rows, alone[query])
            rough, rows = rough[others], rows[others]
        if len(rough) > k + 1:
            last = np.partition(rough, len(rough) - k - 1)[len(rough) - k - 1]
            # with all that rounding may have put below the last
            rows = rows[rough >= last - 1e-9 * np.sqrt(own @ own) * longest]
        score = scored(np.broadcast_to(own, (len(rows), len(own))), x[rows])
        members = sorted((-s, i) for s, c in zip(score.tolist(), order[rows].tolist(), strict=True) for i in ids[c] if i != query)[:k]
        found[0].extend([query] * len(members))
        found[1].extend(i for _, i in members)
        found[2].extend(-s for s, _ in members)
    return found


def nearest(queries: DataFrame, rows: DataFrame, k: int = 20, trees: int = TREES, work: float = WORK, growth: float = GROWTH) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for each query; both inputs as from usable()."""
    spark = rows.sparkSession
    points = written(distinct_vectors(rows, k))
    n, width, square = points.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widest = queries.agg(F.max(F.size("v"))).first()[0]
    if not n or not widest:
        return empty
    width = max(width, widest)
    sample = points.select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(max(1, SAMPLE // width)).select("v").toArrow()
    forest = fitted(matrix(sample.column("v"), width), float(np.sqrt(square)), n, trees)
    shared = spark.sparkContext.broadcast(forest)
    block_rows = max(1, BLOCK_CELLS // width)
    # leaves of a block
    blocks = 2 ** max(0, forest.depth - int(np.log2(max(1, n / block_rows))))

    def indexed(batches):
        for batch in batches:
            leaf = shared.value.leaves(matrix(batch.column("v"), width))
            tree = np.tile(np.arange(trees), len(leaf))
            again = pa.array(np.repeat(np.arange(len(leaf)), trees))
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(leaf.reshape(-1)), batch.column("v").take(again), batch.column("ids").take(again)], names=["tree", "leaf", "v", "ids"])

    kept = written(points.mapInArrow(indexed, "tree long, leaf long, v array<double>, ids array<long>"))
    # one number for each leaf of the trees, which the sample bounds
    sizes = np.zeros((trees, 2**forest.depth), np.int64)
    for tree, leaf, size in kept.groupBy("tree", "leaf").count().collect():
        sizes[tree, leaf] = size
    counted = spark.sparkContext.broadcast(sizes)
    wanted = int(np.ceil(work * n**growth))

    def asking(batches):
        for batch in batches:
            own, place = shared.value, shared.value.projected(matrix(batch.column("v"), width))
            at, tree, block, asked = [], [], [], []
            for i in range(batch.num_rows):
                met: dict[tuple[int, int], list[int]] = {}
                for t, leaf in own.visited([p[i].tolist() for p in place], counted.value, wanted):
                    met.setdefault((t, leaf // blocks), []).append(leaf)
                for (t, b), some in met.items():
                    at.append(i)
                    tree.append(t)
                    block.append(b)
                    asked.append(sorted(some))
            picked = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(picked), batch.column("v").take(picked), pa.array(tree, pa.int64()), pa.array(block, pa.int64()), pa.array(asked, pa.list_(pa.int64()))], names=["id", "v", "tree", "block", "asked"])

    asked = written(queries.mapInArrow(asking, "id long, v array<double>, tree long, block long, asked array<long>"))
    kept = kept.withColumn("block", F.floor(F.col("leaf") / blocks))
    rows_in = kept.groupBy("tree", "block").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("row_parts"))
    asked_in = asked.groupBy("tree", "block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_parts"))
    # one row for each block, no more of them than leaves
    parts = F.broadcast(rows_in.join(asked_in, ["tree", "block"]))
    dealt = lambda df, own, other, by: df.join(parts, ["tree", "block"]).withColumns({own: F.pmod(F.xxhash64(by), F.col(f"{own}s")).cast("int"), other: F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))}).drop("row_parts", "query_parts")
    keys = ["tree", "block", "row_part", "query_part"]
    left, right = dealt(asked, "query_part", "row_part", "id"), dealt(kept, "row_part", "query_part", "v")

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        found = ([], [], [])
        if a.num_rows and b.num_rows:
            found = best_of_block(
                a.column("id").to_numpy(), matrix(a.column("v"), width), [np.asarray(s) for s in a.column("asked").to_pylist()], b.column("leaf").to_numpy(), matrix(b.column("v"), width), b.column("ids").to_pylist(), k
            )
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, "query_id long, vec_id long, score double")
    # a row may come from several trees
    once = pairs.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose id 20 divides, among all others."""
    rows = usable(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return nearest(rows.where(F.col("id") % 20 == 0), rows)
