"""Operator 8: exact top-k by exhaustive term-at-a-time accumulation.

Queries and candidates are dealt into tiles by a hash of their id, every query
tile meets every candidate tile in one task, and there each query's nonzero
terms scatter their weighted postings into a dense score array. The k best of a
tile are picked by partition selection and merged over tiles.

Cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows with a null id. Vectors of another length than the query's count absent terms as zero.
Repeated rows are candidates each; a row is no candidate of queries of its own id. Ties go to the
smaller id. With no queries or candidates the result is empty. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

#: Rows of a tile at least and at most: small inputs still spread, and a task's arrays stay bounded.
TILE_ROWS = (1024, 32_768)
#: Queries whose dense score arrays are held at a time.
BLOCK = 64


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0) -> DataFrame:
    """key and w: floor(scale * x) of each component of the usable vectors."""
    x = F.col(vector)
    usable = F.col(key).isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("w")
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as a dense matrix; shorter rows end in zeros."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def best_of_tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int):
    """Yields for each query (id, candidate ids, scores), the k best of the candidates with another id."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    top = int(np.abs(q).max(initial=0)) * int(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    kind = np.int32 if top < 2**31 else np.int64 if top < 2**63 else object
    postings = [np.ascontiguousarray(c[:, t]).astype(kind) for t in range(c.shape[1])]
    sparse = [np.flatnonzero(p) for p in postings]
    lowest = -(2**31) if kind is np.int32 else -(2**63)
    for at in range(0, len(q_ids), BLOCK):
        block = q[at : at + BLOCK].astype(kind)
        scores = np.zeros((len(block), len(c_ids)), kind)
        for t, posting in enumerate(postings):
            rows = np.flatnonzero(block[:, t])
            if not len(rows) or not len(sparse[t]):
                continue
            if 4 * len(sparse[t]) < len(c_ids):
                scores[np.ix_(rows, sparse[t])] += block[rows, t, None] * posting[sparse[t]]
            elif len(rows) == len(block):
                scores += block[:, t, None] * posting
            else:
                scores[rows] += block[rows, t, None] * posting
        for i, own in enumerate(q_ids[at : at + BLOCK]):
            score = scores[i]
            a, b = np.searchsorted(c_ids, own, "left"), np.searchsorted(c_ids, own, "right")
            left = len(c_ids) - (b - a)
            if left <= 0:
                continue
            if b > a:
                score = score.copy()
                score[a:b] = lowest
            if left > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                above = np.flatnonzero(score > least)
                picked = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])
            else:
                picked = np.flatnonzero((c_ids != own))
            yield own, c_ids[picked], score[picked]


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, tile_rows: tuple[int, int] = TILE_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates; both inputs as from quantised()."""
    least, most = tile_rows
    tiles = lambda df, spread: max(1, -(-(n := df.count()) // min(most, max(least, n // spread))))
    n_q, n_c = tiles(queries, 2), tiles(candidates, 12)
    each = lambda df, own, n, other, m: df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "id", "w")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            width = max(int(np.diff(t.column("w").combine_chunks().offsets.to_numpy()).max()) for t in (left, right))
            found = list(best_of_tile(left.column("id").to_numpy(), _matrix(left.column("w"), width), right.column("id").to_numpy(), _matrix(right.column("w"), width), k))
        else:
            found = []
        long = lambda parts: pa.array(np.concatenate([np.asarray(p, np.int64) for p in parts]) if parts else np.empty(0, np.int64), pa.int64())
        return pa.table({"query_id": long([np.full(len(c), q) for q, c, _ in found]), "vec_id": long([c for _, c, _ in found]), "score": long([s for _, _, s in found])})

    pairs = each(queries, "qt", n_q, "ct", n_c).groupBy("qt", "ct").cogroup(each(candidates, "ct", n_c, "qt", n_q).groupBy("qt", "ct")).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(rows.where(F.col("id") % 20 == 0), rows)


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) w
  from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0))) as bigint) score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score
from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""
