"""Pairs of rows that share a key, worked out in tiles of numpy arrays.

Rows of a key are dealt into blocks; each pair of blocks is a group of its own, so a key with very many rows spreads over
many tasks and a task holds two blocks at most. A row is shipped once for each block of its key, never once for each pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: at most the first, while a key has few blocks, then at most the second.
BLOCK_ROWS = (2048, 4096)
#: Blocks of a key before its blocks grow.
FEW = 8
#: Rows and columns whose dense metrics are held at a time.
TILE = 256


def _count(rows: tuple[int, int]):
    n = F.count("*")
    return F.greatest(F.least(F.ceil(n / rows[0]), F.lit(FEW)), F.ceil(n / rows[1])).cast("int")


def _grouped(dealt: DataFrame, n: int, run: Callable, schema: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        i, j, right = t.column("_i")[0].as_py(), t.column("_j")[0].as_py(), t.column("_right").to_numpy()
        t = t.drop_columns(["_key", "_i", "_j", "_right"])
        if i >= 0 and i == j:
            yield from run(t, t, True)
        elif right.any() and not right.all():
            yield from run(t.filter(pa.array(~right)), t.filter(pa.array(right)), False)

    # by number: the rows are few and the work on them is not, so the groups must not be put together by bytes
    return dealt.repartition(n, "_key", "_i", "_j").groupBy("_key", "_i", "_j").applyInArrow(each, schema)


def _groups(dealt_counts: DataFrame, pairs) -> int:
    return int(min(4096, max(1, dealt_counts.agg(F.sum(pairs)).first()[0] or 0)))


def within(files: DataFrame, key: str, id_: str, run: Callable, schema: str, rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """What run(left, right, own) yields for each pair of blocks of a key; own: both sides are one block."""
    counts = files.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(_count(rows).alias("_n"))
    b, o = F.col("_b"), F.col("_o")
    dealt = files.withColumn("_key", F.col(key)).join(counts, "_key").withColumn("_b", F.pmod(F.xxhash64(id_), F.col("_n")).cast("int"))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumns({"_i": F.least(b, o), "_j": F.greatest(b, o), "_right": b > o})
    # a group knows its sides by their blocks
    return _grouped(dealt.drop("_b", "_o", "_n"), _groups(counts, F.col("_n") * (F.col("_n") + 1) / 2), run, schema)


def across(left: DataFrame, right: DataFrame, id_: str, run: Callable, schema: str, rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """What run(left, right, False) yields for each pair of a block of left and one of right with the same _key; both sides have the same columns."""
    counts = left.groupBy("_key").agg(_count(rows).alias("_l")).join(right.groupBy("_key").agg(_count(rows).alias("_r")), "_key")

    def deal(side: DataFrame, own: str, other: str, at: tuple[str, str], is_right: bool) -> DataFrame:
        some = side.join(counts, "_key").withColumn(at[0], -1 - F.pmod(F.xxhash64(id_), F.col(own)).cast("int"))
        return some.withColumn(at[1], F.explode(F.sequence(-F.col(other), F.lit(-1)))).withColumn("_right", F.lit(is_right)).drop("_l", "_r")

    # numbers below zero: two sides, also where their numbers are the same
    dealt = deal(left, "_l", "_r", ("_i", "_j"), False).unionByName(deal(right, "_r", "_l", ("_j", "_i"), True))
    return _grouped(dealt, _groups(counts, F.col("_l") * F.col("_r")), run, schema)


def spots(n: int, m: int, size: int = TILE) -> Iterator[tuple[slice, slice]]:
    for r in range(0, n, size):
        for c in range(0, m, size):
            yield slice(r, min(n, r + size)), slice(c, min(m, c + size))


def scattered(lengths: np.ndarray, flat: np.ndarray, fill=0) -> np.ndarray:
    """Lists of the given lengths, one after the other in flat, as rows; shorter ones end in fill."""
    n = np.maximum(lengths, 0)
    out = np.full((len(n), int(n.max(initial=0)), *flat.shape[1:]), fill, flat.dtype)
    out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def padded(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, ...]:
    """Nested lists of numbers as one array, and the lengths of each level from the outermost in: -1 for null lists, -2 where there is none, -3 less their length for lists of numbers with a null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    inner = column.flatten()
    if pa.types.is_list(inner.type) or pa.types.is_large_list(inner.type):
        dense, *lengths = padded(inner)
        return scattered(size, dense), size, *(scattered(size, x, -2) for x in lengths)
    kept = size.copy()
    if inner.null_count:
        holes = scattered(size, inner.is_null().to_numpy(zero_copy_only=False))
        kept = np.where(holes.any(axis=1), -3 - size, size)
    return scattered(size, pc.fill_null(inner, 0).to_numpy(zero_copy_only=False)), kept


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays with their last axis of one length, zeros at the end."""
    width = max(a.shape[-1], b.shape[-1])
    fit = lambda x: x if x.shape[-1] == width else np.concatenate([x, np.zeros((*x.shape[:-1], width - x.shape[-1]), x.dtype)], axis=-1)
    return fit(a), fit(b)


def forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the graph whose edges are the true cells between its rows and columns."""
    sides = (hit, np.ascontiguousarray(hit.T))
    left = (np.ones(hit.shape[1], bool), np.ones(hit.shape[0], bool))
    rows, cols = [], []
    for root in np.flatnonzero(hit.any(axis=1)):
        if not left[1][root]:
            continue
        left[1][root] = False
        todo = [(0, root)]
        while todo:
            side, at = todo.pop()
            new = np.flatnonzero(sides[side][at] & left[side])
            left[side][new] = False
            (cols, rows)[side].append(new)
            (rows, cols)[side].append(np.full(len(new), at))
            todo.extend((1 - side, x) for x in new)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(rows), join(cols)


def linked(left: np.ndarray, right: np.ndarray, hit: np.ndarray, names: tuple[str, str]) -> pa.RecordBatch:
    """The ids of a spanning forest of hit: fewer links than rows, with the same components as all of them."""
    rows, cols = forest(hit)
    return pa.RecordBatch.from_arrays([pa.array(left[rows]), pa.array(right[cols])], list(names))


def similar(vectors: DataFrame, key: str, id_: str, vector: str, least: float, rows: tuple[int, int] = (2048, 8192)) -> DataFrame:
    """(a_file_id, b_file_id): links with the components of all pairs of different ids of one key whose vectors' inner product is above least.

    Products within rounding of `least` are summed again in the order of the components. Vectors that are null or hold a
    null, and pairs of different lengths, have no product; one that is not a number counts as above.
    """

    def run(a: pa.Table, b: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
        (x, nx), (y, ny) = padded(a.column("v")), padded(b.column("v"))
        x, y = alike(x, y)
        ia, ib = a.column("id").to_numpy(), b.column("id").to_numpy()
        hit = np.zeros((len(x), len(y)), bool)
        for r, c in spots(len(x), len(y), 2048):
            with np.errstate(all="ignore"):
                p = x[r] @ y[c].T
                close = np.nonzero(np.abs(p - least) <= 1e-9 * np.maximum(1, np.abs(p)))
                if len(close[0]):
                    s = np.zeros(len(close[0]))
                    for t in range(x.shape[1]):
                        s += x[r][close[0], t] * y[c][close[1], t]
                    p[close] = s
                hit[r, c] = ~(p <= least) & (nx[r, None] == ny[None, c]) & (nx[r, None] >= 0) & (ia[r, None] != ib[None, c])
        yield linked(ia, ib, hit, ("a_file_id", "b_file_id"))

    rows_ = vectors.select(F.col(key).alias("key"), F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v")).where("id is not null")
    return within(rows_, "key", "id", run, "a_file_id long, b_file_id long", rows)


class Lists:
    """One column of a side: padded lists, or flat ones (sizes, starts, all values) that are never padded; cut by rows."""

    def __init__(self, column: pa.ChunkedArray, flat: bool):
        self.values, self.parts = None, ()
        if flat:
            column = column.combine_chunks()
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.values = pc.fill_null(column.flatten(), 0).to_numpy(zero_copy_only=False)
            kept = np.where(column.is_null().to_numpy(zero_copy_only=False), -1, sizes)
            if column.flatten().null_count:
                kept[np.unique(np.repeat(np.arange(len(sizes)), sizes)[column.flatten().is_null().to_numpy(zero_copy_only=False)])] = -1
            self.parts = (kept, np.cumsum(sizes) - sizes)
        else:
            self.parts = padded(column)

    def __getitem__(self, rows) -> tuple:
        cut = tuple(x[rows] for x in self.parts)
        return cut if self.values is None else (*cut, self.values)


def sides(a: pa.Table, b: pa.Table, parts: dict[str, bool], own: bool) -> tuple:
    """Ids and columns of both sides; rows in the order of their ids if both are one block, so that half its tiles are empty."""
    if own:
        a = b = a.sort_by("file_id")
    load = lambda t: {p: Lists(t.column(p), flat) for p, flat in parts.items()}
    left = load(a)
    return a, b, a.column("file_id").to_numpy(), b.column("file_id").to_numpy(), left, left if own else load(b)


def measured(files: DataFrame, key: str, parts: dict[str, bool], measure: Callable, schema: str) -> DataFrame:
    """a and b, the ids of each pair of one key with the smaller first, and measure(left, right) of their parts, one array for each column of schema.

    parts: columns of lists by name, true for those that are not to be padded. A float that is not a number comes out as null;
    strings may come as their numbers in a list of names, with the list.
    """

    def run(a: pa.Table, b: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
        _, _, ia, ib, left, right = sides(a, b, parts, own)
        for r, c in spots(len(ia), len(ib)):
            x, y = ia[r][:, None], ib[c][None, :]
            keep = x < y if own else x != y
            if not keep.any():
                continue
            found = measure({p: v[r] for p, v in left.items()}, {p: v[c] for p, v in right.items()})
            cut = np.ravel if keep.all() else lambda values, keep=keep: values[keep]
            columns = [pa.array(cut(np.minimum(x, y))), pa.array(cut(np.maximum(x, y)))]
            for values, kind in zip(found.values(), kinds, strict=True):
                values, names = values if isinstance(values, tuple) else (values, None)
                values = cut(values)
                if names is not None:
                    array = pa.array(list(names), pa.string()).take(pa.array(values))
                else:
                    array = pa.array(values, from_pandas=values.dtype.kind == "f") if values.dtype != object else pa.array(values, pa.string())
                columns.append(array.cast(kind))
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", *found])

    arrow = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    kinds = [arrow[c.split()[1]] for c in schema.split(", ")]
    id_ = files.schema["file_id"].dataType.simpleString()
    return within(files.select(key, "file_id", *parts).where("file_id is not null"), key, "file_id", run, f"a {id_}, b {id_}, {schema}")
