"""Count-min sketches of 64-bit keys, merged from partitions and broadcast as bitmaps of bounded size.

One or two hash rows of 2^bits cells. A partition sends, for each block of
cells, its nonempty cells with a count (up to 2) and, if the keys have tags,
those of row 0; blocks are merged in a tree of bounded fan-in. Kept of the
merged sketch are bitmaps: cells counted twice or more (each row), and cells of
row 0 that saw two different tags. A key's estimate is the least of its rows'
counts, so it is never below the truth. The width follows the input up to a
bound; beyond it more keys are estimated repeated, and nothing is lost.

Heavy keys, which a partition may send with their counts, are summed on the way;
the most frequent MAX_HEAVY are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed

MIN_BITS, MAX_BITS, BLOCK_BITS, FAN_IN, MAX_HEAVY, HEAVY = 16, 27, 16, 256, 65_536, -1
SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
PIECE = "row int, block int, part long, cells binary, counts binary, tags binary"
MERGED = "row int, block int, repeated binary, varied binary"


def bits_for(keys: float, most: int = MAX_BITS) -> int:
    """Width for about that many keys: four to eight cells each, within bounds."""
    return int(min(most, max(MIN_BITS, np.ceil(np.log2(max(1.0, 4 * keys))))))


def cells_of(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mixed(keys ^ SEEDS[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _tagged(cells: np.ndarray, counts: np.ndarray, tags: np.ndarray):
    """One entry for each cell and tag, at most two of a cell, counts up to 2."""
    order = np.lexsort((tags, cells))
    cells, counts, tags = cells[order], counts[order], tags[order]
    at = np.flatnonzero(np.r_[True, (cells[1:] != cells[:-1]) | (tags[1:] != tags[:-1])]) if len(cells) else np.empty(0, np.int64)
    counts = np.minimum(np.add.reduceat(counts.astype(np.uint32), at), 2).astype(np.uint8) if len(at) else counts[:0]
    cells, tags = cells[at], tags[at]
    kept = np.r_[True, True, cells[2:] != cells[:-2]][: len(cells)]
    return cells[kept], counts[kept], tags[kept]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["row", "block", "part", "cells", "counts", "tags"])


def pieces(parts, bits: int, part: int, rows: int = 2, heavy: dict[int, int] | None = None):
    """Record batches of a partition's sketch; parts yields (keys, weights 1 or 2, tags or None). heavy is read at the end."""
    found = [[] for _ in range(rows)]
    for keys, weights, tags in parts:
        for row in range(rows):
            cells = cells_of(keys, row, bits)
            found[row].append(_tagged(cells, weights, tags) if row == 0 and tags is not None else np.sort(np.r_[cells, cells[weights > 1]]))
    for row, own in enumerate(found):
        if not own:
            continue
        if isinstance(own[0], tuple):
            cells, counts, tags = _tagged(*(np.concatenate(x) for x in zip(*own, strict=True)))
        else:
            every = np.concatenate(own)
            own.clear()
            every.sort()
            at = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
            cells, counts, tags = every[at], np.minimum(np.diff(np.r_[at, len(every)]), 2).astype(np.uint8), None
        block = cells >> np.uint32(BLOCK_BITS)
        cuts = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(cells)] if len(cells) else np.zeros(1, np.int64)
        low = (cells & np.uint32(2**BLOCK_BITS - 1)).astype("<u2")
        for i in range(0, len(cuts) - 1, 512):
            spans = [slice(a, b) for a, b in zip(cuts[i : i + 512], cuts[i + 1 : i + 513], strict=False)]
            yield _batch([(row, int(block[s.start]), part, low[s].tobytes(), counts[s].tobytes(), b"" if tags is None else tags[s].tobytes()) for s in spans])
    if heavy:
        keys, counts = np.fromiter(heavy, np.uint64, len(heavy)), np.fromiter(heavy.values(), np.int64, len(heavy))
        blocks = keys % np.uint64(16)
        yield _batch([(HEAVY, b, part, keys[blocks == b].tobytes(), counts[blocks == b].tobytes(), b"") for b in range(16)])


def _read(table: pa.Table):
    """(row, block, part, cells, counts, tags or None) of one group's pieces, summed."""
    row, block, part = (table.column(c)[0].as_py() for c in ("row", "block", "part"))
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    if row == HEAVY:
        keys, at = np.unique(join("cells", np.uint64), return_inverse=True)
        counts = np.bincount(at, join("counts", np.int64), len(keys)).astype(np.int64)
        top = np.lexsort((keys, -counts))[:MAX_HEAVY]
        return row, block, part, keys[top], counts[top], None
    cells, counts, tags = join("cells", "<u2").astype(np.uint32), join("counts", np.uint8), join("tags", np.uint64)
    if len(tags):
        return row, block, part, *_tagged(cells, counts, tags)
    total = np.bincount(cells, counts, 2**BLOCK_BITS)
    cells = np.flatnonzero(total).astype(np.uint32)
    return row, block, part, cells, np.minimum(total[cells], 2).astype(np.uint8), None


def _merge(table: pa.Table) -> pa.Table:
    row, block, part, cells, counts, tags = _read(table)
    return pa.Table.from_batches([_batch([(row, block, part, (cells if row == HEAVY else cells.astype("<u2")).tobytes(), counts.tobytes(), b"" if tags is None else tags.tobytes())])])


def _bitmaps(table: pa.Table) -> pa.Table:
    row, block, _, cells, counts, tags = _read(table)
    if row == HEAVY:
        first, second = cells.tobytes(), counts.tobytes()
    else:
        size = 2**BLOCK_BITS
        pack = lambda x: np.packbits(x >= 2, bitorder="little").tobytes()
        first, second = pack(np.bincount(cells, counts, size)), pack(np.bincount(cells, minlength=size)) if tags is not None else b""
    return pa.table({"row": pa.array([row], pa.int32()), "block": pa.array([block], pa.int32()), "repeated": pa.array([first], pa.binary()), "varied": pa.array([second], pa.binary())})


class Repeated:
    """Tests keys against the merged sketch: a bitmap of 2^bits / 8 bytes for each row, and one for tags."""

    def __init__(self, bits: int, merged):
        self.bits, self.maps, self.varied = bits, {}, None
        size, whole = 2**BLOCK_BITS // 8, max(2**BLOCK_BITS, 2**bits) // 8
        heavy = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        for r in merged:
            if r["row"] == HEAVY:
                heavy.append((np.frombuffer(r["repeated"], np.uint64), np.frombuffer(r["varied"], np.int64)))
                continue
            at = slice(r["block"] * size, r["block"] * size + size)
            self.maps.setdefault(r["row"], np.zeros(whole, np.uint8))[at] = np.frombuffer(r["repeated"], np.uint8)
            if r["varied"]:
                self.varied = np.zeros(whole, np.uint8) if self.varied is None else self.varied
                self.varied[at] = np.frombuffer(r["varied"], np.uint8)
        keys, counts = (np.concatenate(x) for x in zip(*heavy, strict=True))
        top = np.lexsort((keys, -counts))[:MAX_HEAVY]
        #: Heavy keys, the most frequent first.
        self.heavy = keys[top]

    @staticmethod
    def _bit(bitmap: np.ndarray | None, cells: np.ndarray) -> np.ndarray:
        if bitmap is None:
            return np.zeros(len(cells), bool)
        return (bitmap[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8)) & np.uint8(1) != 0

    def test(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated twice or more, several tags possible) of each key."""
        first = cells_of(keys, 0, self.bits)
        repeated, varied = self._bit(self.maps.get(0), first), np.zeros(len(keys), bool)
        at = np.flatnonzero(repeated)
        if 1 in self.maps:
            repeated[at] = self._bit(self.maps[1], cells_of(keys[at], 1, self.bits))
        varied[at] = self._bit(self.varied, first[at])
        return repeated, varied


def merged(sketches: DataFrame, bits: int, partitions: int) -> Repeated:
    """sketches: rows of PIECE from that many partitions."""
    while partitions > FAN_IN:
        sketches = sketches.withColumn("part", (F.col("part") / FAN_IN).cast("long")).groupBy("row", "block", "part").applyInArrow(_merge, PIECE)
        partitions = -(-partitions // FAN_IN)
    return Repeated(bits, sketches.groupBy("row", "block").applyInArrow(_bitmaps, MERGED).toLocalIterator())
