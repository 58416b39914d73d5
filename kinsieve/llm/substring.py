"""Operator 5: removal of word windows that occur anywhere else, by a count-min prefilter and exact grouping.

Each window of `width` words is filed under its minimizer, the least hash of the
ANCHOR-word runs inside it; consecutive windows with the same minimizer are one
run. Equal windows have equal minimizers, so a sketch of the runs' minimizers,
merged from all partitions, overestimates every window's count. The second pass
takes only runs estimated repeated and groups them exactly: by minimizer and
whole content, and, where contents differ, window by window.

Cases: null, empty and shorter texts keep all they have. Windows overlap, so a
document that repeats itself loses words, too; of repeated rows all copies lose
theirs. Rows with equal or null ids are apart unless their texts are equal.
Windows are compared by 128 bits of hashes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sketch
from .common import Cache, dropped, hash64, mixed, read, shingled, written

WIDTH, ANCHOR = 35, 8
#: Words of the texts that are hashed at a time.
CHUNK = 300_000
BASE_A, BASE_B = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` consecutive values, by doubling."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def chunks(batches, column: int):
    """(first row, words of each row, all words' hashes) for stretches of rows of about CHUNK words; rows count from 0 in each batch."""
    cache = Cache(hash64)
    for batch in batches:
        texts = batch.column(column)
        first, rows, n = 0, [], 0
        for i in range(len(texts)):
            text = texts[i].as_py()
            words = text.encode().split() if text else []
            rows.append(words)
            n += len(words)
            if n >= CHUNK or i + 1 == len(texts):
                yield batch, first, rows, np.fromiter(map(cache.__getitem__, chain.from_iterable(rows)), np.uint64, n)
                first, rows, n = i + 1, [], 0


def runs(lengths: np.ndarray, words: np.ndarray, width: int):
    """Runs of windows with one minimizer: first position, length, row, key, whole content's hash, whether windows may repeat inside; and all windows' hashes."""
    none = np.empty(0, np.int64)
    if len(words) < width:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none.astype(bool), none.astype(np.uint64)
    anchor = min(ANCHOR, width)
    reach = width - anchor + 1
    row = np.repeat(np.arange(len(lengths)), lengths)
    valid = row[: len(words) - width + 1] == row[width - 1 :]
    short = shingled(words, anchor, BASE_A)
    least = sliding(short, reach, np.minimum)
    windows = shingled(words, width, BASE_B)
    same = np.r_[False, valid[1:] & valid[:-1] & (least[1:] == least[:-1])]
    starts = np.flatnonzero(valid & ~same)
    ends = np.flatnonzero(valid & ~np.r_[same[1:], False])
    n = ends - starts + 1
    key = least[starts]
    first_of = np.zeros(len(windows), np.int64)
    first_of[starts] = starts
    first_of = np.maximum.accumulate(first_of)
    turned = mixed(windows ^ mixed((np.arange(len(windows)) - first_of).astype(np.uint64)))
    turned[~valid] = 0
    span = mixed(np.add.reduceat(turned, starts) + n.astype(np.uint64)) if len(starts) else key
    # a window can only repeat inside a run if the minimizer stands there twice
    places = np.flatnonzero(sliding(np.r_[np.zeros(reach - 1, np.uint64), np.where(valid, least, np.uint64(0)), np.zeros(reach - 1, np.uint64)], reach, np.maximum) == short)
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, ends + reach)
    inner = hi - lo > 12
    times = np.zeros(len(starts), np.int64)
    for k in range(12):
        at = np.flatnonzero(lo + k < hi)
        times[at] += short[places[lo[at] + k]] == key[at]
    return starts, n, row[starts] if len(starts) else none, key, span, inner | (times > 1), windows


def removed_windows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, h and found (first window, windows, which or null for all) of the documents with repeated windows; docs: doc_id, h, text."""
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = sketch.bits_for(chars / 6 * 2 / (width - min(ANCHOR, width) + 2))

    def sketched(batches):
        def parts():
            for _, _, rows, words in chunks(batches, 0):
                _, _, _, key, span, inner, _ = runs(np.array([len(r) for r in rows]), words, width)
                more = np.flatnonzero(inner)  # two tags, as if two contents were there
                yield np.r_[key, key[more]], np.ones(len(key) + len(more), np.uint8), np.r_[span, span[more] ^ np.uint64(1)]

        yield from sketch.pieces(parts(), bits, TaskContext.get().partitionId())

    texts = docs.select("text")
    repeated = spark.sparkContext.broadcast(sketch.merged(texts.mapInArrow(sketched, sketch.PIECE), bits, texts.rdd.getNumPartitions()))

    def candidates(batches):
        for batch, first, rows, words in chunks(batches, 2):
            lengths = np.array([len(r) for r in rows])
            starts, n, row, key, span, inner, windows = runs(lengths, words, width)
            likely, varied = repeated.value.test(key)
            at = np.flatnonzero(likely)
            if not len(at):
                continue
            full = varied[at] | inner[at]
            counts = np.where(full, n[at], 0)
            picked = np.repeat(starts[at], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(windows[picked].view(np.int64)))
            base = np.cumsum(lengths) - lengths
            take = pa.array(first + row[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array((starts[at] - base[row[at]]).astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(key[at].view(np.int64)), pa.array(span[at].view(np.int64)), lists],
                names=["doc_id", "h", "w0", "n", "key", "span", "windows"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.select("doc_id", "h", "text").mapInArrow(candidates, f"doc_id {kind}, h long, w0 int, n int, key long, span long, windows array<long>"))
    contents = found.groupBy("key", "span").agg(F.count("*").alias("times"), F.first("windows").alias("windows"))
    # a window of very many contents is summed before the shuffle
    inside = contents.where(F.size("windows") > 0).select("key", "span", "times", F.posexplode("windows").alias("i", "window"))
    twice = inside.groupBy("key", "window").agg(F.sum("times").alias("total")).where("total > 1").select("key", "window")
    apart = inside.where("times = 1").join(twice, ["key", "window"]).groupBy("key", "span").agg(F.collect_set("i").alias("which"))
    whole = contents.where("times > 1").select("key", "span", F.lit(None).cast("array<int>").alias("which"))
    marks = found.select("doc_id", "h", "w0", "n", "key", "span").join(whole.unionByName(apart), ["key", "span"])
    out = written(marks.groupBy("doc_id", "h").agg(F.collect_list(F.struct("w0", "n", "which")).alias("found")))
    dropped(found)
    repeated.unpersist()
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row of docs(doc_id, text); with keep_text the kept words as text."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    marks = removed_windows(docs, width)
    joined = docs.alias("d").join(marks.alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.h") == F.col("m.h")), "left").select("d.doc_id", "d.text", "m.found")

    def cut(batches):
        for batch in batches:
            n_words, n_removed, kept, texts = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.encode().split() if text else []
                if found:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for x in found:
                        for a, b in [(x["w0"], x["w0"] + x["n"] + width - 1)] if x["which"] is None else [(x["w0"] + i, x["w0"] + i + width) for i in x["which"]]:
                            edge[a] += 1
                            edge[b] -= 1
                    stay = np.cumsum(edge[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                joint = b" ".join(left)
                kept.append(hashlib.sha256(joint).hexdigest())
                if keep_text:
                    texts.append(joint.decode())
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
