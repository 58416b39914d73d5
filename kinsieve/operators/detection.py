"""Near-duplicate detection from signed files to an export, every stage driven by Options.

Buckets, pairs inside them, clusters; pairs of neighbouring buckets, only between what is not joined yet; merging by item,
manual splits and merges, keepers. Pairs are compared in tiles inside a task, which hands on the links that join something,
never every pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense
from ..options import Options
from . import blocking, groups, tiles
from .archive import eligible_signatures
from .components import connected_components
from .scratch import written

#: What the gates compare; true: lists that are never padded.
SIGNS = {"hashes": False, "frames": False, "patches": False, "hist": False, "words": True}
PAIR = ("a_file_id", "b_file_id")


def gates(a: dict, b: dict, o: Options, grid: int) -> np.ndarray:
    """The number in dense.GATES of every pair of two lists of files; what the hashes reject is not compared further."""
    score = dense.hash_stats(a["hashes"], b["hashes"], o)["score"]
    passed = score <= o.phash_distance_threshold
    gate = np.zeros(score.shape, np.int8)
    if not passed.any():
        return gate
    rows, cols = np.flatnonzero(passed.any(axis=1)), np.flatnonzero(passed.any(axis=0))
    cut = lambda side, at: {p: (v[0][at], v[1][at], v[2]) if p == "words" else tuple(x[at] for x in v) for p, v in side.items()}
    if len(rows) < len(score) or len(cols) < score.shape[1]:
        a, b = cut(a, rows), cut(b, cols)
    at = np.ix_(rows, cols)
    (sa, oa, wa), (sb, ob, wb) = a["words"], b["words"]
    m = {"score": score[at], "cd": dense.colours(a["hist"], b["hist"]), "audio_dist": dense.sounds((sa, sb), (oa, ob), (wa, wb), o.audio_min_length)}
    m |= dense.frame_stats(a["frames"], b["frames"], o) | dense.patch_stats(a["patches"], b["patches"], grid, o) | dense.center_stats(a["patches"], b["patches"], grid, o.center_inner)
    if not o.frame_gates:
        m |= {c: np.full(m["score"].shape, np.nan) for c in ("mean", "max", "p90")}
    m["kind"] = dense.patch_kind(m, o) if o.patch_gates else np.full(m["score"].shape, -1, np.int8)
    gate[at] = dense.cascade(m, o)
    return gate


def judged(files: DataFrame, o: Options, grid: int, key: str = "bucket") -> DataFrame:
    """a, b, gate and matched of every pair of one key. files: file_id, key and SIGNS, patches of grid * grid cells."""

    def measure(a: dict, b: dict) -> dict:
        gate = gates(a, b, o, grid)
        return {"gate": (gate, dense.GATES), "matched": dense.MATCHED[gate]}

    return tiles.measured(files, key, SIGNS, measure, "gate string, matched boolean")


def _codes(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Equal values of both as equal numbers, null as -1."""
    both = pa.chunked_array([*a.chunks, *b.chunks], a.type).combine_chunks().dictionary_encode()
    codes = pc.fill_null(both.indices, -1).to_numpy(zero_copy_only=False)
    return codes[: len(a), None], codes[None, len(a) :]


def _links(o: Options, grid: int, allowed: Callable | None = None) -> Callable:
    def run(a: pa.Table, b: pa.Table, own: bool) -> Iterator[pa.RecordBatch]:
        a, b, ia, ib, left, right = tiles.sides(a, b, SIGNS, own)
        hit = (ia[:, None] < ib[None, :]) if own else (ia[:, None] != ib[None, :])
        if allowed is not None:
            hit &= allowed(a, b)
        for r, c in tiles.spots(*hit.shape):
            if hit[r, c].any():
                hit[r, c] &= dense.MATCHED[gates({p: v[r] for p, v in left.items()}, {p: v[c] for p, v in right.items()}, o, grid)]
        yield tiles.linked(ia, ib, hit, PAIR)

    return run


def _pair_schema(files: DataFrame) -> str:
    kind = files.schema["file_id"].dataType.simpleString()
    return f"a_file_id {kind}, b_file_id {kind}"


def links(files: DataFrame, o: Options, grid: int, key: str = "bucket") -> DataFrame:
    """(a_file_id, b_file_id): for each pair of blocks of a key a spanning forest of the pairs that match, with the same components and the same files."""
    return tiles.within(files.select(key, "file_id", *SIGNS).where("file_id is not null"), key, "file_id", _links(o, grid), _pair_schema(files))


def cross_links(files: DataFrame, o: Options, grid: int) -> DataFrame:
    """As links(), of files of different buckets near each other that may join something: not both clustered in one component (joined); with both signatures required, of one sound."""
    extra = ["file_id", "bucket", "duration", "audio", "joined", "clustered"]
    rows = files.select(*extra, *SIGNS).where("file_id is not null")
    by_duration, tolerance, both = o.cross_mode == "duration", o.duration_cross_bucket_tolerance, o.require_both_signatures

    def allowed(a: pa.Table, b: pa.Table) -> np.ndarray:
        x, y = _codes(a.column("joined"), b.column("joined"))
        p, q = (t.column("clustered").to_numpy() for t in (a, b))
        out = ((x != y) & (x >= 0) & (y >= 0)) | ~(p[:, None] & q[None, :])
        if both:
            x, y = _codes(a.column("audio"), b.column("audio"))
            out &= (x == y) & (x >= 0)
        if by_duration:
            x, y = _codes(a.column("bucket"), b.column("bucket"))
            d, e = (t.column("duration").to_numpy() for t in (a, b))
            out &= (x != y) & (np.abs(d[:, None] - e[None, :]) <= tolerance) & (a.column("file_id").to_numpy()[:, None] < b.column("file_id").to_numpy()[None, :])
        return out

    if by_duration:
        cell = F.floor(F.col("duration") / tolerance)
        left, right = rows.withColumn("_key", F.explode(F.array(cell - 1, cell, cell + 1))), rows.withColumn("_key", cell)
    else:
        near = blocking.neighbours(files, tolerance).withColumnRenamed("next_bucket", "_key")
        left, right = rows.join(near, "bucket"), rows.withColumn("_key", F.col("bucket"))
    columns = ["_key", *extra, *SIGNS]
    return tiles.across(left.select(*columns), right.select(*columns), "file_id", _links(o, grid, allowed), _pair_schema(files))


def keyed(files: DataFrame, o: Options) -> DataFrame:
    """Files that may be compared, with bucket and key: the bucket, with both signatures required the digest of the sound, too."""
    own = eligible_signatures(blocking.bucketed(files, o.duration_rounding), o.require_both_signatures)
    audio = F.concat(F.lit("|"), F.col("audio")) if o.require_both_signatures else F.lit("")
    return own.withColumn("key", F.concat(F.col("bucket"), audio))


def matches(files: DataFrame, o: Options, grid: int) -> DataFrame:
    """(a_file_id, b_file_id, a_item_id, b_item_id): links of the pairs that the gates let through, in buckets and across them, written; all files of such pairs and their components, not every pair."""
    own = "item_id" if o.merge_by_item else "file_id"
    item = lambda x: files.select(F.col("file_id").alias(f"{x}_file_id"), F.col("item_id").alias(f"{x}_item_id"))
    named = lambda pairs: written(pairs.join(item("a"), "a_file_id").join(item("b"), "b_file_id").select(*PAIR, "a_item_id", "b_item_id"))
    pool = blocking.candidates(files) if o.prune_before_cross else files
    inside = named(links(pool, o, grid, "key"))
    if o.duration_cross_bucket_tolerance <= 0:
        return inside
    # a pair of clustered files of one component says nothing new
    joined = connected_components(inside, f"a_{own}", f"b_{own}").withColumnsRenamed({"node": own, "component": "joined"})
    clustered = inside.select(F.col("a_file_id").alias("file_id")).union(inside.select("b_file_id")).distinct().withColumn("clustered", F.lit(True))
    open_files = pool.join(joined, own, "left").join(clustered, "file_id", "left").withColumns({"joined": F.coalesce("joined", own), "clustered": F.coalesce("clustered", F.lit(False))})
    return inside.unionByName(named(cross_links(open_files, o, grid)))


def members_of(found: DataFrame, o: Options) -> DataFrame:
    """(group_id, item_id, file_id) of the clusters; with merge_by_item those that share an item are one."""
    ends = found.select(F.col("a_file_id").alias("file_id"), F.col("a_item_id").alias("item_id")).union(found.select("b_file_id", "b_item_id")).distinct()
    own = "item_id" if o.merge_by_item else "file_id"
    clusters = connected_components(found, f"a_{own}", f"b_{own}").withColumnsRenamed({"node": own, "component": "group_id"})
    return ends.join(clusters, own).select(F.col("group_id").cast("string").alias("group_id"), "item_id", "file_id")


def detect(files: DataFrame, o: Options, grid: int, splits: DataFrame | None = None, merges: DataFrame | None = None) -> DataFrame:
    """(seq, group_id, rank, is_keeper, item_id, file_id): groups of two items or more in keeper order, each item by its largest file.

    files: file_id, item_id, duration, audio (digest), size, mtime and SIGNS. splits and merges: pairs (a, b) of items.
    Files without a valid duration, hashes or, if both signatures are required, sound take no part; a null or
    empty part only abstains. Repeated file ids are not allowed.
    """
    signed = written(keyed(files, o))
    found = matches(signed, o, grid)
    members = members_of(found, o)
    if splits is not None:
        members = groups.force_split(members, splits)
    if merges is not None:
        members = groups.force_merge(members, merges, signed)
    # of an item that a merge pulled in every file counts
    every = signed.select("item_id", F.col("file_id").alias("any_file"))
    members = members.join(every, "item_id").where("file_id is null or file_id = any_file").select("group_id", "item_id", F.col("any_file").alias("file_id"))
    rows = members.join(signed.select("file_id", "size", "mtime"), "file_id")
    best = groups.best_files(rows, ["group_id", "item_id"], "file_id")
    out = groups.export_links(groups.ranked(groups.several_items(best)), F.struct("is_keeper", "item_id", "file_id"))
    return out.select("seq", "group_id", F.col("rank").cast("long").alias("rank"), "link.is_keeper", "link.item_id", "link.file_id")
