"""The whole detection on hand-made files: each option by a case that it decides.

A run of the plan takes half a minute however few its rows; KINSIEVE_SLOW=1 runs every case, else one does.
"""

import os
from dataclasses import fields, replace

import pytest

from kinsieve.operators import blocking, detection
from kinsieve.options import NAMES, Options, read_settings

BASE = Options(sample_frames=6, phash_distance_threshold=8.0, center_inner=2, audio_min_length=1)
slow = pytest.mark.skipif(not os.environ.get("KINSIEVE_SLOW"), reason="many runs of the whole plan; set KINSIEVE_SLOW=1")
SCHEMA = (
    "file_id long, item_id long, duration double, audio string, size long, mtime long, hashes array<array<long>>, frames array<array<double>>, patches array<array<array<double>>>, hist array<double>, words array<long>"
)


def file(file_id, item_id, duration, look=0, audio="a", size=None, **other):
    """A file of six frames; files of one look match, others are far in every hash."""
    word = [0, 2**62 - 1, 0x5555555555555555][look]
    row = {
        "file_id": file_id, "item_id": item_id, "duration": duration, "audio": audio, "size": file_id if size is None else size, "mtime": file_id, "hashes": [[word]] * 6,
        "frames": [[1.0, 0.0]] * 6, "patches": [[[1.0, 0.0]] * 16] * 6, "hist": [1.0, 0.0], "words": [1, 2, 3],
    }
    return tuple((row | other)[c.split()[0]] for c in SCHEMA.split(", "))


def found(spark, rows, o=BASE, splits=None, merges=None):
    pairs = lambda p: None if p is None else spark.createDataFrame(p, "a long, b long")
    out = {}
    for r in sorted(detection.detect(spark.createDataFrame(rows, SCHEMA), o, 4, pairs(splits), pairs(merges)).collect(), key=lambda r: (r.seq, r["rank"])):
        assert r.is_keeper == (r["rank"] == 1)
        out.setdefault(r.group_id, []).append((r.item_id, r.file_id))
    return list(out.values())


# two buckets of one look, 30.0 and 30.5; a third a second further
ROWS = [file(1, 1, 30.0), file(2, 2, 30.1), file(3, 3, 30.5), file(4, 4, 30.6), file(5, 5, 31.5), file(6, 6, 31.5), file(7, 7, 30.0, look=1)]


@slow
def test_buckets_join_across_the_tolerance_only(spark):
    assert found(spark, ROWS) == [[(4, 4), (3, 3), (2, 2), (1, 1)], [(6, 6), (5, 5)]]
    assert found(spark, ROWS, replace(BASE, duration_cross_bucket_tolerance=0.0)) == [[(2, 2), (1, 1)], [(4, 4), (3, 3)], [(6, 6), (5, 5)]]
    assert found(spark, ROWS, replace(BASE, duration_cross_bucket_tolerance=1.0)) == [[(i, i) for i in range(6, 0, -1)]]


@slow
def test_rounding(spark):
    rows = [file(1, 1, 30.1), file(2, 2, 30.4)]
    assert found(spark, rows) == [] and found(spark, rows, replace(BASE, duration_rounding="nearest_1.0")) == [[(2, 2), (1, 1)]]


@slow
def test_cross_mode_by_true_durations(spark):
    # labels a half apart, durations further than the tolerance
    rows = [file(1, 1, 29.76), file(2, 2, 29.77), file(3, 3, 30.74), file(4, 4, 30.73)]
    assert found(spark, rows) == [[(4, 4), (3, 3), (2, 2), (1, 1)]]
    assert found(spark, rows, replace(BASE, cross_mode="duration")) == [[(2, 2), (1, 1)], [(4, 4), (3, 3)]]


@slow
def test_buckets_of_one_item_drop_out_before_the_cross_stage(spark):
    rows = [file(1, 1, 30.0), file(2, 2, 30.0), file(3, 3, 30.5)]
    assert found(spark, rows) == [[(2, 2), (1, 1)]]
    assert found(spark, rows, replace(BASE, prune_before_cross=False)) == [[(3, 3), (2, 2), (1, 1)]]


@slow
def test_clusters_that_share_an_item(spark):
    rows = [file(1, 1, 30.0), file(2, 2, 30.0), file(3, 1, 40.0, look=1), file(4, 4, 40.0, look=1)]
    assert found(spark, rows) == [[(4, 4), (1, 3), (2, 2)]]
    assert found(spark, rows, replace(BASE, merge_by_item=False)) == [[(2, 2), (1, 1)], [(4, 4), (1, 3)]]


@slow
def test_sound_as_a_part_of_the_key(spark):
    both = replace(BASE, require_both_signatures=True)
    rows = [file(1, 1, 30.0), file(2, 2, 30.0), file(3, 3, 30.0, audio="b"), file(4, 4, 30.5, audio="b"), file(5, 5, 30.5, audio=None), file(6, 6, 30.5)]
    assert found(spark, rows) == [[(i, i) for i in range(6, 0, -1)]]
    assert found(spark, rows, both) == [[(6, 6), (2, 2), (1, 1)], [(4, 4), (3, 3)]]


@slow
def test_centre_cells_confirm(spark):
    """A difference that only inner cells show decides the strict confirmation of a rescue."""
    near, off, far = [1.0, 0.0], [0.98, 0.2], [0.0, 1.0]
    ring = [p if i in (0, 1, 2, 3, 4, 7, 8, 11, 12, 13, 14, 15) else near for i, p in enumerate([far] * 4 + [near] * 12)]
    o = replace(BASE, t_mean=1.0, t_max=0.0, t_p90=-1.0, mid_lower=0.0, sparse_mid_count=-1, max_rescue_mean=1.0, max_rescue_corner=0.0, max_rescue_center=1.0, anim_max_override_factor=1e9, patch_min_hot=1, strict_hot_ratio=1.0,
                persistent_max=0, weak_hot_ratio_max=0.0, anim_hot_ratio_min=2.0, heavy_hot_ratio_min=2.0, center_persistent_corner_max=-1.0, center_split_frac=2.0)
    rows = [file(1, 1, 30.0), file(2, 2, 30.0, patches=[ring] * 6, frames=[off] * 6)]
    assert found(spark, rows, replace(o, t_max=1e-6)) == [[(2, 2), (1, 1)]]
    assert found(spark, rows, replace(o, t_max=1e-6, center_inner=4)) == []


@slow
def test_frame_gates_off(spark):
    rows = [file(1, 1, 30.0), file(2, 2, 30.0, frames=[[0.0, 1.0]] * 6)]
    assert found(spark, rows) == [] and found(spark, rows, replace(BASE, frame_gates=False)) == [[(2, 2), (1, 1)]]


def test_settings_of_a_file(tmp_path):
    at = tmp_path / "c.toml"
    at.write_text('semantic_max_threshold = 0.05\nphash_size = 8\nsemantic_patch_grid = 16\nrequire_both_signatures = true\nseek_ratio = 1\nffmpeg_path = "x"\nforce_split_pairs = ["1|2", "3,4", " 5 | 5 ", "6", ["7", 8], 9]\n', encoding="utf-8-sig")
    got = read_settings(at)
    assert got.options == replace(Options(), t_max=0.05, mid_lower=0.025, phash_size=8, patch_grid=16, require_both_signatures=True, seek_ratio=1.0)
    assert type(got.options.seek_ratio) is float and got.raw["ffmpeg_path"] == "x" and got.merges == ()
    assert got.splits == (("1", "2"), ("3", "4"), ("7", "8"))
    assert read_settings(None).options == read_settings(tmp_path / "none.toml").options == Options()
    at.write_text("phash_size = [1]")
    with pytest.raises(TypeError):
        read_settings(at)
    assert set(NAMES) <= {f.name for f in fields(Options)} and len(set(NAMES.values())) == len(NAMES)


@slow
def test_overrides(spark):
    assert found(spark, ROWS, splits=[(1, 4), (5, 1)]) == [[(3, 3), (2, 2), (1, 1)], [(6, 6), (5, 5)]]
    # 7 was never clustered; of an item that nobody knows nothing is merged
    assert found(spark, ROWS, merges=[(7, 5), (1, 99)]) == [[(4, 4), (3, 3), (2, 2), (1, 1)], [(7, 7), (6, 6), (5, 5)]]
    assert found(spark, ROWS, splits=[(1, 4)], merges=[(4, 6)]) == [[(3, 3), (2, 2), (1, 1)], [(6, 6), (5, 5), (4, 4)]]


def test_only_clustered_files_stand_for_an_item(spark):
    rows = [file(1, 1, 30.0), file(2, 2, 30.0), file(9, 1, 30.0, look=1), file(3, 2, 30.5), file(4, 5, 30.5)]
    # file 3 joins nothing new but is the larger file of its item; file 9 matches nothing
    assert found(spark, rows) == [[(5, 4), (2, 3), (1, 1)]]


@slow
def test_unsigned_files_and_none_at_all(spark):
    rows = [file(1, 1, 30.0), file(2, 2, 30.0, hashes=None), file(3, 3, float("nan")), file(4, 4, None), file(5, 5, 30.0, frames=None, patches=None, hist=None, words=None, audio=None)]
    assert found(spark, rows) == [[(5, 5), (1, 1)]] and found(spark, []) == []


@pytest.mark.parametrize("join", ["cross", "duration", "bucket"])
def test_a_hot_cell_is_dealt_on_both_sides(spark, join):
    """Nine of ten files in one cell: no join key of the dealt sides holds more than about a block of either."""
    n, rows = 600, 50
    files = spark.range(n).selectExpr("id file_id", "case when id % 10 < 9 then 30.2 + (id % 2) * 0.5 else 40.0 + id end duration")
    files = blocking.bucketed(files)
    if join == "bucket":
        pairs = blocking.bucket_pairs(files, ["file_id"], rows=rows)
        expected = files.alias("a").join(files.alias("b"), "bucket").where("a.file_id < b.file_id").count()
    elif join == "cross":
        pairs = blocking.cross_bucket_pairs(files, ["file_id"], 0.6, rows)
        expected = 300 * 240
    else:
        pairs = blocking.duration_pairs(files, ["file_id"], 0.6, rows)
        expected = 540 * 539 // 2
    assert pairs.select("a_file_id", "b_file_id").distinct().count() == pairs.count() == expected
    left, right = files.selectExpr("bucket", "file_id a_file_id"), files.selectExpr("bucket", "file_id b_file_id")
    for side in blocking.dealt(left, right, ["bucket"], "a_file_id", "b_file_id", rows):
        assert side.groupBy("bucket", "_i", "_j").count().agg({"count": "max"}).first()[0] <= 2 * rows
        light = side.where("bucket not like '30.%'")
        assert light.count() == light.where("_i = 0 and _j = 0").count() == n // 10
