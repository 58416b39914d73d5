"""Merging batches of one kind of feature into a stored table."""

import os

import pytest
from pyspark.sql import functions as F

from kinsieve.operators.features import FeatureTable
from kinsieve.options import Options, feature_hash

KINDS = {"duration": "duration double", "visual": "parts array<string>, visual_hash string", "audio": "words array<long>, audio_hash string"}
ABOUT = "path string, size long, mtime long, item_id string, url string, updated long"


@pytest.fixture
def table(spark, tmp_path):
    return FeatureTable(spark, str(tmp_path / "features"), KINDS, buckets=8)


def batch(spark, kind, *rows):
    """Rows (path, size, updated, values...)."""
    return spark.createDataFrame([(p, size, 0, p[:1], f"u/{p}", updated, *values) for p, size, updated, *values in rows], f"{ABOUT}, {KINDS[kind]}")


def stored(table):
    return {r.path: (r.size, r.updated, r.duration, r.parts, r.visual_hash, r.words, r.audio_hash) for r in table.rows().collect()}


def times(table):
    return {d: max(os.stat(os.path.join(table.at, d, f)).st_mtime_ns for f in os.listdir(os.path.join(table.at, d))) for d in os.listdir(table.at) if d.startswith("bucket=")}


def test_a_batch_touches_its_own_columns_and_buckets(spark, table):
    table.merge("visual", batch(spark, "visual", *((f"p{i}", 10, 1, ["h"], "v1") for i in range(40))))
    before = times(table)
    n = table.merge("audio", batch(spark, "audio", ("p1", 11, 2, [1, 2], "a1"), ("new", 5, 2, None, "a1")))
    got = stored(table)
    assert len(got) == 41 and got["p1"] == (11, 2, None, ["h"], "v1", [1, 2], "a1") and got["p2"] == (10, 1, None, ["h"], "v1", None, None)
    assert got["new"] == (5, 2, None, None, None, None, "a1")
    changed = {d for d, t in times(table).items() if before.get(d) != t}
    assert n == len(changed) <= 2 and len(before) > 4


def test_last_of_a_path_wins_and_again_is_the_same(spark, table):
    rows = batch(spark, "duration", ("a", 1, 5, 2.0), ("a", 1, 7, 3.0), ("a", 1, 6, 4.0), ("b", 1, 1, None))
    table.merge("duration", rows)
    once = stored(table)
    assert once["a"][1:3] == (7, 3.0) and once["b"][2] is None
    table.merge("duration", rows)
    assert stored(table) == once


def test_mirrored_rows(spark, table):
    table.merge("visual", batch(spark, "visual", ("w/1", 10, 1, ["h"], "v1"), ("w/2", 20, 1, ["k"], "v1")))
    table.merge("audio", batch(spark, "audio", ("m/1", 10, 1, [9], "old")))
    pairs = spark.createDataFrame([("w/1", "m/1", 10, 3, "mp:1", "u", 4), ("w/2", "m/2", 21, 3, "mp:2", "u", 4), ("none", "m/3", 1, 3, "mp:3", "u", 4), ("w/1", "w/1", 10, 3, "x", "u", 4)], f"source string, {ABOUT}")
    table.mirror(pairs)
    got = stored(table)
    assert got["m/1"] == (10, 4, None, ["h"], "v1", None, None) and set(got) == {"w/1", "w/2", "m/1"} and got["w/1"][1] == 1


def test_lookup_by_size_and_settings(spark, table):
    own, other = feature_hash("visual", Options()), feature_hash("visual", Options(phash_size=8))
    assert own != other
    table.merge("visual", batch(spark, "visual", ("a", 1, 1, ["h"], own), ("b", 1, 1, ["h"], other)))
    files = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 1)], "path string, size long")
    known = lambda kind, wanted=None: {(r.path, r.size) for r in table.looked_up(files, kind, wanted).collect() if r.known}
    assert known("visual", own) == {("a", 1)} and known("visual", other) == {("b", 1)}
    assert known("duration") == {("a", 1), ("b", 1)}


def test_nothing_to_merge(spark, table):
    assert table.merge("audio", batch(spark, "audio")) == 0 and table.rows().count() == 0 and not os.path.exists(table.at)


def test_a_run_computes_what_is_missing(spark, table):
    asked = []

    def compute(files):
        asked.append({r.path for r in files.collect()})
        if broken and len(asked) > 1:
            raise RuntimeError("executors lost")
        return files.select("*", F.array("path").alias("parts"), F.when(F.col("size") == 13, "no_frames").alias("error"))

    def listing(*rows):
        return spark.createDataFrame([(p, size, 0, p, "u", updated) for p, size, updated in rows], ABOUT)

    broken = True
    files = [(f"p{i}", 10, 1) for i in range(30)] + [("bad", 13, 1), (None, 1, 1), ("p1", 9, 0)]
    with pytest.raises(RuntimeError):
        table.fill(listing(*files), "visual", compute, "v1", pieces=3)
    first = set(stored(table))
    assert 0 < len(first) < 30 and first <= asked[0]
    broken, asked[:] = False, []
    done, failed = table.fill(listing(*files), "visual", compute, "v1", pieces=3)
    assert set().union(*asked) == ({f"p{i}" for i in range(30)} | {"bad"}) - first
    assert (done + len(first), failed) == (30, 1)
    # nothing is left but what failed; other sizes and settings are made anew
    asked[:] = []
    assert table.fill(listing(*files), "visual", compute, "v1", pieces=3) == (0, 1) and set().union(*asked) == {"bad"}
    assert table.fill(listing(("p1", 11, 2), ("p2", 10, 2), ("bad", 14, 2)), "visual", compute, "v1") == (2, 0) and asked[-1] == {"p1", "bad"}
    assert table.fill(listing(("p2", 10, 3)), "visual", compute, "v2") == (1, 0)
    got = stored(table)
    assert got["p1"][:2] == (11, 2) and got["p2"][4] == "v2" and got["p3"][3] == ["p3"] and len(got) == 31
    assert table.fill(listing(), "visual", compute, "v1") == (0, 0)


def test_a_listing_is_worked_out_once(spark, table, tmp_path):
    """Not again for each piece."""
    (tmp_path / "seen").mkdir()
    at = str(tmp_path / "seen")

    def look(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                with open(os.path.join(at, path), "a") as f:
                    f.write("x")
            yield b

    files = spark.createDataFrame([(f"p{i}", 10, 0, "i", "u", 1) for i in range(20)], ABOUT).mapInArrow(look, ABOUT)
    compute = lambda rows: rows.select("*", F.array("path").alias("parts"), F.lit(None).cast("string").alias("error"))
    assert table.fill(files, "visual", compute, "v1", pieces=4) == (20, 0)
    assert {os.path.getsize(os.path.join(at, f"p{i}")) for i in range(20)} == {1}
