"""Rules and sources that no other test holds, each on a few rows."""

import json

import pytest
from pyspark.sql import functions as F

from kinsieve.functions import numeric, text
from kinsieve.operators import archive, catalog, groups
from kinsieve.sources import files


def column(spark, values, rule, kind="string"):
    """rule of each value, in order."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


def test_lenient_casts(spark):
    assert column(spark, [" 7 ", "x", None, "-3"], lambda x: numeric.lenient_int(x, 9)) == [7, 9, 9, -3]
    assert column(spark, [" 1.5 ", "1e2", "x", None], lambda x: numeric.lenient_float(x, 0.5)) == [1.5, 100.0, 0.5, 0.5]
    assert column(spark, [" YES ", "on", "1", "True", "y", "0", "no", "", None], lambda x: numeric.lenient_bool(x, True)) == [True] * 5 + [False] * 3 + [True]


def test_error_boxes(spark):
    pages = [
        '<div class="error">', '<p id="x" class="a error_ctn b">', "<DIV CLASS='x error'>", '<div id="error_box">', '<div class="errors">', '<div class="no-error">', '<div id="error_box2">', "class=\"error\"", None,
        '<div data-x="1" class="pagecontent"><i class="error small">',
    ]
    assert column(spark, pages, text.has_error_box) == [True, True, True, True, False, False, False, False, False, True]
    rule = lambda html: text.is_gone(F.lit("t"), F.lit("x" * 300), F.lit(True), html)
    assert column(spark, pages[:5], rule) == [True, True, True, True, False]


def test_folder_entries_of_a_plan(spark):
    entries = spark.createDataFrame([("f", "1"), ("g", "2")], "folder_id string, key string")
    plan = spark.createDataFrame([("1", "skip"), ("2", "copy"), ("2", "copy"), ("3", "warn"), (None, "copy")], "item_id string, action string")
    assert sorted(map(tuple, catalog.with_entries(entries, plan, "f").collect())) == [("f", "1"), ("f", "2"), ("g", "2")]


def test_outcomes_and_sources(spark):
    args = [F.lit(True), F.lit(False), F.lit(200), F.lit(True), F.lit("subscribed"), F.lit("not_subscribed"), F.lit(True)]
    assert column(spark, [0, 3], lambda n: archive.removal_outcome(*args, n)["reason"], "int") == ["exhausted", None]
    assert column(spark, [0], lambda n: archive.removal_outcome(F.lit(False), *args[1:], n)["reason"], "int") == ["no_sessionid"]
    updates = spark.createDataFrame([(1, 5, "installed", False, False)], "batch int, id int, status string, local boolean, ispreset boolean")
    none = spark.createDataFrame([], "id int")
    assert [archive.outside_visible(updates, none, source=s).first().outside for s in ("installed", "workshop", "author")] == [True, True, False]


def test_small_files(spark, tmp_path):
    names = spark.createDataFrame([("10",), ("9",), ("x1",), ("99999999999999999999",)], "name string")
    assert [r.name for r in files.numbered(names, "name").collect()] == ["9", "10", "99999999999999999999"]
    stamped = spark.createDataFrame([("a", 1), ("c", 3), ("b", 3)], "path string, mtime int")
    assert files.latest(stamped).first().path == "c" and files.latest(stamped.limit(0)).first().path is None
    found = spark.createDataFrame([("2", "banned"), ("1", "not_found")], "item_id string, reason string")
    assert json.loads(files.detection_summary(found, 7).first().json) == {"total_subscribed": 7, "delisted_count": 2, "items": [{"item_id": "1", "reason": "not_found"}, {"item_id": "2", "reason": "banned"}]}
    assert [r.url for r in files.url_list(found.orderBy("item_id"), "http://h/?id=").collect()] == ["http://h/?id=1", "http://h/?id=2"]
    assert column(spark, ['﻿{"file": "a.mp4"}', '{"file": "b"}', "{}", "no"], files.project_file) == ["a.mp4", "b", None, None]


def test_incomplete_batches_stop_a_run(spark):
    ok = lambda *flags: catalog.require_complete(spark.createDataFrame([(f,) for f in flags], "ok boolean"))
    assert ok(True, True).first().state == ok().first().state == "complete"
    for flags in ((True, False), (None,)):
        with pytest.raises(Exception, match="a batch of the status request failed"):
            ok(*flags).collect()


def test_entries_of_folders_and_manifests(spark):
    folders = spark.createDataFrame([("a", {"7": 1, "/x/y.mp4": 1}), ("a/b", {"7": 2}), ("c", None)], "path string, items map<string,int>")
    assert sorted(r.path for r in catalog.with_item(folders, "7").collect()) == ["a", "a/b"] and catalog.with_item(folders, "8").count() == 0
    assert sorted(map(tuple, catalog.folder_ids(folders).collect())) == [("a", "7"), ("a/b", "7")]
    entries = spark.createDataFrame([("a", "7"), ("a", "7"), ("b", "7"), (None, "7"), ("b", None), ("c", "8")], "path string, key string")
    wanted = spark.createDataFrame([("7",), ("7",), (None,), ("9",)], "key string")
    assert sorted((r.key, str(r.path)) for r in catalog.in_folders(entries, wanted).collect()) == [("7", "None"), ("7", "a"), ("7", "b")]
    rel = "projects/backup/7/"
    rows = [("7", rel + "a.mp4"), ("8", rel + "A.MP4"), ("x", rel + "b.mp4"), (None, rel + "c.mp4"), ("7", None), ("7", rel + "../d.mp4"), ("7", "projects/other/7/e.mp4"), ("7", rel + "f..mp4")]
    assert sorted(map(tuple, catalog.safe_manifest(spark.createDataFrame(rows, "item_id string, rel string")).collect())) == [("7", rel + "a.mp4"), ("7", rel + "f..mp4")]


def test_targets_of_a_sheet(spark):
    sheet = spark.createDataFrame([(["keep", "x", None, "y"],), (["alone"],), ([],), (None,)], "links array<string>")
    assert [r.url for r in groups.targets_of(sheet).collect()] == ["x", "y"]
