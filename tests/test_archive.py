"""Rules around an archive on small rows; every rule query against its DuckDB twin."""

import hashlib
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from kinsieve.operators import archive, blocking, store
from kinsieve.options import Options, feature_hash
from kinsieve.plans import rules

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(rules.QUERIES))
def test_twin(spark, name):
    con = duckdb.connect()
    for table in ("customer", "supplier", "orders", "lineitem", "events"):
        con.execute(f"create view {table} as select * from read_parquet('{FOLDER}/{table}.parquet')")
    df = rules.QUERIES[name](spark, FOLDER)
    want = con.sql(rules.ORACLE[name]).select(*(f'"{c}"' for c in df.columns)).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want


def test_delete_plan_refuses_all_but_direct_children(spark):
    paths = ["/p/myprojects/1", "/p/myprojects/1/", "/p/MyProjects", "/p/myprojects/1/2", "/myprojects/x/myprojects/3", "/q/1", "", None]
    got = archive.delete_plan(spark.createDataFrame([(p,) for p in paths], "path string")).collect()
    assert {r.path: r.action for r in got} == {"/p/myprojects/1": "delete", "/p/MyProjects": "skip_depth", "/p/myprojects/1/2": "skip_depth", "/myprojects/x/myprojects/3": "skip_depth", "/q/1": "skip_outside", "": "skip_outside"}
    assert len(got) == 6


def test_next_stage(spark):
    cases = [("delisted", "detect", "detect", "archive"), ("delisted", "unsub", "unsub", "detect"), ("folder", "archive", "archive", "unsub"), ("folder", "unsub", "archive", "unsub"), ("folder", "archive", None, "archive"), ("other", "detect", "detect", "detect")]
    got = spark.createDataFrame(cases, "p string, c string, d string, want string").select(archive.next_stage(F.col("p"), F.col("c"), F.col("d")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_protection_needs_every_condition(spark):
    archives = spark.createDataFrame([(1, "C:\\A\\1", True), (2, "/a/2", False), (3, "/a/3", True), (4, "/a/4", True), (5, "/a/5", True)], "id long, file string, verified boolean")
    visible = spark.createDataFrame([(1, "c:/a/1", "installed", True), (2, "/a/2", "installed", True), (3, "/b/3", "installed", True), (4, "/a/4", "pending", True), (5, "/a/5", "installed", None)], "id long, file string, status string, overlaid boolean")
    safe = archive.protected(archives, visible)
    assert [r.id for r in safe.collect()] == [1]
    requests = spark.createDataFrame([(7, 1), (8, 1), (8, 2)], "req_id long, id long")
    assert sorted((r.req_id, r.id) for r in archive.unprotected_requests(requests, safe).collect()) == [(8, 2)]


def test_numbers_run_on_over_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert all(r.k == r.place for r in blocking.numbered(rows, F.col("k")).collect())
    assert blocking.numbered(rows.limit(0), F.col("k")).count() == 0


def test_feature_hashes():
    o = Options()
    plain = '{"color_hist_bins_h": 16, "color_hist_bins_s": 4, "phash_size": 12, "sample_frames": 36, "seek_ratio": 0.5, "video_window_seconds": 15.0, "visual_schema_version": 2}'
    assert feature_hash("visual", o) == hashlib.sha1(plain.encode()).hexdigest()
    assert feature_hash("visual", o, color_hist_bins_h=8) != feature_hash("visual", o) == feature_hash("visual", o, grid=7)
    model = dict(enabled=True, model="m", semantic_sample_frames=30)
    assert feature_hash("patch", o, grid=7, **model) != feature_hash("patch", o, grid=8, **model)
    assert feature_hash("semantic", o, **model) == feature_hash("semantic", o, grid=8, **model)
    with pytest.raises(AttributeError):
        feature_hash("audio", o)


def contained(record, update):
    if isinstance(update, dict) and isinstance(record, dict):
        return all(k in record and contained(record[k], v) for k, v in update.items())
    if isinstance(update, list) and isinstance(record, list):
        return len(update) <= len(record) and all(map(contained, record, update))
    return type(record) in (int, float) and type(update) in (int, float) and record == update or type(record) is type(update) and not isinstance(record, dict | list) and record == update


def test_containment_at_any_depth(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 5:
            return rng.choice([None, True, 0, 1, 1.0, "1", "x", "{\"a\":1}", {}, []])
        return [value(depth - 1) for _ in range(rng.randrange(3))] if kind == 5 else {rng.choice(["a", "b", "a.b", "1:a", "é"]): value(depth - 1) for _ in range(rng.randrange(3))}

    def thinner(x):
        if isinstance(x, dict):
            return {k: thinner(v) for k, v in x.items() if rng.random() < 0.8}
        return [thinner(v) for v in x][: rng.randrange(len(x) + 1)] if isinstance(x, list) else x if rng.random() < 0.95 else "other"

    records = [{"r": value(6), "s": {"t": [{"u": {"v": [value(2), 7]}}]}} for _ in range(150)]
    updates = [thinner(x) if rng.random() < 0.8 else value(5) for x in records]
    assert 20 < sum(map(contained, records, updates)) < 130
    df = spark.createDataFrame([(i, i, json.dumps(u), "pending", False, False) for i, u in enumerate(updates)], "update_id long, id long, props string, status string, local boolean, ispreset boolean")
    current = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id long, props string")
    got = {r.update_id: r.keep for r in store.changed_updates(df, current).collect()}
    assert got == {i: not contained(r, u) for i, (r, u) in enumerate(zip(records, updates, strict=True))}
