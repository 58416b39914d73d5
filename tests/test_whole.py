"""Queries return all of their result, not a part of it."""

import json

import __spark_entry__
import duckdb
import pytest

from kinsieve.operators import catalog, groups
from kinsieve.plans import media, records

FOLDER = "/root/testdata/sf0.001"


def test_export_holds_every_link(spark):
    want = {}
    for r in sorted(media.keeper_order(spark, FOLDER).collect(), key=lambda r: r["rank"]):
        want.setdefault(r.group_id, []).append(r.item_id)
    got = {}
    for r in sorted(media.export_rows(spark, FOLDER).collect(), key=lambda r: (r.seq, r["rank"])):
        got.setdefault(r.group_id, []).append(r.link)
    assert got == want and list(got) == sorted(want) and max(map(len, want.values())) > 3
    wide = groups.export_wide(groups.export_rows(groups.ranked(media.order_files(spark, FOLDER)), "item_id"))
    assert {r.group_id: [x for x in list(r)[1:] if x is not None] for r in wide.collect()} == want
    assert groups.export_wide(spark.createDataFrame([], "group_id long, links array<long>")).columns == ["group_id"]


def test_folders_of_any_depth(spark):
    chain = [(k, k - 1 if k else None, f"f{k}") for k in range(40)]
    folders = spark.createDataFrame([*chain, (100, 0, "side"), (101, None, "root")], "folder_id long, parent_id long, title string")
    paths = {r.folder_id: r.path for r in catalog.folder_paths(folders).collect()}
    assert paths == {k: "/".join(f"f{i}" for i in range(k + 1)) for k in range(40)} | {100: "f0/side", 101: "root"}
    with pytest.raises(ValueError, match="deeper"):
        catalog.folder_paths(folders, depth=5)


def test_json_folders_below_the_depth_are_no_secret(spark):
    def tree(levels):
        return {"title": "f", "items": {"7": 1}, "subfolders": [tree(levels - 1)] if levels > 1 else []}

    flat = lambda levels: catalog.flattened(spark, spark.createDataFrame([(json.dumps([tree(levels)]),)], "tree string"), depth=4)
    assert flat(4).collect()[-1]["items"] == {"7": 1} and flat(4).count() == 4
    with pytest.raises(Exception, match="deeper than 4"):
        flat(5).collect()
    with pytest.raises(Exception, match="deeper than 4"):
        flat(5).count()


def test_folder_counts_build_no_collection(spark):
    plan = records.folder_counts(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "parse_json" not in plan
    twin = duckdb.connect()
    for table in ("region", "nation", "customer", "orders"):
        twin.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert sorted(map(tuple, records.folder_counts(spark, FOLDER).collect())) == sorted(twin.execute(records.ORACLE["folder_counts"]).fetchall())


def test_job_identity_collects_ids_once(spark):
    def run():
        return records.job_identity(spark, FOLDER)

    plan = run()._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [event_type" in plan.split("collect_list")[1] and "user_id" in plan.split("collect_list")[1].split("Aggregate [event_type")[1].split("]")[0]
    twin = duckdb.connect()
    twin.execute(f"create view events as select * from '{FOLDER}/events.parquet'")
    assert sorted(map(tuple, run().collect())) == sorted(twin.execute(records.ORACLE["job_identity"]).fetchall())


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in __spark_entry__.oracle_sql().values())
