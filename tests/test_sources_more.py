"""Replies in chunks, models by name, profiles of a configuration, and an index kept by micro-batches."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.functions import embedding
from kinsieve.functions.images import encoded
from kinsieve.operators import catalog
from kinsieve.sources import replies
from kinsieve.streaming import delta


def test_replies_in_chunks(spark, tmp_path):
    at = tmp_path / "replies"
    at.mkdir()
    for i in range(0, 200, 2):
        (at / f"{i}.json").write_text(json.dumps({"result": 1, "banned": 0, "visibility": 0, "title": f"t{i}"}))
    ids = spark.range(200).select(F.col("id").cast("string").alias("item_id"))
    got = replies.asked(ids.union(ids), replies.stored_replies(str(at)))
    assert sorted(r.n for r in got.groupBy("batch").agg(F.count("*").alias("n")).collect()) == [20, 40, 40]
    rows = {r.item_id: (r.result, r.title) for r in replies.complete(got).collect()}
    assert rows == {str(i): (1, f"t{i}") for i in range(0, 200, 2)}
    missing = catalog.delisted(ids, replies.complete(got).withColumn("rank", F.col("rank")))
    assert {r.item_id for r in missing.collect()} == {str(i) for i in range(1, 200, 2)} and {r.reason for r in missing.collect()} == {"api_no_response"}


def test_a_chunk_that_fails_stops_the_rest(spark, tmp_path):
    tried = tmp_path / "tried"
    tried.mkdir()

    def fetch(ids):
        n = len(os.listdir(tried))
        open(tried / f"{ids[0]}-{n}", "w").close()
        if "85" in ids:
            raise OSError("no line")
        if "5" in ids and not any(f.startswith("0-") for f in os.listdir(tried) if f != f"{ids[0]}-{n}"):
            raise OSError("once")
        return [{"item_id": i, "result": 1} for i in ids]

    ids = spark.range(200).select(F.col("id").cast("string").alias("item_id"))
    got = replies.asked(ids, fetch, wait=0.01)
    assert [(r.batch, r.error) for r in got.where("error is not null").collect()] == [(1, "OSError: no line")] and got.where("batch = 0").count() == 80
    assert sum(f.startswith("80-") for f in os.listdir(tried)) == replies.TRIES
    with pytest.raises(Exception, match="1 chunks of the status request failed"):
        replies.complete(got).write.parquet(str(tmp_path / "out"))
    assert not (tmp_path / "out" / "_SUCCESS").exists()
    assert replies.complete(replies.asked(ids.limit(0), fetch)).count() == 0


def test_models_by_name(spark):
    with pytest.raises(ValueError, match="unknown model 'none'; known are colours"):
        embedding.embedded("f", "none")
    frames = np.random.default_rng(1).integers(0, 256, (3, 64, 64, 3), dtype=np.uint8)
    df = spark.createDataFrame([(1, [f.tobytes() for f in frames] + [b"short", None]), (2, [b"x"]), (3, None)], "id int, f array<binary>")
    got = {r.id: r.e for r in df.select("id", embedding.embedded("f", "colours", grid=4).alias("e")).collect()}
    tokens = embedding.Colours().tokens(frames)
    assert tokens.shape == (3, 64, 8) and np.allclose(tokens[0, 9, :3], frames[0, 8:16, 8:16].mean((0, 1)) / 255)
    assert np.allclose(got[1].frames, embedding.normalised(tokens.mean(1)), atol=1e-6) and np.allclose(np.linalg.norm(got[1].patches, axis=2), 1, atol=1e-5)
    own = tokens.reshape(3, 8, 8, 8)[:, 2:4, 4:6].mean((1, 2))
    assert np.allclose(np.array(got[1].patches)[:, 1 * 4 + 2], own / np.linalg.norm(own, axis=1)[:, None], atol=1e-6)
    assert got[2].frames is None and got[2].patches is None and got[3].frames is None


def test_pooling_and_lengths():
    x = np.arange(25.0).reshape(1, 25, 1)
    assert embedding.pooled(x, 5, 5).ravel().tolist() == x.ravel().tolist() == embedding.pooled(x, 5, 9).ravel().tolist()
    assert embedding.pooled(x, 5, 2).ravel().tolist() == [x.reshape(5, 5)[a:b, c:d].mean() for a, b in ((0, 3), (2, 5)) for c, d in ((0, 3), (2, 5))]
    assert embedding.normalised(np.array([[3.0, 4.0], [0.0, 0.0]])).tolist() == [[0.6, 0.8], [0.0, 0.0]]


def test_stored_features(spark):
    f, p = [[1.0, 0.5]], [[[0.25, 1.0], [2.0, 0.0]]]
    got = spark.createDataFrame([(encoded(f), encoded(p)), (b"no", None)], "f binary, p binary").select(embedding.stored("f", "p").alias("e")).collect()
    assert (got[0].e.frames, got[0].e.patches, got[1].e.frames, got[1].e.patches) == (f, p, None, None)


def test_first_profile_with_a_list(spark):
    browser, general = [{"title": "b"}], [{"title": "g"}]
    configs = [
        {"?installdirectory": "x", "a": {"general": {"browser": {"folders": {}}, "wall": 1}}, "b": {"general": {"browser": {"folders": browser}, "folders": general}}, "c": {"general": {"folders": []}}},
        {"z": {"general": {"folders": general}}, "y": [1], "x": None},
        {"a": {"general": []}},
        [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, c in enumerate(configs)] + [(9, "no json"), (10, None)], "id int, config string")
    got = {r.id: r.folders and json.loads(r.folders) for r in catalog.profile_folders(df).collect()}
    assert got == {0: browser, 1: general, 2: None, 3: None, 9: None, 10: None}


UPDATE = "update_id long, id long, props string, status string, local boolean, ispreset boolean, seq long, workshopid string, project string, file string, type string"


def update(n, item, status="installed", kind="Video", folder="myprojects", workshopid=None):
    file = f"D:\\Projects\\{folder}\\{item}\\v.mp4"
    return (n, n, "{}", status, True, False, n, workshopid, None, file, kind)


def test_index_of_changes(spark, tmp_path):
    index = delta.DeltaIndex(spark, str(tmp_path / "index"))
    assert index.revision() == -1 and index.entries().count() == 0
    held = lambda: {(r.item_id, r.key.split("/")[2]): r.revision for r in index.entries().collect()}
    none = spark.createDataFrame([], "id long, props string")
    apply = delta.indexing(index, lambda: none)
    batch = lambda *rows: spark.createDataFrame(list(rows), UPDATE)
    apply(batch(update(1, 10), update(2, 11), update(3, 11, folder="backup"), update(4, 12, kind="scene"), update(5, 13, workshopid="13")), 0)
    assert held() == {("10", "myprojects"): 0, ("11", "myprojects"): 0, ("11", "backup"): 0} and index.revision() == 0
    assert {r.item_id: "myprojects" in r.file for r in index.best().collect()} == {"10": True, "11": True}
    second = batch(update(6, 11, "unsubscribed"), update(7, 14), update(8, 14, "unsubscribed"), update(9, 14))
    apply(second, 1)
    once = held()
    assert once == {("10", "myprojects"): 0, ("11", "backup"): 0, ("14", "myprojects"): 1}
    apply(second, 1)  # again, as after a crash
    apply(batch(update(10, 99, "pending")), 2)  # nothing for the index
    assert held() == once and index.revision() == 1
    index.compact()
    assert set(held()) == set(once) and index.revision() == 1 and len([d for d in os.listdir(index.at) if d.startswith("batch=")]) == 1


def test_index_of_a_stream_that_starts_again(spark, tmp_path):
    index, seen = delta.DeltaIndex(spark, str(tmp_path / "index")), []
    known = tmp_path / "known"
    spark.createDataFrame([(-1, "{}")], "id long, props string").write.parquet(str(known))
    step = delta.indexing(index, lambda: spark.read.parquet(str(known)), lambda kept, batch: seen.append((batch, kept.count())))

    def run():
        stream = spark.readStream.schema(UPDATE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        if q.exception():
            raise q.exception()

    put = lambda *rows: spark.createDataFrame(list(rows), UPDATE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    put(update(1, 10), update(2, 11))
    run()
    put(update(3, 10, "unsubscribed"), update(4, 12))
    run()
    assert {r.item_id for r in index.entries().collect()} == {"11", "12"} and index.revision() == 1 and seen == [(0, 2), (1, 2)]


def test_downloads_with_side_tables(spark):
    calls = spark.createDataFrame([(3406, 7, "1", 1), (3406, 7, "2", 2), (3406, 8, "3", 1), (1, 7, "4", 1)], "callback int, app_id int, item_id string, result int")
    ids, states = spark.createDataFrame([("1",)], "item_id string"), spark.createDataFrame([("1", 13)], "item_id string, state int")
    got = {r.item_id: r for r in delta.downloads(calls, 7, ids, states, spark.createDataFrame([("1", 5, 20), ("2", 5, 0)], "item_id string, done long, total long")).collect()}
    assert set(got) == {"1", "2"} and got["1"].listed and not got["2"].listed and (got["1"].share, got["2"].share) == (0.25, None)
    assert got["1"].state.asDict() == {"subscribed": True, "legacy": False, "installed": True, "needs_update": True, "downloading": False, "waiting": False} and not any(got["2"].state)
