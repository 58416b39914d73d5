"""Truth tables of the score, the patch kinds and the cascade; queue, groups, sources and streams on small rows."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.functions import images, numeric, text, vectors
from kinsieve.operators import blocking, groups, queue, store, verdict
from kinsieve.options import Options
from kinsieve.sources import files
from kinsieve.streaming import queries as streams

O = Options()  # noqa: E741


@pytest.mark.parametrize(
    ("distances", "want"),
    [([], None), ([0.0], None), ([0.0, 9.0], 0.0), ([13.0] * 5, None), ([0.0] * 3 + [41.0] * 3, None), ([0.0] * 3 + [40.0] * 3, None), ([0.0] * 8 + [10.0] * 2, 0.0), ([1.0] * 10, 1.0), ([2.0] * 10, 2.0), ([1.0, None], None)],
)
def test_hash_score(spark, distances, want):
    df = spark.createDataFrame([(distances,)], "d array<double>").select(vectors.hash_score(F.col("d"), O).alias("s"))
    assert df.first().s == want


CLEAN = dict(score=0.5, cd=0.05, audio_dist=None, mean=0.008, max=0.012, p90=0.009, mid=0, above=0, kind="uncertain", corner=0.0, center=0.0, hot_ratio=0.0, dom_q=0.0, c_mean=None, c_max=None, c_p90=None)
RELAXED = dict(max=0.05, mid=3, corner=0.90, center=0.04, hot_ratio=0.12, dom_q=0.28, c_mean=0.006, c_p90=0.009, c_max=0.05)
CASES = [
    ({}, True, "clean"), (dict(score=1.6), False, "phash"), (dict(score=None), False, "phash"), (dict(cd=0.16), False, "color"), (dict(cd=None), True, "clean"), (dict(mean=None, max=None, p90=None), True, "abstain"),
    (dict(mean=0.016), False, "semantic_mean"), (dict(p90=0.005, max=0.2), True, "drift_exempt"), (dict(p90=0.006, max=0.15, mid=2, above=2), True, "drift_exempt"), (dict(p90=0.006, max=0.15, mid=3, above=1), False, "semantic_max"),
    (dict(p90=0.004, kind="content_diff_center_persistent"), False, "drift_center_persistent"), (dict(max=0.05, mid=3, kind="watermark_strong"), True, "max_strong"), (dict(max=0.10, mid=3, kind="watermark_anim"), True, "max_anim"),
    (dict(max=0.11, mid=3, kind="watermark_anim"), False, "semantic_max"), (dict(max=0.05, mid=3, kind="watermark_weak"), False, "semantic_max"), (dict(max=0.05, mid=3, corner=0.80, center=0.05, hot_ratio=0.05, c_mean=0.005, c_max=0.02), True, "max_corner"),
    (RELAXED, True, "max_corner"), (RELAXED | dict(dom_q=0.31), False, "semantic_max"), (dict(mean=0.004, p90=0.006, max=0.016), False, "semantic_peak"), (dict(mean=0.004, p90=0.006, max=0.016, kind="watermark_weak"), True, "peak_watermark"),
    (dict(mean=0.004, p90=0.006, max=0.016, corner=0.65, center=0.10, hot_ratio=0.05, c_mean=0.005, c_max=0.02), True, "peak_corner"), (RELAXED | dict(mean=0.004, p90=0.006, max=0.016, mid=0), False, "semantic_peak"),
    (dict(mean=0.003, p90=0.006, max=0.0149), True, "clean"), (dict(kind="content_diff_heavy", mean=0.006, max=0.012), True, "heavy_degraded"), (dict(kind="content_diff_heavy", mean=0.004, p90=0.006, max=0.012), False, "patch_content"),
    (dict(kind="content_diff_center_persistent"), False, "patch_content"), (dict(kind="content_diff"), True, "clean"),
]


def test_cascade(spark):
    schema = "n int, score double, cd double, audio_dist double, mean double, max double, p90 double, mid int, above int, kind string, corner double, center double, hot_ratio double, dom_q double, c_mean double, c_max double, c_p90 double"
    rows = [(i, *(CLEAN | c).values()) for i, (c, _, _) in enumerate(CASES)]
    got = {r.n: (r.matched, r.gate) for r in verdict.cascade(spark.createDataFrame(rows, schema), O).collect()}
    assert got == {i: (m, g) for i, (_, m, g) in enumerate(CASES)}
    audio = dataclasses.replace(O, audio_merge_override_color=True)
    rows = [(0, *(CLEAN | dict(cd=0.16, audio_dist=0.15)).values()), (1, *(CLEAN | dict(cd=0.16)).values())]
    assert {r.n: r.matched for r in verdict.cascade(spark.createDataFrame(rows, schema), audio).collect()} == {0: True, 1: False}


OUTER = [0, 1, 2, 3, 4, 7, 8, 11, 12, 13, 14, 15]
GRIDS = [
    (10, lambda f, c: False, "uncertain"), (10, lambda f, c: c in (0, 3), "watermark_strong"), (20, lambda f, c: c in OUTER and f // 2 == OUTER.index(c) % 10, "watermark_weak"), (10, lambda f, c: c in OUTER and f < 4, "watermark_anim"),
    (10, lambda f, c: True, "content_diff_heavy"), (10, lambda f, c: c in (5, 6, 9), "content_diff_center_persistent"), (10, lambda f, c: c in (5, 6, 9, 10) and f < 4, "content_diff"), (10, lambda f, c: c in OUTER, "uncertain"),
]


def test_patch_kinds(spark):
    rows = [(i, [[[1.0, 0.0]] * 16] * n, [[[0.0, 1.0] if hot(f, c) else [1.0, 0.0] for c in range(16)] for f in range(n)]) for i, (n, hot, _) in enumerate(GRIDS)]
    got = {r.n: r.kind for r in verdict.patch_stats(spark.createDataFrame(rows, "n int, a array<array<array<double>>>, b array<array<array<double>>>"), "a", "b", 4, O).collect()}
    assert got == {i: kind for i, (_, _, kind) in enumerate(GRIDS)}


def test_buckets(spark):
    df = spark.createDataFrame([(0.25,), (0.75,), (1.25,), (0.5,), (1.5,), (2.5,), (None,), (-1.0,), (float("nan"),), (float("inf"),)], "d double")
    half = [r[0] for r in df.where(numeric.valid_duration(F.col("d"))).select(numeric.nearest_bucket(F.col("d"))).collect()]
    whole = [r[0] for r in df.where(numeric.valid_duration(F.col("d"))).select(numeric.nearest_bucket(F.col("d"), "nearest_1.0")).collect()]
    assert half == ["0.0", "1.0", "1.0", "0.5", "1.5", "2.5"] and whole == ["0", "1", "1", "0", "2", "2"]


def test_a_large_bucket_is_split(spark):
    df = spark.range(40).select(F.col("id").alias("file_id"), F.lit("x").alias("bucket"))
    pairs = blocking.bucket_pairs(df, ["file_id"], rows=7).collect()
    assert len(pairs) == len({(r.a_file_id, r.b_file_id) for r in pairs}) == 40 * 39 // 2


def test_overrides_and_keeper(spark):
    base = groups.item_groups(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "a_item string, b_item string"))
    pairs = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    known = spark.createDataFrame([(x,) for x in "abcxyz"], "item_id string")
    as_sets = lambda df: {frozenset(r[1]) for r in df.groupBy("group_id").agg(F.collect_set("item_id")).collect()}
    split = groups.force_split(base, pairs(("a", "b")))
    assert as_sets(groups.several_items(split)) == {frozenset("ac"), frozenset("xy")}
    merged = groups.force_merge(split, pairs(("a", "b"), ("y", "z"), ("a", "unknown")), known)
    assert as_sets(groups.several_items(merged)) == {frozenset("abc"), frozenset("xyz")}
    rows = [("g", "1", 5, 9), ("g", "mp:x", 5, 9), ("g", "2", 9, 9), ("g", "mp:y", 5, 3), ("g", "0", 5, 9)]
    order = groups.ranked(spark.createDataFrame(rows, "group_id string, item_id string, size long, mtime long")).orderBy("rank").collect()
    assert [r.item_id for r in order] == ["2", "mp:y", "mp:x", "0", "1"]


def test_text(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    for reply, ok in [("1", True), ("true", True), ('{"success":1}', True), ('{"success":true}', True), ('{"success":"1"}', True), ("", False), ("0", False), ("false", False), ('{"success":0}', False), ("<html>login</html>", False)]:
        assert one(text.response_ok(lit(reply))) is ok, reply
    pairs = spark.createDataFrame([(["a|b", "a,b", " b | a ", "a|a", "", "a", "c|b"],)], "p array<string>").select(text.pair_list(F.col("p"))).first()[0]
    assert pairs == [["a", "b"], ["b", "c"]]
    assert one(text.file_uri_path(lit("file:///C:/a%20b%2525.mp4"))) == "/C:/a b%25.mp4" and one(text.file_uri_path(lit("file://srv/share/x+y"))) == "//srv/share/x+y" and one(text.file_uri_path(lit("http://x"))) is None
    assert one(text.set_query(lit("http://h/p?a=1&id=2&a=3#f"), "id", lit("9"))) == "http://h/p?a=3&id=9#f"
    assert one(text.url_id(lit("http://h/p?x=1&id= 12 &id=3"))) == "12" and one(text.url_id(lit("http://h/p"))) == ""
    assert one(text.local_root(lit("D:\\g\\projects\\MyProjects\\abc\\v.mp4"))) == "D:/g/projects/MyProjects/abc"


LOG = [
    ("ok", [("lease", 0, None, None, None), ("ack", 1, True, None, None), ("ack", 2, False, "late", None)], ("success", 1)),
    ("fails", [("lease", 0, None, None, None), ("ack", 1, False, "x", None), ("lease", 20, None, None, None), ("ack", 21, False, "x", None), ("lease", 60, None, None, None), ("ack", 61, None, "x", None)], ("failed", 3)),
    ("stale", [("lease", 0, None, None, "t1"), ("ack", 1, True, None, "other")], ("inflight", 1)),
    ("expired", [("lease", 0, None, None, None), ("lease", 100, None, None, None), ("lease", 106, None, None, None)], ("inflight", 2)),
    ("again", [("lease", 0, None, None, None), ("ack", 1, False, "http_429", None), ("lease", 5, None, None, None)], ("queued", 1)),
]


def events(spark):
    rows = [("j", item, float(at), i, kind, ok, reason, token) for item, log, _ in LOG for i, (kind, at, ok, reason, token) in enumerate(log)]
    return spark.createDataFrame(rows, "job string, item_id string, at double, seq int, kind string, ok boolean, reason string, token string")


def test_queue_fold(spark):
    assert {r.item_id: (r.status, r.attempts) for r in queue.folded(events(spark), ["job", "item_id"]).collect()} == {item: want for item, _, want in LOG}


def test_queue_stream_is_the_batch_fold(spark, tmp_path):
    events(spark).repartition(1).sortWithinPartitions("at", "seq").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stream = streams.queue_stream(spark.readStream.schema(events(spark).schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("update").format("memory").queryName("queue_state").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.item_id: (r.status, r.attempts) for r in spark.table("queue_state").collect()} == {item: want for item, _, want in LOG}


def test_delta(spark):
    current = spark.createDataFrame([(1, '{"a":1,"b":{"c":2}}'), (2, '{"a":1}')], "id long, props string")
    ups = [(10, 1, '{"b":{"c":2}}', "pending"), (11, 2, '{"a":2}', "pending"), (12, 3, '{"a":1}', "pending"), (13, 2, '{"a":1}', "error")]
    fill = [(100 + i, 1000 + i % 30, '{"a":1}', "pending") for i in range(60)]
    df = spark.createDataFrame([(*u, False, False) for u in ups[:1] + ups[1:3] + fill], "update_id long, id long, props string, status string, local boolean, ispreset boolean")
    keep = {r.update_id: r.keep for r in store.changed_updates(df, current).collect()}
    assert keep[10] is False and keep[11] and keep[12] and all(keep[100 + i] for i in range(60))
    few = {r.update_id: r.keep for r in store.changed_updates(df.limit(3), current).collect()}
    assert all(few.values())
    # of several records each must hold it, and none may be a preset
    several = spark.createDataFrame([(i, props, preset) for i in range(60) for props, preset in ((f'{{"a":{i % 3}}}', i == 0), ('{"a":0,"b":1}', False))], "id long, props string, ispreset boolean")
    same = spark.createDataFrame([(i, i, '{"a":0}', "pending", False, False) for i in range(60)], df.schema)
    keep = {r.update_id: r.keep for r in store.changed_updates(same, several).collect()}
    assert keep == {i: i == 0 or i % 3 != 0 for i in range(60)}


def test_sources(spark, tmp_path):
    for name in ("content/12/a.mp4", "content/x/b.mp4", "content/13/c.txt", "local/my/d.WEBM"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1234")
    found = {(r.item_id, r.size) for r in files.videos(spark, f"{tmp_path}/content", f"{tmp_path}/local").collect()}
    assert found == {("12", 4), ("mp:my", 4)}
    for suffix in ("mp4", "mkv", "webm", "avi", "mov", "m4v", "mpg", "MPEG", "flv", "wmv", "gif"):
        (tmp_path / f"content/12/deep.er/v.{suffix}").parent.mkdir(exist_ok=True)
        (tmp_path / f"content/12/deep.er/v.{suffix}").write_bytes(b"12")
    deep = {r.path.rsplit(".", 1)[1] for r in files.videos(spark, f"{tmp_path}/content").where("size = 2").collect()}
    assert deep == {"mp4", "mkv", "webm", "avi", "mov", "m4v", "mpg", "MPEG"}
    (tmp_path / "s.csv").write_text("n,link1,link2\n1,http://k,http://t\n2,http://k,\n")
    assert [r.url for r in files.sheet(spark, f"{tmp_path}/s.csv").collect()] == ["http://t"]
    (tmp_path / "ids.json").write_text('{"wids": ["1", "2"]}')
    assert [r.item_id for r in files.id_file(spark, f"{tmp_path}/ids.json").collect()] == ["1", "2"]
    assert spark.range(1).select(files.fingerprint(F.lit("DURATION=3\nFINGERPRINT=1,-1\n"))["words"]).first()[0] == [1, 0xFFFFFFFF]
    files.write_json(f"{tmp_path}/state.json", {"state": "running"})
    assert files.read_json(f"{tmp_path}/state.json", {}) == {"state": "running"} and files.read_json(f"{tmp_path}/none.json", {"a": 1}) == {"a": 1}


def test_images(spark):
    r = np.random.default_rng(1)
    frame = r.integers(0, 256, (60, 70, 3), np.uint8)
    h = images.phash(frame)
    assert len(h) == 36 and abs(sum(bin(int(c, 16)).count("1") for c in h) - 72) <= 1
    assert images.phash(frame) != images.phash(frame[::-1]) and np.isclose(images.hsv_histogram(frame).sum(), 1)
    df = spark.createDataFrame([([frame.tobytes(), b"bad"], 60, 70), (None, 60, 70)], "f array<binary>, h int, w int")
    rows = df.select(images.visual_features("f", "h", "w").alias("v")).collect()
    assert rows[0].v.phash_parts == [h] and rows[1].v.phash_parts == [] and rows[1].v.color_histogram is None
    x = np.arange(6).reshape(2, 3).tolist()
    assert images.decoded(images.encoded(x), 2) == x and images.decoded(b"123", 2) is None and images.decoded(images.encoded(x) + b"1", 2) is None
