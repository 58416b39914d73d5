"""Streams with timers: leases that run out by themselves, a 429 that stops a job, buckets that wait."""

import time

import pytest
from pyspark.sql import functions as F

from kinsieve.functions.text import lease_token
from kinsieve.streaming import stateful

EVENT = "job string, item_id string, kind string, ok boolean, reason string, token string, size int, position int"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, stateful.ROCKSDB)
    yield spark
    spark.conf.unset(name)


class Run:
    """A running stream over files of rows, and the rows it gave."""

    def __init__(self, spark, folder, schema, build, name, mode):
        self.spark, self.folder, self.schema, self.name = spark, folder, schema, name
        (folder / "in").mkdir()
        stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder / "in")))
        self.query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "cp")).trigger(processingTime="200 milliseconds").start()

    def send(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.json(str(self.folder / "out"), mode="overwrite")
        part = next((self.folder / "out").glob("part-*.json"))
        part.rename(self.folder / "in" / f"{time.time_ns()}.json")

    def until(self, test, seconds=90):
        end = time.time() + seconds
        while time.time() < end:
            if self.query.exception():
                raise self.query.exception()
            rows = [tuple(r) for r in self.spark.table(self.name).collect()]
            if test(rows):
                return rows
            time.sleep(0.3)
        raise AssertionError(rows)


def start(job, item, position=0):
    return (job, item, "start", None, None, None, None, position)


def lease(job, size):
    return (job, None, "lease", None, None, None, size, None)


def ack(job, item, ok, reason=None, token=None):
    return (job, item, "ack", ok, reason, token, None, None)


def test_queue_of_a_job(rocksdb, tmp_path):
    spark = rocksdb
    run = Run(spark, tmp_path, EVENT, lambda e: stateful.job_queue_stream(e, lease=3.0, delay=0.1, keep=3600.0), "job_queue", "update")
    try:
        run.send(start("j", "a", 2), start("j", "b", 1), start("j", "c", 3), start("k", "a", 0), lease("j", 2), lease("k", 1))
        rows = run.until(lambda rows: {("j", "a", "inflight"), ("j", "b", "inflight"), ("k", "a", "inflight")} <= {r[:3] for r in rows})
        assert ("j", "c", "inflight") not in {r[:3] for r in rows}  # two slots, by position
        token = next(r[5] for r in rows if r[:3] == ("j", "b", "inflight"))
        assert token == spark.range(1).select(lease_token(F.lit("j"), F.lit("b"), F.lit(1))).first()[0]
        # nobody says anything more: the leases run out
        rows = run.until(lambda rows: {(*k, "queued", "result_unconfirmed") for k in (("j", "a"), ("j", "b"), ("k", "a"))} <= {(*r[:3], r[6]) for r in rows})
        # a late answer with the old token is ignored, a 429 for another task stops the whole job, the other job goes on
        run.send(ack("j", "b", True, token=token), lease("j", 1), lease("k", 1))
        rows = run.until(lambda rows: any(r[0] == "j" and r[2] == "inflight" and r[1] == "c" for r in rows))
        assert ("j", "b", "success") not in {r[:3] for r in rows}
        run.send(ack("j", "c", False, "http_429"), lease("j", 3), lease("k", 1), ack("k", "a", True))
        rows = run.until(lambda rows: ("k", "a", "success") in {r[:3] for r in rows})
        due = next(r[4] for r in rows if r[:2] == ("j", "c") and r[6] == "http_429")
        assert due > time.time() and sum(r[0] == "j" and r[2] == "inflight" for r in rows) == 3  # a, b, then c: none since
        # a new start ends the cooldown and keeps a success
        run.send(start("j", "d", 0), start("k", "a", 0), lease("j", 5), lease("k", 5))
        rows = run.until(lambda rows: ("j", "d", "inflight") in {r[:3] for r in rows})
        assert {r[1] for r in rows if r[0] == "j" and r[2] == "inflight"} == {"a", "b", "c", "d"} and rows.count(next(r for r in rows if r[:3] == ("k", "a", "success"))) == 1
    finally:
        run.query.stop()


def test_finished_tasks_are_forgotten(rocksdb, tmp_path):
    run = Run(rocksdb, tmp_path, EVENT, lambda e: stateful.job_queue_stream(e, lease=60.0, keep=1.0), "job_done", "update")
    try:
        run.send(start("j", "a"), lease("j", 1), ack("j", "a", True))
        run.until(lambda rows: ("j", "a", "success") in {r[:3] for r in rows})
        time.sleep(2)
        run.send(start("j", "a"), lease("j", 1))
        run.until(lambda rows: sum(r[:3] == ("j", "a", "inflight") for r in rows) >= 1)
    finally:
        run.query.stop()


def test_candidates_wait_for_two_items(rocksdb, tmp_path):
    run = Run(rocksdb, tmp_path, "bucket string, file_id string, item_id string", stateful.candidate_stream, "candidates", "append")
    try:
        run.send(("30", "1", "x"), ("30", "2\t2", "x"), ("31", "3", "y"), ("32", "5", "u"), ("32", "6", "v"))
        rows = run.until(lambda rows: len(rows) == 2)
        assert set(rows) == {("32", "5", "u"), ("32", "6", "v")}
        run.send(("30", "7", "z"), ("32", "8", "u"))
        run.send(("30", "9", "x"))
        rows = run.until(lambda rows: len(rows) == 7)
        assert set(rows) == {("32", "5", "u"), ("32", "6", "v"), ("32", "8", "u"), ("30", "1", "x"), ("30", "2\t2", "x"), ("30", "7", "z"), ("30", "9", "x")}
    finally:
        run.query.stop()
