"""The bounded label sample: the lowest hashes of each label, whatever the labels' sizes."""

from pyspark.sql import functions as F

from kinsieve.llm.learn import sample


def test_lowest_hashes(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, 1).otherwise(0).alias("label"))
    hashed = rows.withColumn("h", F.xxhash64("doc_id")).collect()
    for most in (1, 30, 200, 6000):
        want = {r.doc_id for label in (0, 1) for r in sorted((r for r in hashed if r.label == label), key=lambda r: r.h)[:most]}
        assert {r.doc_id for r in sample(rows, "label", most).collect()} == want
    assert sample(rows.where("false"), "label", 3).collect() == []
