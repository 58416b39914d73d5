"""The thin queries of the learned operators: their columns, folds and thresholds over the whole table, and scores by a plain sum."""

from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.llm import language
from kinsieve.llm.common import read
from kinsieve.llm.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "folds", "held"), [("op2_quality", 5, 0), ("op4_language", 4, 2)])
def test_rows_folds_and_scores(spark, name, folds, held):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count() and len({r.doc_id for r in rows}) == len(rows)
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1
        assert name != "op2_quality" or r.predicted == int(r.score >= 0.3)
    langs = {r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("lang").distinct().collect()}
    assert name != "op4_language" or {r.lang_pred for r in rows} <= langs | {"und"}


def test_held_out_rows_teach_nothing(spark):
    """Other labels in the held-out fold change no score."""
    docs = read(spark, FOLDER, "documents", "doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    models = [language.train(d) for d in (docs, docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang"))))]
    some = docs.orderBy("doc_id").limit(40)
    a, b = ([(r.lang_pred, r.score) for r in language.identified(some, m).orderBy("doc_id").collect()] for m in models)
    assert "xx" not in models[1].languages and [x[0] for x in a] == [x[0] for x in b] and np.allclose([x[1] for x in a], [x[1] for x in b])
