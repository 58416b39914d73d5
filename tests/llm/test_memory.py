"""What a Python worker holds on to, within a task and after it."""

import gc
import tracemalloc
import weakref

import numpy as np
import pyarrow as pa

from kinsieve.llm import bpe, jaccard, toxicity


def test_sets_keep_no_words(monkeypatch):
    """100,000 distinct words leave nothing behind but the sets of their stretch."""
    monkeypatch.setattr(jaccard, "CHUNK", 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"word{i}x{k}" for k in range(1000)) for i in range(100)])], names=["text"])
    tracemalloc.start()
    try:
        held = [tracemalloc.get_traced_memory()[0] for _ in jaccard.sets_of([batch], 0, 5)]
    finally:
        tracemalloc.stop()
    assert len(held) == 50 and held[-1] - held[0] < 2_000_000, held


def test_caches_of_words_go_with_their_owner():
    words = toxicity.Words(toxicity.Decoder(np.zeros(toxicity.SIZE**3)))
    gone = weakref.ref(words)
    assert list(words.of("some words"))
    gc.disable()
    try:
        del words
        assert gone() is None
    finally:
        gc.enable()


def test_the_codec_keeps_no_tokens_after_a_task(spark):
    docs = spark.range(400).selectExpr("id doc_id", "concat('text number ', id, ' with some words') text").repartition(4)
    assert bpe.encode_documents(docs, *bpe.vocabulary()).agg({"n_tokens": "sum"}).first()[0] > 400

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe.codec(*bpe.vocabulary()).cache)] * batch.num_rows)], names=["n"])

    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {0}
