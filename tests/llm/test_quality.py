import random

import numpy as np
import pytest

from kinsieve.llm import quality as ql
from kinsieve.llm.common import fold


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(6)
    words = [f"{a}{b}" for a in ("ban", "tor", "mil", "ser", "gol", "é") for b in ("der", "ing", "ate", "on", "ely", "ish")]
    docs, labels = [], []
    for i in range(900):
        text = r.choices(words, k=r.randrange(10, 80))
        good = i % 3 > 0
        if not good:
            text = [w + r.choice(["&&&", "###"]) for w in text] if i % 2 else [w for w in text for _ in range(5)] if i % 4 else " | ".join(text).split()
        docs.append((i, " ".join(text), len(text)))
        labels.append((i, int(good)))
    return spark.createDataFrame(docs, "doc_id long, text string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int"), dict(labels)


@pytest.fixture(scope="module")
def model(data):
    return ql.train(data[0], data[1])


def test_sum_of_squares_is_the_sum_over_pairs(model):
    r = np.random.default_rng(1)
    bucket, share = r.choice(ql.BUCKETS, 7, replace=False), r.random(7)
    stats = r.random((1, len(ql.STATISTICS)))
    ids, x = np.r_[bucket, model.binned(stats)[0]], np.r_[share, np.ones(len(ql.STATISTICS))]
    want = model.bias + model.linear[ids] @ x + sum(model.factors[a] @ model.factors[b] * p * q for i, (a, p) in enumerate(zip(ids, x)) for b, q in list(zip(ids, x))[:i])
    assert np.allclose(model.margins(bucket, share, np.zeros(7, int), stats), want)


def test_held_out_accuracy(data, model):
    docs, _, labels = data
    rows = ql.scored(docs.where(fold("doc_id", 5) == 0), model).collect()
    assert len(rows) > 120 and np.mean([(r.score >= ql.THRESHOLD) == labels[r.doc_id] for r in rows]) > 0.95


def test_odd_rows(spark, data, model):
    rows = [(1, None, None, 0.5), (2, "", 0, 0.5), (3, "x " * 60_000, -4, None), (3, "x " * 60_000, -4, None), (None, "\n\n", 10**12, 0.1)]
    got = ql.scored(spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score double"), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert ql.scored(data[0].limit(0), model).count() == 0
    for labels, share in ([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, None), (None, 0)], 0.0):
        few = ql.train(data[0], spark.createDataFrame(labels, "doc_id long, quality int"))
        assert abs(ql.scored(data[0].limit(1), few).first().score - share) < 1e-5
