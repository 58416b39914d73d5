import random

import numpy as np
import pytest

from kinsieve.llm import language as lg
from kinsieve.llm.common import fold

PARTS = {"aa": ["the", "ing", "tion", "and", "of"], "bb": ["und", "der", "sch", "ung", "ich"], "cc": ["que", "eau", "é", "les", "ou"]}


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    rows = []
    for i in range(600):
        lang = "abc"[i % 3] * 2
        rows.append((i, " ".join("".join(r.choices(PARTS[lang], k=r.randrange(1, 4))) for _ in range(r.randrange(3, 60))), lang, 1))
    rows += [(1000, None, "aa", 1), (1001, "", "bb", 1), (1002, "123 !?", "cc", 1), (1006, "½ ① ² Ⅷ", "cc", 1), (1003, "the and", None, 1), (1004, "und " * 50_000, None, 1), (None, "der ich", "bb", 1), (5, rows[5][1], "cc", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")


def test_grams_against_a_plain_version():
    words = ["ab", "é", "abcab"]
    at, bucket = lg.grams(words)
    for i, w in enumerate(words):
        own = f"\0{w}\0"
        want = [own[a : a + n] for n in range(1, 5) for a in range(len(own) - n + 1) if own[a : a + n].strip("\0")]
        assert (at == i).sum() == len(want)
    same = lg.grams(["ab", "xx", "ab"])
    assert np.array_equal(same[1][same[0] == 0], same[1][same[0] == 2])


def test_document_frequencies(docs):
    texts = docs.select("text")
    df, n = lg.document_frequencies(texts.repartition(3))
    want = np.zeros(lg.DIMS)
    rows = [r.text for r in texts.collect()]
    for t in rows:
        words = lg.words_of((t or "").lower())
        if words:
            want[np.unique(lg.grams(words)[1])] += 1
    assert n == len(rows) and np.array_equal(df, want)


def test_held_out(docs):
    model = lg.train(docs)
    assert model.languages == ["aa", "bb", "cc"]
    rows = lg.identified(docs.where(fold("doc_id", 4) == 2), model).collect()
    want = {r.doc_id: r.lang for r in docs.collect()}
    known = [r for r in rows if r.doc_id is not None and r.doc_id < 1000]
    assert len(known) > 100 and np.mean([r.lang_pred == want[r.doc_id] for r in known]) > 0.98
    every = lg.identified(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r.score <= 1 for r in every)
    by = {r.doc_id: (r.lang_pred, r.score) for r in every}
    assert by[1000] == by[1001] == by[1002] == by[1006] == ("und", 0.0)
    assert by[1003][0] == "aa" and by[1004][0] == "bb"


def test_nothing_to_learn(spark, docs):
    none = lg.train(docs.where("lang is null"))
    assert {r.lang_pred for r in lg.identified(docs, none).collect()} == {"und"}
    assert lg.identified(docs.limit(0), none).count() == 0
    one = lg.train(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in lg.identified(docs.where("doc_id < 9"), one).collect()} == {"aa"}


def test_letters_only():
    assert lg.words_of("ab½c ²Ⅷ x_y 3z é") == ["ab", "c", "x", "y", "z", "é"]


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 103 // 26)}{chr(97 + i % 103 % 26)}", f"l{i % 103}") for i in range(824)], "doc_id long, text string, lang string")
    assert sorted(lg.train(docs).languages) == sorted(f"l{i}" for i in range(103))
