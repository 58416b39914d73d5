import random

import numpy as np
import pytest

from kinsieve.llm import toxicity as tx

PLAIN = "the idiot and the moron are here with a stupid clown who is a loser or scum trash that is worthless to us all in this place of words".split()


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(2)
    nice = [f"{a}{b}" for a in ("ban", "tor", "mil", "ser", "gol") for b in ("der", "ing", "ate", "on", "ely", "ish")]
    rude = ["idiot", "moron", "stupid", "worthless", "scum"]
    docs, labels = [], []
    for i in range(600):
        words = r.choices(nice + PLAIN[-8:], k=r.randrange(5, 60))
        toxic = i % 3 == 0
        if toxic:
            words[r.randrange(len(words))] = r.choice(rude)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


@pytest.fixture(scope="module")
def model(data):
    return tx.train(data[0], data[1])


def test_counts_are_of_all_texts(spark, data):
    docs = data[0]
    want = np.zeros(tx.SIZE**3)
    for row in docs.collect():
        c = [0, *(tx.LETTERS.index(x) + 1 if x in tx.LETTERS else 0 for x in row.text), 0]
        for a, b, d in zip(c, c[1:], c[2:]):
            want[(a * tx.SIZE + b) * tx.SIZE + d] += 1
    assert np.array_equal(tx.letter_counts(docs.select("text").repartition(3)), want)


def test_restoring(model):
    for token, word in {"1d10t": "idiot", "m0r0n": "moron", "$tup1d": "stupid", "sc.um": "scum", "mooooron": "moron", "stuuupid": "stupid", "w0rthl3ss": "worthless"}.items():
        assert model.decoder.restore(token) == word


def test_disguised_words_score_like_plain_ones(model):
    score = model.scorer()
    for plain, disguised in [("idiot", "1d10t"), ("moron", "m o r o n"), ("stupid", "s.t.u.p.i.d"), ("scum", "$cum"), ("idiot", "idiiiot"), ("moron", "MORON!!")]:
        clean = "bander toring milate seron"
        assert score(clean) < tx.THRESHOLD
        assert score(f"{clean} {plain} golish") >= tx.THRESHOLD
        assert score(f"{clean} {disguised} golish") >= tx.THRESHOLD, disguised


def test_no_part_of_a_text_is_cut_off(model):
    score = model.scorer()
    clean = "bander/toring/milate/seron/golish/banish/toron/goling/"
    glued = "bandertoringmilateserongolishbanishtorongolingmilish"
    assert len(clean) > tx.LONGEST < len(glued)
    for text in (clean, glued, "a b a n d e r", "i n t h i s p l a c e"):
        assert score(text) < tx.THRESHOLD, text
    for sign in "/.-_,":
        for word in ("stupid", "1d10t", "MORON"):
            assert score(f"{clean.replace('/', sign)}{word}{sign}golish") >= tx.THRESHOLD, (sign, word)
    for text in (f"{glued}stupid{glued}", f"{glued * 60}idiot{glued}", "a s t u p i d", "a l l i d i o t", "i n t h i s p l a c e o f w o r d s a l l s t u p i d u s a l l"):
        assert score(text) >= tx.THRESHOLD, text
    unspaced = "".join(chr(0x4E00 + i) for i in range(60))
    assert {tx._hashed(unspaced[i : i + k]) for k in (2, 3) for i in (0, 45, 57)} <= set(tx.Words(model.decoder).one(unspaced))


def test_separators_count_whatever_the_length(model):
    score = model.scorer()
    clean = "bander toring milate seron golish"
    for token in ("you/stupid", "you-stupid-now", "so(stupid)", "yes,stupid", "you/1d10t", "a_moron_b", "x/" * 30 + "stupid"):
        assert score(f"{clean} {token}") >= tx.THRESHOLD, token
    for token in ("toring/milate", "ban-tor", "so(seron)", "yes,golish", "s/t/u", "milate." * 9):
        assert score(f"{clean} {token}") < tx.THRESHOLD, token


def test_decoder_against_all_readings(model):
    """The Viterbi path is the best of all readings, each scored by itself."""
    d = model.decoder

    def best(token):
        readings = [("", 0.0)]
        for choices in d.choices(token):
            readings = [(text + letters, cost + c) for text, cost in readings for letters, c in choices]

        def value(text, cost):
            codes = [0, 0, *(d.code.get(x, tx.SIZE - 1) for x in text), 0]
            return sum(d.logs[a][b][c] for a, b, c in zip(codes, codes[1:], codes[2:])) - cost

        return max(value(*r) for r in readings), value, dict(sorted(((t, c) for t, c in readings), key=lambda r: -r[1]))

    for token in ("1d10t", "m00r0n", "s.c.u.m", "$tuu*p1d", "zz6|", "w0rth", "é1ß", "a", "--"):
        top, value, costs = best(token)
        word = d.restore(token)
        assert abs(value(word, costs[word]) - top) < 1e-9, token


def test_query(spark):
    """The query's columns, its fold and threshold over the whole table."""
    from zlib import crc32

    from kinsieve.llm.registry import QUERIES

    rows = QUERIES["op9_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1


def test_held_out_accuracy(data, model):
    docs, _, labels = data
    rows = tx.scored(docs.where(tx.fold("doc_id", 4) == 2), model).collect()
    assert len(rows) > 100
    assert np.mean([(r.score >= tx.THRESHOLD) == labels[r.doc_id] for r in rows]) > 0.97


def test_odd_rows(spark, model, data):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 60_000, None), (3, "x " * 60_000, None), (None, "idiot", "c"), (4, "1" * 5000 + "a" * 5000, "d")]
    got = tx.scored(spark.createDataFrame(rows, "doc_id long, text string, toxic string"), model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert tx.scored(data[0].limit(0), model).count() == 0
    for labels in ([], [(1, 0)], [(1, None), (None, 1)]):
        few = tx.train(data[0], spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert 0 <= few.scorer()("idiot") < tx.THRESHOLD
