import random
import re

import pytest

import corpus_pipeline as cp
from kinsieve.llm import bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LONG = "the quick fox number {} jumps over every lazy dog that sleeps near the old mill by the river while children watch from the bridge"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    passage = "benchmark passage words that nobody else would ever write in exactly this order for any reason at all today"
    r = random.Random(4)
    tale = lambda i, word="": LONG.format(i) + f" and tale ends {word} " + " ".join(f"{r.choice('bdfgklmnprst')}{r.choice('aeiou')}{r.choice('bdfgklmnprst')}{r.choice('aeiou')}" for _ in range(80))
    docs = [(i, tale(i), "en", "s", 0) for i in range(300)]
    docs += [(500 + i, docs[i][1], "en", "s", 0) for i in range(10)]  # copies
    docs += [(700 - 60 + i, docs[i][1].replace("ends", "ended"), "en", "s", 0) for i in range(5)]  # near copies
    docs += [(700, docs[50][1] + " idiot", "en", "s", 0), (701, docs[51][1] + " stupid", "en", "s", 0)]
    docs += [(800, " ".join(f"z{k}" for k in range(30)) + " " + passage + " end", "en", "s", 0), (900, "mail a.b@c.org now +49 30 1234567 ok", "en", "s", 0)]
    docs += [(901, None, None, None, None), (902, "", "en", "s", 0), (None, "no id here", "en", "s", 0), (903, "twice", "en", "s", 5), (903, "twice", "en", "s", 5)]
    toxic = [(2000 + i, tale(i, "idiot" if i % 2 else "stupid"), "en", "s", 0) for i in range(90)]
    spark.createDataFrame(docs + toxic, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d[0], int(d[0] >= 2000), 1) for d in docs[:300] + toxic], "doc_id long, toxic int, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, ids = docs, []
    for _, stage in cp.STAGES[:-1]:
        kept = cp.written(stage(spark, kept, folder))
        assert kept.columns == COLUMNS
        ids.append([r.doc_id for r in kept.select("doc_id").collect()])
    first = ids[0]
    rude = {d for d in first if d is not None and (d >= 2000 or d in (700, 701))}
    assert len(rude) < 10  # of 92
    clean = {*range(300), *range(500, 510), *range(640, 645), 800, 900, 901, 902, 903, None}
    assert set(first) <= clean | rude and len(set(first)) > 0.9 * len(clean) and {800, 900, None} <= set(first)
    copied = lambda d: d is not None and (500 <= d < 510 and d - 500 in first or 640 <= d < 645 and d - 640 in first)
    assert sorted(ids[1], key=str) == sorted((d for d in set(first) if not copied(d)), key=str)
    assert sorted(ids[2], key=str) == sorted((d for d in ids[1] if d != 800), key=str) == sorted(ids[3], key=str)
    texts = {r.doc_id: r for r in kept.collect()}
    assert texts[900].text == "mail [EMAIL] now [PHONE] ok" and texts[900].n_chars == 27 and texts.get(901, texts[900]).text in (None, texts[900].text)
    assert not any(re.search("@", r.text or "") for r in texts.values())
    out = {r.doc_id: tuple(r) for r in cp.run(spark, folder).collect()}
    want = {r.doc_id: tuple(r) for r in bpe.encode_documents(kept, *bpe.vocabulary()).collect()}
    assert out == want and len(out) == len(ids[3])


CLASHING = ["_h", "_hits", "_placed", "_cut", "pii_spans", "_toxicity", "score", "h", "token", "file_id"]


def test_stages_with_clashing_columns_and_odd_tables(spark, folder, tmp_path):
    """Columns of the stages' own names stay; an empty table, a very long text and labels of one kind pass."""
    rows = [(1, "mail a.b@c.org now", "en", "s", 1), (2, "word " * 50_000, "en", "s", 2), (3, None, None, None, None), (3, None, None, None, None), (4, "mail a.b@c.org now", "en", "s", 4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "some passage of a benchmark that is in none of these")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema).withColumns({c: cp.F.concat(cp.F.lit(c), "doc_id") for c in CLASHING})
    for _, stage in cp.STAGES[:-1]:
        docs = cp.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == COLUMNS + CLASHING
    got = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 2, 3] and got[0].text == "mail [EMAIL] now" and all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        empty = cp.written(stage(spark, empty, str(tmp_path)))
    assert empty.count() == 0


def test_contract():
    assert [n for n, _ in cp.STAGES] and 4 <= len(cp.STAGES) <= 5 and cp.ORACLE_SQL is None
