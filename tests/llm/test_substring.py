import hashlib
import random
import re
from collections import Counter

import pyarrow.dataset as ds
import pytest

from kinsieve.llm import substring


def brute(rows, width):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, width):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, h int")
    return sorted(map(tuple, substring.without_repeats(df, width).collect()), key=str)


@pytest.mark.parametrize("width", [3, 12, 35])
@pytest.mark.parametrize("words", [3, 40, 4000])
def test_random_texts(spark, width, words):
    r = random.Random(width * words)
    vocabulary = [f"w{i}é" for i in range(words)]
    texts = [" ".join(r.choices(vocabulary, k=r.choice([0, 1, width - 1, width, width + 1, 90, 300]))) for _ in range(40)]
    for _ in range(30):  # shared passages, near and exact copies
        a = r.choice(texts).split()
        at = r.randrange(len(a) + 1)
        texts.append(" ".join(r.choices(vocabulary, k=r.randrange(60)) + a[at : at + r.randrange(120)] + r.choices(vocabulary, k=r.randrange(60))))
    rows = list(enumerate(texts))
    assert result(spark, rows, width) == brute(rows, width)


def test_odd_rows(spark):
    line = " ".join(f"t{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "de " * 40), (5, "ja " * 34), (6, line), (6, line), (7, "x\x0b" + line + "\r\ny z q"), (None, line), (None, "one"), (8, "a b c " * 9000), (9, "nein " * 35)]
    assert result(spark, rows, 35) == brute(rows, 35)
    assert result(spark, [], 35) == []


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(x["doc_id"], x["text"]) for x in ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    assert sorted(map(tuple, substring.op5_substring_dedup(spark, folder).collect()), key=str) == brute(rows, 35)
