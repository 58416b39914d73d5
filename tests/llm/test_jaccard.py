import random
import re
import string

import pyarrow.dataset as ds
import pytest

from kinsieve.llm import jaccard

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        near = {j for t in s for j in index.get(t, ())}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                at[find(i)] = find(j)
        for t in s:
            index.setdefault(t, []).append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n string")
    return sorted(map(tuple, jaccard.components(df, **more).collect()), key=str)


def near_copies(seed, n=12, groups=8):
    r = random.Random(seed)
    line = "one line that stands in very many documents of the table."
    rows = []
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([3, 6, 30, 120]))]
        for _ in range(n):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
            words = words + line.split() * r.randrange(2) if r.random() < 0.6 else words[: max(1, len(words) - r.randrange(9))]
            rows.append((len(rows) + 5, " ".join(words)))
    rows += [(1000 + i, rows[r.randrange(len(rows))][1].upper()) for i in range(20)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "unit"), [(1, 10**6), (2, 1500)])
def test_near_copies(spark, seed, unit):
    rows = near_copies(seed)
    assert result(spark, rows, unit=unit) == sorted(brute(rows), key=str)


def test_odd_rows(spark):
    rows = [(4, None), (5, ""), (6, " \n"), (7, "a b"), (8, "A\tb"), (9, "a b c d e"), (10, "a b c d e f " * 3000), (11, "é É"), (12, "É é")]
    assert result(spark, rows) == sorted(brute(rows), key=str)
    assert result(spark, []) == []
    assert sorted(result(spark, [(3, "x y z"), (None, "x y z"), (3, "x y z")]), key=str)[0][2] == 3


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(x["doc_id"], x["text"]) for x in ds.dataset(f"{folder}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()]
    got = sorted(map(tuple, jaccard.op6_jaccard_join(spark, folder).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(got)
