import numpy as np
import pytest

from kinsieve.llm import topk


def brute(rows, k):
    w = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        w.setdefault(i, []).append([int(np.floor(64 * float(np.float32(x)))) for x in v])
    out = set()
    for q, vs in w.items():
        if q % 20:
            continue
        found = sorted((-sum(a * b for a, b in zip(vs[0], c)), i) for i, cs in w.items() if i != q for c in cs)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def result(spark, rows, k, **sizes):
    df = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return {tuple(r) for r in topk.top_k(df.where("id % 20 = 0"), df, k, **sizes).collect()}


@pytest.mark.parametrize("tiles", [(4, 16), (1024, 32768)])
def test_against_brute_force(spark, tiles):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.05, 8).round(2).tolist()) for i in range(90)]
    rows += [(i, [0.5] * 8) for i in range(100, 140)]  # ties
    rows += [(200, None), (220, []), (240, [float("nan")] * 8), (260, [None] * 8), (280, [float("inf")] * 8), (None, [0.1] * 8), (7, [0.5] * 8)]
    assert result(spark, rows, 5, tile_rows=tiles) == brute(rows, 5)
    assert result(spark, rows, 500, tile_rows=tiles) == brute(rows, 500)


def test_large_components_and_few_rows(spark):
    rows = [(0, [3.0e7, -2.0e7]), (1, [3.0e7, 1.0]), (2, [-3.0e7, 0.0])]
    assert result(spark, rows, 20) == brute(rows, 20)
    assert result(spark, rows[:1], 20) == set()
    assert result(spark, rows[1:], 20) == set()


def test_sparse_terms_and_unequal_lengths(spark):
    rows = [(i, [0.0] * i + [1.0]) for i in range(41)]
    got = result(spark, rows, 3)
    assert {r for r in got if r[0] == 40} == {(40, 1, 0, 0), (40, 2, 1, 0), (40, 3, 2, 0)}
