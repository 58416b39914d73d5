import numpy as np
import pytest

from kinsieve.llm import forest
from kinsieve.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, id int, v string, ids int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)


def brute(rows, k, every=20):
    ok = [(i, np.asarray(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.r_[np.float32(v), np.zeros(width - len(v))].astype(np.float64)) for i, v in ok]
    out = {}
    for q, own in ok:
        if q % every:
            continue
        for i, v in ok:
            if i != q:
                s = 0.0
                for a, b in zip(own, v, strict=True):
                    s += a * b
                out.setdefault(q, set()).add((i, s))
    return {q: sorted(c, key=lambda x: (-x[1], x[0]))[:k] for q, c in out.items()}


def found(spark, rows, k=20, **how):
    usable = forest.usable(frame(spark, rows))
    out = {}
    for r in sorted(forest.nearest(usable.where("id % 20 = 0"), usable, k, **how).collect()):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, true):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in true[q]}) / len(true[q]) for q in true])


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist()


def test_all_leaves_give_the_exact_answer(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(unit(rng, 300, 7)))
    assert found(spark, rows, 5, work=1e6) == brute(rows, 5)


def test_cases(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(unit(rng, 90, 5)))
    rows += [(100, None), (101, []), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [float("inf")]), (105, [0.0, 0.0]), (None, [1.0])]
    rows += [(120, [1.0, 2.0]), (121, [3.0, 0.5]), (122, [1e18, 0.0]), (123, [-0.0, 1.0, 0.0])]  # other lengths and sizes
    rows += [(200 + i, [1.0, 2.0, 0.5, 0.0, 1.0]) for i in range(60)]  # copies, queries among them
    rows += [(20, [1.0, 1.0, 1.0, 1.0, 1.0])] * 3 + [(20, [2.0, 1.0, 1.0, 1.0, 1.0])]  # one id, several vectors, repeated rows
    got, true = found(spark, rows, work=1e6), brute(rows, 20)
    assert got == true
    assert {100, 102, 105} & set(got) == set()


def test_nothing_to_search(spark):
    assert found(spark, []) == {} and found(spark, [(20, [1.0])]) == {} and found(spark, [(21, [1.0]), (22, [2.0])]) == {}


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_without_structure(spark, lengths):
    rng = np.random.default_rng(3)
    vectors = np.asarray(unit(rng, 4000, 48))
    if lengths:
        vectors = vectors * rng.lognormal(0, 0.5, size=(4000, 1))
    rows = list(enumerate(vectors.tolist()))
    got, true = found(spark, rows), brute(rows, 20)
    assert recall(got, true) >= 0.9
    assert all(dict(true_scores)[i] == s for q, true_scores in true.items() for i, s in got[q] if i in dict(true_scores))


def test_search_looks_at_a_part_of_the_rows():
    rng = np.random.default_rng(4)
    x = np.asarray(unit(rng, 20_000, 16), np.float64)
    trees = forest.fitted(x[:5000], 1.0, len(x))
    leaves = trees.leaves(x)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=2**trees.depth) for t in range(forest.TREES)])
    assert sizes.sum() == forest.TREES * len(x) and sizes.max() < 8 * forest.LEAF_ROWS
    seen, hits = [], []
    for q in range(0, 400, 20):
        met = trees.visited([p[0].tolist() for p in trees.projected(x[q : q + 1])], sizes, 6000)
        assert len(set(met)) == len(met) and len({t for t, _ in met}) == forest.TREES
        rows = {i for t, leaf in met for i in np.flatnonzero(leaves[:, t] == leaf)}
        seen.append(len(rows))
        best = np.argsort(-(x @ x[q]))[1:21]
        hits.append(len(rows & set(best)) / 20)
    assert max(seen) < 6500 and np.mean(hits) > 0.9


def test_hot_blocks_are_dealt_on_both_sides(spark, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK_CELLS", 200)
    monkeypatch.setattr(forest, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(5)
    near = (np.asarray([1.0, 0, 0, 0]) + rng.normal(size=(400, 4)) * 1e-4).tolist()
    rows = list(enumerate(near + unit(rng, 200, 4)))
    assert found(spark, rows, 5, work=1e6) == brute(rows, 5)


def test_query_recall(spark):
    d = "/root/testdata/sf0.01"
    got = {}
    for r in sorted(QUERIES["op13_nearest"](spark, d).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    assert recall(got, brute(rows, 20)) >= 0.9 and all(len(v) == 20 for v in got.values())
