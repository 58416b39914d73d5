"""The numpy kernels of pairs against the expressions, on files of every odd shape."""

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinsieve.functions import dense
from kinsieve.functions import vectors as V
from kinsieve.operators import detection, tiles, verdict
from kinsieve.operators.components import connected_components
from kinsieve.options import SCALED, Options

SCHEMA = "file_id long, bucket string, hashes array<array<long>>, frames array<array<double>>, patches array<array<array<double>>>, hist array<double>, words array<long>"
MORE = "score double, distance double, cd double, audio_dist double, mean double, max double, p90 double, ratio double, mid int, above int, hot int, hot_ratio double, corner double, center double, dom_q double, persistent int, pers_corner double, c_mean double, c_max double, c_p90 double, kind string, gate string"
O = replace(SCALED, audio_min_length=2, patch_min_hot=3, phash_distance_threshold=30.0, patch_hot_threshold=0.6, color_distance_threshold=0.9)


def files(n=26):
    r = random.Random(11)
    vector = lambda w=4: [r.gauss(0, 1) / 2 for _ in range(w)]
    rows = []
    for i in range(n):
        k = 7 if i < 14 else r.randrange(1, 8)
        rows.append([i, "x", [[r.getrandbits(64) - 2**63] for _ in range(k)], [vector(6) for _ in range(k)], [[vector() for _ in range(16)] for _ in range(k)], [r.random() / 4 for _ in range(4)], [r.getrandbits(40) for _ in range(r.randrange(1, 9))]])
    rows[15][2:] = [None] * 5
    rows[16][2:] = [[], [], [], [], []]
    rows[17][2:6] = [[[1, 2], None, [3]], [[1.0], None, [None] * 6], [None, [vector()] * 3, [None] * 16], [0.1, None, 0.2, 0.3]]
    rows[18][2:6] = [[[1], [None]], [[float("nan")] * 6, vector(6)], [[vector()] * 17, [vector(3)] * 16], [0.5, 0.5]]
    rows[19][2:] = rows[20][2:]
    rows[21][6] = [1, None, 3]
    return [tuple(x) for x in rows]


def expressions(df, o):
    side = lambda x: df.select("bucket", *(F.col(c).alias(f"{x}_{c}") for c in ("file_id", *detection.SIGNS)))
    p = side("a").join(side("b"), "bucket").where("a_file_id < b_file_id")
    d = V.hash_distances(F.col("a_hashes"), F.col("b_hashes"))
    p = p.withColumns({"score": V.hash_score(d, o), "distance": V.mean(d), "cd": V.bhattacharyya(F.col("a_hist"), F.col("b_hist")), "audio_dist": V.fingerprint_distance(F.col("a_words"), F.col("b_words"), o.audio_min_length)})
    p = verdict.center_stats(verdict.patch_stats(verdict.frame_stats(p, "a_frames", "b_frames", o), "a_patches", "b_patches", 4, o), "a_patches", "b_patches", 4, o.center_inner)
    return verdict.cascade(p, o)


def test_kernels_are_the_expressions(spark):
    def measure(a, b):
        (sa, oa, wa), (sb, ob, wb) = a["words"], b["words"]
        m = dense.hash_stats(a["hashes"], b["hashes"], O) | {"cd": dense.colours(a["hist"], b["hist"]), "audio_dist": dense.sounds((sa, sb), (oa, ob), (wa, wb), O.audio_min_length)}
        m |= dense.frame_stats(a["frames"], b["frames"], O) | dense.patch_stats(a["patches"], b["patches"], 4, O) | dense.center_stats(a["patches"], b["patches"], 4, O.center_inner)
        kind = dense.patch_kind(m, O)
        return {c.split()[0]: m.get(c.split()[0]) for c in MORE.split(", ")} | {"kind": dense.KINDS[kind], "gate": dense.GATES[detection.gates(a, b, O, 4)]}

    df = spark.createDataFrame(files(), SCHEMA)
    expected = {(r.a_file_id, r.b_file_id): r for r in expressions(df, O).collect()}
    got = {(r.a, r.b): r for r in tiles.measured(df, "bucket", detection.SIGNS, measure, MORE).collect()}
    assert got.keys() == expected.keys() and len(got) == 26 * 25 // 2
    for at, r in got.items():
        for c in (x.split()[0] for x in MORE.split(", ")):
            x, y = r[c], expected[at][c]
            # without patches there are no patch numbers
            assert x == y or (x is not None and y is not None and c not in ("kind", "gate") and math.isclose(x, y, abs_tol=1e-9)), (at, c, x, y)
    assert len({r.gate for r in got.values()}) > 3


def test_links_have_the_components_of_all_matches(spark):
    """Blocks of a few rows, and far fewer links than matches where all match."""
    same = [(100 + i, "y", *files()[0][2:]) for i in range(80)]
    df = spark.createDataFrame(files() + same, SCHEMA)
    pairs = detection.judged(df, O, 4).where("matched").select("a", "b")
    links = tiles.within(df, "bucket", "file_id", detection._links(O, 4), "a_file_id long, b_file_id long", (7, 20))
    components = lambda e, a, b: {r.node: r.component for r in connected_components(e, a, b).collect()}
    assert components(links, "a_file_id", "b_file_id") == components(pairs, "a", "b")
    assert links.where("a_file_id >= 100").count() < pairs.where("a >= 100").count() == 80 * 79 // 2


def test_forest():
    r = np.random.default_rng(2)
    hit = r.random((40, 50)) < 0.03
    rows, cols = tiles.forest(hit)
    assert hit[rows, cols].all() and len(rows) < 90
    at = list(range(90))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in zip(rows, cols, strict=True):
        at[find(i)] = find(40 + j)
    assert all(find(i) == find(40 + j) for i, j in zip(*np.nonzero(hit), strict=True))


@pytest.mark.parametrize("n", [40, 50, 64, 625])
def test_rounding_is_that_of_the_database(n):
    """k / (32 n) has many values that end in a 5 at the seventh place."""
    import duckdb

    x = np.arange(32 * n) / (32.0 * n)
    expected = np.array([r[0] for r in duckdb.connect().execute(f"select round(k / (32.0::double * {n}), 6) from range({32 * n}) t(k) order by k").fetchall()])
    assert (dense.rounded(x) == expected).all()
    assert Options().audio_min_length == 40


def sides(n, frames):
    """Two lists of files without odd shapes, padded."""
    r = np.random.default_rng(3)
    for _ in range(2):
        v, sizes, one = r.normal(size=(n, frames, 64)) / 8, np.full(n, frames), lambda *shape: np.ones((n, frames, *shape), np.int64)
        yield {"frames": (v, sizes, 64 * one()), "patches": (2 * v.reshape(n, frames, 16, 4), sizes, 16 * one(), 4 * one(16)), "hashes": (r.integers(-(2**63), 2**63 - 1, (n, frames, 1)), sizes, one()), "hist": (np.abs(v[:, 0]), np.full(n, 64))}


@pytest.mark.parametrize(("part", "kernel", "most"), [
    ("patches", lambda a, b: dense.patch_stats(a, b, 4, SCALED), 155),
    ("frames", lambda a, b: dense.frame_stats(a, b, SCALED), 150),
    ("patches", lambda a, b: dense.center_stats(a, b, 4, 2), 120),
    ("hashes", lambda a, b: dense.hash_stats(a, b, SCALED), 110),
    ("hist", lambda a, b: dense.rounded(dense.colours(a, b)), 35),
])
def test_a_pair_needs_few_bytes(part, kernel, most):
    """Distances of a tile are summed up one after the other, not kept for each frame, and counts are small numbers."""
    import tracemalloc

    a, b = (side[part] for side in sides(128, 14))
    kernel(a, b)
    tracemalloc.start()
    kernel(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < most * 128 * 128, peak / 128 / 128


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.8, 0.999])
def test_a_product_is_far_where_its_distance_is(threshold):
    """Products are compared with one bound in place of their distances: the last that is above the threshold, and hot cells are those of plain distances."""
    low = dense._product_below(threshold)
    assert 0.5 * (1 - low) > threshold >= 0.5 * (1 - np.nextafter(low, 2.0))
    a, b = (side["patches"] for side in sides(40, 3))
    d = 0.5 * (1 - np.clip(np.einsum("akpi,bkpi->abkp", a[0], b[0]), -1, 1))
    assert (dense.patch_stats(a, b, 4, replace(SCALED, patch_hot_threshold=threshold))["hot"] == (d > threshold).sum(axis=(2, 3))).all()
