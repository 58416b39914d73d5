"""Pairs worked out in tiles against plain loops."""

import random
import tempfile

from pyspark.sql import functions as F

from kinsieve.operators import blocking, tiles
from kinsieve.operators.components import connected_components
from kinsieve.plans import media


def joined(pairs):
    at = {}
    for a, b in pairs:
        at.setdefault(a, a), at.setdefault(b, b)

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        at[max(x, y)] = min(x, y)
    return {n: find(n) for n in at}


def test_similar_links_have_the_components_of_all_pairs(spark):
    """Fewer links than rows for each pair of blocks, also where all pairs match; odd vectors as an expression takes them."""
    r = random.Random(5)
    rows = [(i, i % 3, [r.gauss(0, 1) for _ in range(6)]) for i in range(150)]
    rows += [(1000 + i, 7, [2.0, 0.0]) for i in range(120)]
    # exactly on the bound, repeated ids, nulls, other lengths, no number
    rows += [(2000, 8, [0.5, 0.5]), (2001, 8, [2.0, 2.0]), (2002, 8, [2.5, 2.0]), (2003, 9, [9.0]), (2003, 9, [9.0]), (2004, 10, None), (2005, 10, [None, 9.0]), (2006, 10, [9.0, 9.0]), (2007, 10, [9.0]), (2008, 10, [9.0, 1.0]), (2009, None, [9.0]), (2010, None, [9.0]), (2011, 11, [float("nan")]), (2012, 11, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<float>")
    dot = F.aggregate(F.zip_with("a.v", "b.v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = [tuple(p) for p in df.alias("a").join(df.alias("b"), "label").where("a.vec_id < b.vec_id").where(dot > 2.0).select("a.vec_id", "b.vec_id").collect()]
    links = tiles.similar(df, "label", "vec_id", "v", 2.0, (20, 40))
    got = [tuple(p) for p in links.collect()]
    assert {tuple(sorted(p)) for p in got} <= set(pairs)
    assert {x.node: x.component for x in connected_components(links, "a_file_id", "b_file_id").collect()} == joined(pairs)
    hot = sum(1000 <= a < 2000 for a, _ in got)
    assert hot < 120 * 8 < sum(1000 <= a < 2000 for a, _ in pairs) == 120 * 119 // 2, hot


def test_the_query_links_no_more_than_its_blocks_need(spark):
    """force_overrides and connected_components start from these links; before, from every pair."""
    rows = spark.createDataFrame([(i, 1, [1.0, float(i % 2)]) for i in range(300)], "vec_id long, label int, embedding array<float>")
    folder = tempfile.mkdtemp()
    rows.write.parquet(f"{folder}/embeddings.parquet")
    assert media.similar(spark, folder).count() < 600
    assert [tuple(r) for r in media.force_overrides(spark, folder).collect()] == [(299, 1)]


def test_counts_of_pairs_are_those_of_the_pairs(spark):
    """Repeated and null ids, a bucket without pairs, buckets too far apart; five million rows of a bucket are counted without their pairs."""
    rows = [(1, "1.0"), (1, "1.0"), (2, "1.0"), (3, "1.5"), (None, "1.5"), (4, "9.0"), (4, "9.0"), (5, "2.0"), (6, "2.0"), (7, None), (8, None)]
    files = spark.createDataFrame(rows, "file_id long, bucket string")
    inside = blocking.bucket_pairs(files, ["file_id"]).groupBy("bucket").count()
    assert sorted(map(tuple, blocking.pair_counts(files).collect())) == sorted(map(tuple, inside.collect()))
    beside = blocking.cross_bucket_pairs(files, ["file_id"], 0.6).groupBy("bucket", "next_bucket").count()
    assert sorted(map(tuple, blocking.cross_bucket_counts(files, 0.6).collect())) == sorted(map(tuple, beside.collect())) == [("1.0", "1.5", 6), ("1.5", "2.0", 4)]
    many = spark.range(5_000_000).selectExpr("id file_id", "if(id % 2 = 0, '1.0', '1.5') bucket")
    assert {r.n_pairs for r in blocking.pair_counts(many).collect()} == {2_500_000 * 2_499_999 // 2}
    assert [r.n_pairs for r in blocking.cross_bucket_counts(many, 0.6).collect()] == [2_500_000**2]
