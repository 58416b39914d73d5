import random

from pyspark.sql import functions as F

from kinsieve.operators import blocking
from kinsieve.operators.components import connected_components


def brute(edges):
    at = {}
    for a, b in edges:
        if a is not None and b is not None:
            at.setdefault(a, a), at.setdefault(b, b)

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            at[max(x, y)] = min(x, y)
    return {n: find(n) for n in at}


def check(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == brute(edges)


def test_shapes(spark):
    r = random.Random(3)
    check(spark, [(1, 2), (2, 3), (6, 5), (5, 6), (7, 7), (2, 2), (8, None), (None, None)])
    chain = [(i, i + 1) for i in range(300)]
    r.shuffle(chain)
    check(spark, chain + [(1000, i) for i in range(1001, 1200)])
    check(spark, [(r.randrange(500), r.randrange(500)) for _ in range(350)])
    check(spark, [])


def test_text_nodes(spark):
    got = connected_components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string")).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_a_hub_is_dealt_into_blocks(spark):
    """A star beside a chain: the same components, and no join key with more than about a block of the hub's edges."""
    n, rows = 3000, 100
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    chain = spark.range(n, n + 30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {r.node: r.component for r in connected_components(star.union(chain), rows=rows).collect()}
    assert got == {i: 0 for i in range(n)} | {i: n for i in range(n, n + 31)}
    hub = spark.createDataFrame([(0, -(-n // rows), 1)], "u long, _left int, _right int")
    edges = star.select(F.col("a").alias("u"), F.col("b").alias("v"))
    left, right = blocking.dealt(edges, spark.createDataFrame([(0, 0)], "u long, m long"), ["u"], "v", "m", rows, hub)
    assert left.groupBy("u", "_i", "_j").count().agg({"count": "max"}).first()[0] < 2 * rows and right.count() == -(-n // rows)
