"""Operator 12: a Merkle manifest of the dataset with a proof for each row, in supersteps over RDDs.

Every row is a leaf; the leaves of a language, by doc_id, form a tree of runs of
eight, and the roots of the languages form one above. Going up, each node sends its
digest to its parent; a parent that has all its children hashes them and sends
on. Going down, each parent sends its children the siblings on their way to the root, and
the leaves fold them with what they hold now. A superstep is one shuffle by (tree, run) of messages of
at most eight digests; there are twice as many as levels, which the driver knows from the size of the largest tree.

Leaves are numbered over ranges of (lang, doc_id), never in one task, and written to the shared folder, where a lost
executor's work starts again. A leaf's path goes to its run, not to each leaf: seven digests a level for eight leaves.

Cases: nulls are '-' in a leaf; null lang comes first, null doc_id first in its language and it is never tampered with. Leaves
of one doc_id go by digest; repeated rows are leaves each. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..operators.blocking import numbered
from .common import dropped, read, written

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """The digest of a row's fields, each with its length in bytes."""
    one = lambda x: F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))
    return F.sha2(F.concat(*(one(x.cast("string")) for x in fields)).cast("binary"), 256)


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, lang, leaf and now: the leaf of what the row holds now, its text lower-cased (A-Z) where tampered with."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = [F.col(c) for c in FIELDS]
    return docs.select("doc_id", "lang", leaf_of(columns).alias("leaf"), F.when(tampered, leaf_of([*columns[:-1], lowered])).alias("now")).withColumn("now", F.coalesce("now", "leaf"))


def placed(leaves: DataFrame) -> DataFrame:
    """leaves with tree (the number of its language, from 0), place in it and n (leaves of the tree), written."""
    found = written(numbered(leaves, F.col("lang"), F.col("doc_id"), F.col("leaf"), into="place"))
    trees = written(found.groupBy("lang").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    trees = written(numbered(trees, F.col("lang"), into="tree"))
    out = written(found.join(trees.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).select("doc_id", "leaf", "now", "tree", (F.col("place") - F.col("first")).alias("place"), "n"))
    dropped(found)
    return out


def _run(nodes: RDD, tasks: int) -> RDD:
    """((tree, run), (n, [(place, digest, load), ...] in order)) of nodes ((tree, place), (n, digest, load)): every node's message to its parent."""
    sent = nodes.map(lambda x: ((x[0][0], x[0][1] // ARITY), (x[0][1] % ARITY, *x[1])))

    def complete(messages) -> tuple:
        got = sorted(messages, key=lambda m: m[0])
        return got[0][1], [(at, own, load) for at, _, own, load in got]

    return sent.groupByKey(tasks).mapValues(complete)


def _forward(runs: RDD) -> RDD:
    """The parents of complete runs, as nodes of the next level; the only node of a tree is its own parent."""
    def up(x: tuple) -> tuple:
        (tree, run), (n, got) = x
        expected = min(ARITY, n - ARITY * run)
        if len(got) != expected:
            raise ValueError(f"run {run} of tree {tree} has {len(got)} of {expected} nodes")
        return (tree, run), (-(-n // ARITY), got[0][1] if n == 1 else digest([own for _, own, _ in got]), None)

    return runs.map(up, preservesPartitioning=True)


def _down(runs: RDD, paths: RDD) -> RDD:
    """((tree, place), (about, path), load)) of the nodes of runs whose run got (about, path): each run's message to its children."""
    def spread(x: tuple):
        (tree, run), ((n, got), (about, path)) = x
        own = [d for _, d, _ in got]
        for i, (at, _, load) in enumerate(got):
            beside = () if n == 1 else (("".join(own[:i]), "".join(own[i + 1 :])),)
            yield (tree, run * ARITY + at), ((about, beside + path), load)

    return runs.join(paths, runs.getNumPartitions()).flatMap(spread)


def depth(n: int) -> int:
    """Levels of runs over n nodes, one at least."""
    levels = 1
    while n > ARITY:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climbed(nodes: RDD, levels: int, tasks: int) -> tuple[list[RDD], RDD]:
    """The runs of each level, and ((tree, 0), digest) of the roots."""
    runs, roots = [], []
    for _ in range(levels):
        runs.append(_run(nodes, tasks))
        tasks = max(2, tasks // 4)
        nodes = _forward(runs[-1])
        roots.append(nodes.filter(lambda x: x[1][0] == 1).mapValues(lambda v: v[1]))
        nodes = nodes.filter(lambda x: x[1][0] > 1)
    return runs, nodes.context.union(roots)


def descended(runs: list[RDD], tops: RDD) -> RDD:
    """((tree, place), ((about, path), load)) of the lowest nodes; tops: ((tree, 0), (about, path above the root)) of each tree."""
    below = None
    for level in reversed(runs):
        tasks = level.getNumPartitions()
        # trees whose root lies right above this level start here
        reached = level.filter(lambda x: x[1][0] <= ARITY).join(tops, tasks).mapValues(lambda v: v[1])
        if below is not None:
            reached = reached.union(below.mapValues(lambda v: v[0]).partitionBy(tasks))
        below = _down(level, reached)
    return below


def folded(now: str, path: tuple) -> str:
    """The root that a leaf gives with the siblings on its way."""
    for left, right in path:
        now = digest([left, now, right])
    return now


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of docs."""
    spark = docs.sparkSession
    leaves = placed(leaves_of(docs, tampered))
    largest, trees = leaves.agg(F.max("n"), F.max("tree")).first()
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), StructField("verified", BooleanType())])
    if largest is None:
        return spark.createDataFrame([], schema)
    # as many tasks as the session's shuffles have
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    nodes = leaves.rdd.map(lambda r: ((r.tree, r.place), (r.n, r.leaf, (r.doc_id, r.leaf, r.now))))
    runs, subroots = climbed(nodes, depth(largest), tasks)
    count = trees + 1
    above, roots = climbed(subroots.map(lambda x: ((0, x[0][0]), (count, x[1], x[1]))), depth(count), tasks)
    root = roots.first()[1]
    # one row for each tree: about it, its subroot
    tops = descended(above, spark.sparkContext.parallelize([((0, 0), (None, ()))], 1)).map(lambda x: ((x[0][1], 0), (x[1][1], x[1][0][1])))

    def row(x: tuple) -> tuple:
        (subroot, path), (doc_id, leaf, now) = x[1]
        other = folded(now, path)
        return doc_id, leaf, subroot, root, digest([side for level in path for side in level]), other, other == root

    return spark.createDataFrame(descended(runs, tops).map(row), schema, verifySchema=False)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those whose crc32 of the doc_id 3 divides are tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(read(spark, sf_dir, "documents", *FIELDS), tampered)


def _levels(name: str, levels: int) -> str:
    """DuckDB: name0(lk, i, h, n) to the roots, and for each level the digests on both sides of a node."""
    parts = []
    for k in range(levels):
        over = f"over (partition by lk, i // {ARITY} order by i rows between"
        parts.append(f"{name}s{k} as (select lk, i, n, coalesce(string_agg(h, '') {over} unbounded preceding and 1 preceding), '') lf, coalesce(string_agg(h, '') {over} 1 following and unbounded following), '') rt from {name}{k})")
        parts.append(f"{name}{k + 1} as (select lk, i // {ARITY} i, case when n = 1 then any_value(h) else sha256(string_agg(h, '' order by i)) end h, (n + {ARITY - 1}) // {ARITY} n from {name}{k} group by lk, i // {ARITY}, n)")
    return ",\n".join(parts)


def _folds(name: str, start: str, first: int, levels: int) -> str:
    """DuckDB: the proofs of start, level by level of name."""
    parts = []
    for k in range(levels):
        before = start if k == 0 else f"p{first + k - 1}"
        parts.append(f"p{first + k} as (select p.doc_id, p.leaf, p.own, p.lk, p.i // {ARITY} i, case when n = 1 then p.h else sha256(lf || p.h || rt) end h, p.proof || lf || rt proof from {before} p join {name}s{k} using (lk, i))")
    return ",\n".join(parts)


_DEEP, _WIDE = 12, 5
_ROW = "sha256(" + " || ".join(f"coalesce(strlen(cast({{{c}}} as varchar)) || ':' || cast({{{c}}} as varchar), '-')" for c in FIELDS) + ")"
_PLAIN = {c: c for c in FIELDS}
_LOWER = _PLAIN | {"text": "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"}
#: Trees of up to 8^12 leaves and 8^5 languages; crc32 by a table of its bytes.
OP12_SQL = f"""
with tb as (select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by b) t from range(0, 256) r(b)),
cr as (
  select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ord(x) as bigint))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) crc
  from documents, tb),
lv as (
  select doc_id, case when lang is null then '0' else '1' || lang end lk, {_ROW.format(**_PLAIN)} leaf,
    case when crc % 3 = 0 then {_ROW.format(**_LOWER)} else {_ROW.format(**_PLAIN)} end cur from cr),
nb as (select *, row_number() over (partition by lk order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by lk) n from lv),
a0 as (select lk, i, leaf h, n from nb),
{_levels("a", _DEEP)},
b0 as (select 'root' lk, row_number() over (order by lk) - 1 i, h, count(*) over () n, lk own from a{_DEEP}),
{_levels("b", _WIDE)},
st as (select doc_id, leaf, lk own, lk, i, cur h, '' proof from nb),
{_folds("a", "st", 0, _DEEP)},
up as (select p.doc_id, p.leaf, p.own, 'root' lk, b0.i, p.h, p.proof from p{_DEEP - 1} p join b0 on b0.own = p.own),
{_folds("b", "up", _DEEP, _WIDE)}
select p.doc_id, p.leaf, b0.h subroot, r.h root, sha256(p.proof) proof_sha256, p.h folded_root, p.h = r.h verified
from p{_DEEP + _WIDE - 1} p join b0 on b0.own = p.own, b{_WIDE} r
"""
