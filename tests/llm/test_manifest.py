import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from kinsieve.llm import manifest
from kinsieve.llm.registry import ORACLE, QUERIES

NAMES = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def tree(nodes):
    """The root, and of each node the siblings (left, right) of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = k // 8 * 8
            paths[i].append((nodes[run:k], nodes[k + 1 : run + 8]))
        at = [k // 8 for k in at]
        nodes = [h(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def plain(rows):
    null_first = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    out, tops = [], []
    langs = sorted({r[2] for r in rows}, key=null_first)
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (null_first(r[0]), leaf(r)))
        tops.append((mine, *tree([leaf(r) for r in mine])))
    root, above = tree([t[1] for t in tops])
    for (mine, subroot, paths), up in zip(tops, above, strict=True):
        for r, path in zip(mine, paths, strict=True):
            told = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                told = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            now = leaf(told)
            for left, right in path + up:
                now = h(*left, now, *right)
            out.append((r[0], leaf(r), subroot, root, h(*(x for left, right in path + up for x in left + right)), now, now == root))
    return out


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(partitions).withColumns({c: F.lit(1) for c in ("leaf", "now", "tree", "place", "n", "lang_")})
    return [tuple(r) for r in manifest.manifest(docs, tampered()).collect()]


def by_text(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 520])
def test_one_language(spark, n):
    rows = [(i * 7 - 20, "s", "en", i, f"Text {i}") for i in range(n)]
    assert by_text(found(spark, rows)) == by_text(plain(rows))


def test_many_languages_nulls_and_repeated_rows(spark):
    rng = random.Random(3)
    langs = [None, "", "é", "zz", "日", "\U0001f600", *(f"l{i}" for i in range(14))]
    value = lambda: rng.choice([None, "", "Ünï", "A" * 300, "x y"])
    rows = [(rng.choice([None, *range(90)]), value(), rng.choice(langs), rng.choice([None, 0, 12]), value()) for _ in range(400)]
    rows += [(5, "s", "en", 1, "Same")] * 20
    assert by_text(found(spark, rows)) == by_text(plain(rows))


def test_tampering_shows_only_where_it_changes_something(spark):
    rows = [(i, "s", "en", 1, "lower" if i % 2 else "Upper") for i in range(40)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (bool(doc_id % 2) or zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_no_rows(spark):
    assert found(spark, []) == []


def test_sql_is_the_contract(spark, tmp_path):
    import duckdb

    rows = [(i, f"s{i % 3}", [None, "en", "de"][i % 3], i, "Ab é" * (i % 5)) for i in range(150)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_text(con.execute(f"select {', '.join(columns)} from ({ORACLE["op12_merkle_manifest"]})").fetchall()) == by_text(plain(rows))
    assert by_text(tuple(r[c] for c in columns) for r in QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()) == by_text(plain(rows))
