import random
from itertools import permutations

from pyspark.sql import functions as F

from kinsieve.llm import audit
from kinsieve.llm.registry import QUERIES

SPACE = " \t\n\x0b\x0c\r"


def plain(docs, labels):
    """The contract, document by document."""
    good, toxic = ({d for d, *rest in labels if rest[k] == 1} for k in (0, 1))
    rows = []
    for doc_id, source, text in docs:
        t = text or ""
        words = "".join(" " if c in SPACE else c for c in t).split(" ")
        words = [w for w in words if w]
        copies = [d for d, _, other in docs if (other or "") == t and d is not None and doc_id is not None and d < doc_id]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": bool(copies),
        }
        rows.append((source or "", fails, doc_id is not None and doc_id in good, doc_id is not None and doc_id in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                left = [r for r in left if not r[1][f]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(r[1][f] for r in mine) - len(gone), sum(r[1][f] and sum(r[1].values()) == 1 for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone), f,
                ]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = total[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    return d.withColumns({c: F.lit(7) for c in ("id", "part", "mask", "n", "filter", "at", "salt")}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_every_order_against_a_plain_walk(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Big", "a#b", "é", "ÀB"]
    text = lambda: rng.choice([" ", "\n", "\t ", "\x0b"]).join(rng.choices(words[: rng.choice([3, 100, 404])], k=rng.choice([1, 50, 199, 200, 201, 450])))
    texts = [text() for _ in range(40)] + ["", None, " ", "AAA", "x " * 70_000, "\xa0".join(words)]
    docs = [(rng.choice([None, *range(60)]), rng.choice(["a", "b", None, ""]), rng.choice(texts)) for _ in range(150)]
    docs += [(100, "b", "same text"), (100, "b", "same text"), (101, "b", "same text"), (None, "b", "same text")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 110, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    found = got(audit.interactions(audit.cells(*frames(spark, docs, labels))))
    assert found == plain(docs, labels)
    assert len(found) == len({s or "" for _, s, _ in docs}) * 600


def test_hand_worked_counts(spark):
    docs = [(1, "s", "short"), (2, "s", "short"), (3, "s", "SHOUT")]
    found = got(audit.interactions(audit.cells(*frames(spark, docs, [(2, 1, 1)]))))
    # all fail A; the copy fails E, the shout C
    assert found["s", "ABCDE", 1] == (0, 3, 0, 1, 1, 1, 60 + 60 + 120)
    assert found["s", "EACBD", 1] == (2, 1, 0, 0, 1, 1, 60)
    assert found["s", "EACBD", 3] == (0, 0, 1, 0, 0, 0, 60)


def test_no_documents(spark):
    assert audit.interactions(audit.cells(*frames(spark, [], []))).count() == 0


def test_copies_meet_in_no_task_by_text(spark, tmp_path):
    """A group of copies is summed before its shuffle: the rows that cross it don't grow with the group."""
    docs = [(i, "s", "the same text") for i in range(5000)]
    found = got(audit.interactions(audit.cells(*frames(spark, docs, []))))
    assert found["s", "EABCD", 1][:2] == (1, 4999)


def test_query_is_the_operator(spark):
    assert QUERIES["op11_filter_audit"](spark, "/root/testdata/sf0.001").count() % 600 == 0
