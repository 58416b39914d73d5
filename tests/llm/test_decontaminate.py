import random
import re
from itertools import combinations

import pytest

from kinsieve.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    out = set()
    for d, text in docs:
        w = words(text)
        seeds = {}
        for k, m in enumerate(dc.MASKS):
            for p in range(len(w) - len(m) + 1):
                seeds.setdefault((k, *(w[p + i] for i, b in enumerate(m) if b == "1")), []).append(p)
        for i, other in items:
            v = words(other)
            lies = {p - q for k, m in enumerate(dc.MASKS) for q in range(len(v) - len(m) + 1) for p in seeds.get((k, *(v[q + x] for x, b in enumerate(m) if b == "1")), [])}
            n = min(len(v), dc.WINDOW)
            found = []
            for lie in lies:
                e = [int(0 <= lie + j < len(w) and w[lie + j] == v[j]) for j in range(len(v))]
                found += [(-sum(e[j : j + n]), lie + j) for j in range(len(v) - n + 1)]
            if found and -100 * min(found)[0] >= dc.PERCENT * n:
                out.add((d, i, min(found)[1], -min(found)[0], n))
    return out


@pytest.fixture(scope="module")
def fixture():
    r = random.Random(5)
    vocabulary = [f"v{i}é" for i in range(3000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([5, 9, 15, 40])))) for i in range(12)] + [(50, None), (51, ""), (52, "a b")]
    docs = []
    for d in range(60):
        text = r.choices(vocabulary, k=r.choice([0, 3, 80, 400]))
        if d % 2:
            passage = r.choice(items[:12])[1].split()
            if d % 4 == 1:  # every fifth word is another
                passage = [w if k % 5 else "other" for k, w in enumerate(passage)]
            cut = r.choice([0, 0, 4])
            text = text[:40] + passage[cut:] + text[40:]
        docs.append((d, ", ".join(text).title()))
    return docs, items


def test_against_brute_force(spark, fixture):
    docs, items = fixture
    more = docs + [(100, None), (101, ""), (7, docs[7][1]), (102, "x " * 30_000)]
    d = spark.createDataFrame([(*x, "y") for x in more], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in dc.contaminated(d, b).drop("h").collect()}
    assert got == brute(docs, items)
    assert len({x[0] for x in got}) >= 8
    left = {r.doc_id for r in dc.without_contaminated(d, b).collect()}
    assert left == {x[0] for x in more} - {x[0] for x in got}


def joined_on(plan, column):
    """Columns of both sides of the physical join whose condition or keys name the column."""
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    found = [n for c in children for n in joined_on(c, column)]
    if "Join" in plan.nodeName() and column in plan.leftKeys().toString():
        found += [{c.output().apply(i).name() for i in range(c.output().size())} for c in children]
    return found


def test_more_seeds_than_a_broadcast_holds(spark, fixture, monkeypatch):
    docs, items = fixture
    docs = [*docs, (100, None), (101, ""), (7, docs[7][1]), (102, "x " * 9000 + items[3][1] + " y" * 70), (None, items[2][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    held = sorted(map(str, dc.contaminated(d, b).collect()))
    assert any("doc_id=102" in x for x in held) and any("doc_id=None" in x for x in held)
    monkeypatch.setattr(dc, "MAX_BROADCAST", 0)
    for size in (4096, 7):
        monkeypatch.setattr(dc, "PIECE", size)
        assert sorted(map(str, dc.contaminated(d, b).collect())) == held
    sides = joined_on(dc.contaminated(d, b)._jdf.queryExecution().sparkPlan(), "seed")
    assert len(sides) == 2 and not any({"words", "item", "text"} & side for side in sides)


def test_substitutions_are_tolerated(spark):
    passage = [f"p{i}" for i in range(30)]
    changed = [w if k % 5 != 2 else f"q{k}" for k, w in enumerate(passage)]
    docs = [(1, "start " + " ".join(changed) + " end"), (2, " ".join(passage[:15])), (3, " ".join(passage[:9])), (4, " ".join(reversed(passage))), (None, " ".join(passage))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(passage))], "item_id long, text string")
    assert {r.doc_id for r in dc.contaminated(d, b).collect()} == {1, 2, None}
    assert {r.doc_id for r in dc.without_contaminated(d, b).collect()} == {3, 4}
    assert dc.contaminated(d, b.limit(0)).count() == 0 == dc.contaminated(d.limit(0), b).count()


def test_no_python_in_the_plan(spark, fixture):
    d, b = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(fixture, ("doc_id", "item_id")))
    plan = dc.without_contaminated(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_masks_hit_every_layout():
    for n in range(1, dc.WINDOW + 1):
        masks = [m for m, (least, most) in dc.LENGTHS.items() if least <= n <= most and len(m) <= n]
        for out in combinations(range(n), n - -(-dc.PERCENT * n // 100)):
            assert any(not {at + i for i, b in enumerate(m) if b == "1"} & set(out) for m in masks for at in range(n - len(m) + 1)), (n, out)


def unseeded(docs, items):
    """Every alignment, without seeds."""
    out = set()
    for d, text in docs:
        w = words(text)
        for i, other in items:
            v = words(other)
            n = min(len(v), dc.WINDOW)
            found = []
            for lie in range(1 - len(v), len(w)):
                e = [int(0 <= lie + j < len(w) and w[lie + j] == v[j]) for j in range(len(v))]
                found += [(-sum(e[j : j + n]), lie + j) for j in range(len(v) - n + 1)]
            if found and -100 * min(found)[0] >= dc.PERCENT * n:
                out.add((d, i, min(found)[1], -min(found)[0], n))
    return out


def test_every_alignment_is_found(spark):
    r = random.Random(8)
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (*range(1, 16), 31)]
    docs = [("a", " ".join(w if k % 4 else "other" for k, w in enumerate(items[-1][1].split()))), ("b", None), ("c", "")]
    for n, text in items[:-1]:
        layouts = list(combinations(range(n), n // 5)) + list(combinations(range(n), n // 5 + 1))
        for out in layouts if n < 15 else r.sample(layouts, 60) + [(3, 7, 11), (6, 7, 8)]:
            docs.append((f"{n} {out}", " ".join(["x", "y"] * r.randrange(2) + [w if k not in out else "other" for k, w in enumerate(text.split())] + ["z"] * r.randrange(2))))
    d, b = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in dc.contaminated(d, b).drop("h").collect()}
    assert got == unseeded(docs, items)
    assert {"a", "15 (3, 7, 11)", "15 (6, 7, 8)", "1 ()", "6 (3,)"} <= {x[0] for x in got}
