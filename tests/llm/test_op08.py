import random
from collections import Counter

import pytest

from corpusloom.llm import common
from corpusloom.llm import op08_decontaminate as op


def grams(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            if not v:
                continue
            k, best = min(5, len(v)), None
            for s in range(max(1, len(w) - len(v) + 1)):
                a, b = grams(w[s : s + len(v)], k), grams(v, k)
                common, union = sum((a & b).values()), sum((a | b).values())
                if 100 * common >= 75 * union and common and (best is None or common / union > best[1]):
                    best = (s, common / union)
            if best:
                out[d, i] = best
    return out


def made():
    rnd = random.Random(11)
    some = lambda n: [f"Wort{rnd.randrange(300)}" for _ in range(n)]
    items = [some(n) for n in (3, 8, 20, 20, 37, 59)] + [["a", "b", "a", "b", "a", "b", "a", "b", "a", "b"]]
    docs = []
    for d in range(80):
        w = some(rnd.choice([0, 4, 30, 120]))
        x = list(rnd.choice(items))
        change = rnd.choice([0, 0, 0, 1, 2, 5])
        for _ in range(change):
            x[rnd.randrange(len(x))] = "other"
        if rnd.random() < 0.3:
            x = x[: len(x) - rnd.choice([1, 2, 3])]
        if rnd.random() < 0.7:
            i = rnd.randrange(len(w) + 1)
            w[i:i] = x
        docs.append((d, rnd.choice([" ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (92, "a b " * 50)]
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)] + [(50, None), (51, " ")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_ROWS", limit)
    docs, items = made()
    d = spark.createDataFrame([(*r, 1, "w", 1) for r in docs], "doc_id long, text string, size int, words string, k int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start, round(r.similarity, 9)) for r in op.matches(d, b).collect()}
    want = {k: round(v[1], 9) for k, v in brute(docs, items).items()}
    assert {k: v[1] for k, v in got.items()} == want
    clean = {r.doc_id for r in op.decontaminate(d, b).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in want}


def test_empty_tables_and_null_ids(spark):
    d = spark.createDataFrame([(None, "one two three four five six"), (1, "x")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four five six")], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.start) for r in op.matches(d, b).collect()] == [(None, 7, 0)]
    assert [r.doc_id for r in op.decontaminate(d, b).collect()] == [1]
    assert op.matches(d, b.limit(0)).count() == 0 and op.matches(d.limit(0), b).count() == 0 and op.decontaminate(d, b.limit(0)).count() == 2


def test_only_texts_with_a_hit_are_shuffled(spark, monkeypatch, tmp_path):
    """Places of hits that are too large to broadcast: the semi-join with their keys stands below the exchange of texts."""
    rows = [(d, f"word{d} " * 50 + ("a b c d e f " * 40 if d % 10 == 0 else "")) for d in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    docs, items = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame([(1, "a b c d e f " * 5)], "item_id long, text string")
    monkeypatch.setattr(common, "BROADCAST_BYTES", 5000)
    plans, kept = [], op.materialize

    def noted(df, tag):
        if tag == "windows":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag)

    monkeypatch.setattr(op, "materialize", noted)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {r.doc_id for r in op.matches(docs, items).collect()} == set(range(0, 200, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    (plan,) = plans
    text = next(i for i, x in enumerate(plan.split("\n")) if "SortMergeJoin" in x)
    under = plan.split("\n")[text:]
    exchange = next(i for i, x in enumerate(under) if "Exchange hashpartitioning" in x)
    assert "BroadcastHashJoin" in "".join(under[exchange:]) and "LeftSemi" in "".join(under[exchange:])
