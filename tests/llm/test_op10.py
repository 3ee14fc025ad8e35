import random

import pytest

from corpusloom.llm import op10_near_dedup as op
from corpusloom.llm.op10_near_dedup import near_duplicates

DDL = "doc_id long, text string, key string, band string, a string, n_shingles string"


def brute(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)}


def made(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, d = [], 0
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 5, 6, 8, 20, 60, 200]))]
        for _ in range(rnd.choice([1, 1, 3, 6])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            rows.append((d, " ".join(w)))
            d += 1
    base = [rnd.choice(vocab) for _ in range(120)]
    for _ in range(60):  # one large group of near copies, many not near its centre
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 3, 4, 5, 6])):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append((d, " ".join(w)))
        d += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1000, 7])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rows = made() + [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "A b"), (1004, "a\tB"), (1005, "é É")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], DDL).repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_repeats_nulls_empty(spark):
    t = "one two three four five six seven"
    got = near_duplicates(spark.createDataFrame([(7, t), (7, t), (None, t), (3, "other words here now then"), (None, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (-1, 7, False), (3, 3, True), (7, 7, True), (7, 7, True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_null_ids_and_long_texts(spark, monkeypatch):
    """Nulls join by text, not by doc_id; blocks are bounded in bytes."""
    monkeypatch.setattr(op, "BLOCK_BYTES", 2000)
    rnd = random.Random(5)
    rows = [(None, " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randrange(50)) for _ in range(30))) for _ in range(400)]
    rows += made(8) + [(5000, " ".join(f"v{i}" for i in range(60_000)))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == want
