import hashlib
import random
from collections import Counter

from corpusloom.llm import op09_substring_dedup as op


def brute(rows, size=35):
    lists = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in lists for i in range(len(w) - size + 1))
    out = []
    for (d, _), w in zip(rows, lists):
        gone = set()
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def made():
    rnd = random.Random(5)
    vocab = [f"wörd{i}" for i in range(50)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passages = [some(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for d in range(120):
        w = some(rnd.choice([0, 1, 34, 35, 40, 100, 400]))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            i = rnd.randrange(len(w) + 1)
            w[i:i] = rnd.choice(passages)
        rows.append((d, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows.append((200, " ".join(["same"] * 90)))  # repeats itself, overlapping
    rows += [(201, None), (202, ""), (203, "one word only"), (None, " ".join(passages[3])), (5, " ".join(passages[4])), (5, " ".join(passages[4])), (6, "other text")]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    for chunk, parts in ((12_000_000, 1), (3_000, 7)):
        monkeypatch.setattr(op, "CHUNK", chunk)
        df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, packed string, ranges string, bucket int").repartition(parts)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in op.remove_repeats(df).collect()), key=str)
        assert got == brute(rows)


def test_hash_collisions_do_not_count():
    import numpy as np

    words = [b"a"] * 35 + [b"b"] * 35 + [b"a"] * 35 + [b"c"] * 35
    many, later = op.repeated(words, np.array([0, 35, 70, 105]), np.array([35, 70, 105, 140]), np.zeros(4, np.uint64))
    assert many.tolist() == [True, False, True, False] and later.tolist() == [False, False, True, False]


def test_empty(spark):
    assert op.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
