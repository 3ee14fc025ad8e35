import random

import pytest

from corpusloom.llm import op04_mixing as op


def targets(size):
    """The contract's rule, step by step."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(size.values()))
    while left > 1e-9 and free:
        w = sum(weight[s] for s in free)
        for s in free:
            out[s] += left * weight[s] / w
        left = 0.0
        for s in list(free):
            if out[s] >= 3 * size[s]:
                left += out[s] - 3 * size[s]
                out[s] = 3.0 * size[s]
                free.discard(s)
    return out


def highest_quotients(shares, total):
    got = [0] * len(shares)
    for _ in range(total):
        i = max(range(len(shares)), key=lambda i: (shares[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


@pytest.mark.parametrize("shard_tokens", [4_000_000, 900])
def test_targets_and_takings(spark, monkeypatch, shard_tokens):
    monkeypatch.setattr(op, "SHARD_TOKENS", shard_tokens)
    rnd = random.Random(2)
    rows = [(d, rnd.choice(["a", "a", "a", "Z", "é", None, "tiny" if d % 40 == 0 else "b"]), " ".join(["w"] * rnd.choice([0, 1, 7, 60, 300]))) for d in range(300)]
    rows += [(301, "a", None), (None, "b", "x y z"), (5, "a", "x y"), (5, "a", "x y")]
    df = spark.createDataFrame([(*r, 0, "t", 1) for r in rows], "doc_id long, source string, text string, size int, target string, seats int")
    got = op.mix(df).collect()
    assert len(got) == len(rows)
    size, taken = {}, {}
    for r in got:
        assert r["size"] == len((r.text or "").split()) and 0 <= r.taken <= 3 * r["size"]
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = targets(size)
    shards = {s: -(-max(1, n) // shard_tokens) for s, n in size.items()}
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= op.BLOCK * (1 + 4 * shards[s])
    again = op.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_seats_are_the_highest_quotients(spark):
    from pyspark.sql import functions as F

    for shares, total in (([100.0, 50.0, 7.0, 0.0, 1.5], 29), ([1.0] * 9, 4), ([1000.0] + [3.0] * 30, 55)):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(shares)], "u int, x double")
        got = {r.u: r.seats for r in op.seats(df, [], F.lit(total).cast("long"), F.col("x"), [F.col("u"), F.col("_s")]).collect()}
        assert [got[i] for i in range(len(shares))] == highest_quotients(shares, total)


def test_empty(spark):
    assert op.mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    assert [tuple(r)[3:] for r in op.mix(spark.createDataFrame([(1, "s", "")], "doc_id long, source string, text string")).collect()] == [(0, 0, 0.0, 0)]
