"""Interval, sampling, stateful and sequence operators against plain Python, with the boundary cases."""

import itertools
import math
import random
import time

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import intervals, ngrams, sampling, sequences, stateful


def test_merge_is_inclusive_disjoint_and_idempotent(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.5, 2.0), ("a", 2.51, 3.0), ("a", 0.2, 0.4), ("a", 10.0, 20.0), ("a", 11.0, 12.0), ("b", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "k string, s double, f double")
    got = sorted(tuple(r) for r in intervals.merge(df, "k", "s", "f", 0.5).collect())
    assert got == [("a", 0.0, 2.0, 3), ("a", 2.51, 3.0, 1), ("a", 10.0, 20.0, 2), ("b", 5.0, 6.0, 1)]
    again = intervals.merge(intervals.merge(df, "k", "s", "f", 0.5).select("k", F.col("start").alias("s"), F.col("end").alias("f")), "k", "s", "f", 0.5)
    assert sorted(tuple(r)[:3] for r in again.collect()) == [x[:3] for x in got]


def test_hopping_is_half_open(spark):
    df = spark.createDataFrame([("a", x) for x in (0.0, 0.99, 1.0, 1.5, 2.0, 3.7)], "k string, mid double")
    got = sorted((r.mid, r.window_start) for r in intervals.hopping(df, "k", F.col("mid"), F.lit(0.0), 2.0, 1.0).collect())
    assert got == sorted((x, float(k)) for x in (0.0, 0.99, 1.0, 1.5, 2.0, 3.7) for k in range(6) if k <= x < k + 2)


def test_semi_windows_boundaries(spark):
    w = spark.createDataFrame([(1, "a", 0.0, 2.0), (2, "a", 2.0, 4.0), (3, "a", 8.0, 10.0), (4, "b", 0.0, 2.0)], "id int, k string, start double, end double")
    i = spark.createDataFrame([("a", 1.0, 2.25), ("a", 9.8, 30.0)], "k string, start double, end double")
    assert sorted(r.id for r in intervals.semi_windows(w, i, "k", 0.25).collect()) == [1, 2]
    assert intervals.semi_windows(w, i.limit(0), "k", 0.25).count() == 0


def test_splits(spark):
    for n in (1, 2, 3, 10, 57):
        got = [r.split for r in sampling.grouped_split(spark.range(n).select((F.col("id") % n).alias("g")), "g").collect()]
        k = max(1, round(0.1 * n))
        assert len(got) == n and got.count("val") == min(n, k) and got.count("test") == max(0, min(n - k, k))


def test_even_limit(spark):
    for n, m in ((3, 5), (5, 5), (7, 3), (100, 10), (9, 1)):
        got = sorted(r.i for r in sampling.even_limit(spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("i")), "g", ["i"], m).collect())
        assert got == (list(range(n)) if n <= m else [0] if m == 1 else sorted({round(j * (n - 1) / (m - 1)) for j in range(m)}))


def test_tracks(spark):
    rows = [("v", 0, 0, 0.0, 0.0), ("v", 0, 1, 10.0, 0.0), ("v", 1, 0, 9.0, 0.0), ("v", 1, 1, 1.0, 0.0), ("v", 3, 0, 1.0, 3.0), ("v", 3, 1, 1.0, 3.0), ("v", 4, 0, 50.0, 50.0)]
    got = stateful.assign_tracks(spark.createDataFrame(rows, "key string, frame int, pos int, cx double, cy double"), "key", 3.0)
    assert {(r.frame, r.pos): r.track for r in got.collect()} == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (1, 1): 0, (3, 0): 0, (3, 1): 2, (4, 0): 3}


def test_beam_search_against_enumeration():
    lp = np.log(np.random.default_rng(5).dirichlet(np.ones(3), 4))
    total = {}
    for path in itertools.product(range(3), repeat=4):
        out = tuple(c for c, _ in itertools.groupby(path) if c)
        total[out] = np.logaddexp(total.get(out, -math.inf), sum(lp[t, c] for t, c in enumerate(path)))
    best = sorted(total.items(), key=lambda x: -x[1])
    got = stateful.beam_search(lp, 1000, 0)
    assert [p for p, _ in got[:5]] == [p for p, _ in best[:5]] and all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(got, best))


def test_greedy_cases(spark):
    def lp(labels):
        return [[0.0 if c == x else -5.0 for c in range(3)] for x in labels]

    cases = {1: [0, 0, 0], 2: [1, 0, 1], 3: [1, 1], 4: [0, 1, 2, 2, 0], 5: [2]}
    df = spark.createDataFrame([(k, t, v) for k, x in cases.items() for t, v in enumerate(lp(x))], "k long, t int, lp array<double>")
    assert {r.k: r.decoded for r in sequences.greedy(df, "k", 0).collect()} == {1: "", 2: "1 1", 3: "1", 4: "1 2", 5: "2"}


def test_alignment_and_confusion(spark):
    assert stateful.align(list("abc"), list("axc")) == [("a", "a"), ("b", "x"), ("c", "c")]
    assert stateful.align(["a"], []) == [("a", None)] and stateful.align([], ["b"]) == [(None, "b")]
    df = spark.createDataFrame([(["a", "b"], ["a", "c"]), (["a"], ["a"])], "target array<string>, got array<string>")
    assert {(r.target_unit, r.got_unit): r.n for r in stateful.confusion(df).collect()} == {("a", "a"): 2, ("b", "c"): 1}


def test_correction_uses_corrected_context(spark):
    counts, pairs = {"the": 9, "cat": 5, "cap": 5, "red": 4}, {("the", "cat"): 4, ("red", "cap"): 4}
    df = spark.createDataFrame([(1, ["thw", "caz"]), (2, ["red", "caz"]), (3, []), (4, ["zzzzzz"])], "id long, tok array<string>")
    assert {r.id: list(r.tok) for r in stateful.correct_tokens(df, counts, pairs).collect()} == {1: ["the", "cat"], 2: ["red", "cap"], 3: [], 4: ["zzzzzz"]}


def test_close_words_are_all_found():
    rnd = random.Random(4)
    some = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    vocab = sorted({some(rnd.randrange(1, 7)) for _ in range(150)})
    for most in (0, 1, 2):
        close = stateful.close_lookup(vocab, most)
        for w in [some(rnd.randrange(9)) for _ in range(200)] + ["x" * 5000]:
            assert sorted(close(w)) == sorted((d, v) for v in vocab if (d := stateful.edits(w, v, 9)) <= most)


def test_correction_does_not_compare_with_the_whole_vocabulary(spark):
    """4000 distinct words against 4000 of their length, in one task; all pairs would take minutes."""
    rnd = random.Random(5)
    some = lambda: "".join(rnd.choice("abcdefghij") for _ in range(9))
    counts, words = {some(): 1 for _ in range(4000)}, [some() for _ in range(4000)]
    first = min(counts)
    df = spark.createDataFrame([(1, [*words, "x" + first[1:]])], "id long, tok array<string>").coalesce(1)
    began = time.monotonic()
    (row,) = stateful.correct_tokens(df, counts, {}).collect()
    assert time.monotonic() - began < 30 and len(row.tok) == 4001 and stateful.edits(row.tok[-1], first, 2) <= 2


def test_smooth_boxes_truncates(spark):
    df = spark.createDataFrame([(1, f, x) for f, x in enumerate([10, 21, 21])], "k int, frame int, x int")
    assert list(stateful.smooth_boxes(df, "k", 0.5).first().smoothed) == [10, 15, 18]


def test_captions(spark):
    text = "WEBVTT\n\n00:01.000 --> 00:02.500 align:start\n<c>Hi</c> [noise]\nthere\n\n00:03.000 --> 00:04.000\n\n01:00:00.000 --> 01:00:01.000\nend"
    got = spark.createDataFrame([(text,), (None,)], "s string").select(stateful.parse_captions("s").alias("c")).collect()
    assert [tuple(x) for x in got[0].c] == [(1.0, 2.5, "Hi there"), (3600.0, 3601.0, "end")] and got[1].c == []


def test_ngrams_of_a_stream_with_short_documents_and_null_ids(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"]), (None, ["d", "e", "f", "g"])], "doc_id long, tok array<string>")
    for k in (1, 2, 3):
        got = sorted("".join(r[:k]) for r in ngrams.counts(df, k).collect())
        assert got == sorted("abcdefg"[i : i + k] for i in range(8 - k))
