import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import op05_lm_score as op
from corpusloom.llm.gru import Gru

WORDS = {"en": "the of and to in is that it was for".split(), "fr": "le la de et un une que dans pour est".split()}


def made():
    rnd = random.Random(12)
    rows = []
    for d in range(150):
        lang = rnd.choice(["en", "fr"])
        end = {"en": "ing", "fr": "eau"}[lang]
        w = [rnd.choice(WORDS[lang]) if rnd.random() < 0.7 else f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{rnd.choice('klmnp')}{end}" for _ in range(rnd.choice([0, 1, 40, 150]))]
        rows.append((d, rnd.choice([" ", "\n"]).join(w).capitalize()))
    return rows + [(300, None), (301, ""), (None, "the the le"), (302, "the of and " * 4000), (7, "Again seven"), (7, "Again seven")]


def tokens(t):
    return (t or "").encode().lower().split() + [None]


@pytest.mark.parametrize("chunk", [24_000_000, 2_000])
def test_counts_and_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(op, "CHUNK", chunk)
    rows = made()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c = Counter(w for d, t in rows if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, kind string, n int").repartition(3)
    got = op.score(df).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_tokens): r for r in got}
    for d, t in rows:
        w = tokens(t)
        r = by[d, len(w)]
        assert (r.held_out, r.n_known, r.train_tokens) == (held(d), sum(c[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) < 1e-6 * max(1, len(w))
        assert math.isfinite(r.score) and r.score < 0
    own = [r for r in got if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)  # the network predicts held-out text better


def test_network_probabilities_sum_to_one_and_state_is_carried():
    net = Gru(70, 4, seed=3)
    s = np.random.default_rng(0).normal(size=(5, 16)).astype(np.float32)
    total = sum(np.exp(net.log_probs(s, np.full(5, i))) for i in range(74))
    assert np.allclose(total, 1, atol=1e-4)
    ids = np.random.default_rng(1).integers(0, 74, 900)
    sizes = np.array([1, 500, 399])
    starts = np.cumsum(sizes) - sizes
    got = net.score(ids, starts, sizes, lanes=2)
    for k in range(3):
        h, last, want = np.zeros((1, 16), np.float32), 74, 0.0
        for i in ids[starts[k] : starts[k] + sizes[k]]:
            h = net.step(net.wx[[last]] + net.bh, h)
            want += net.log_probs(h, np.array([i]))[0]
            last = i
        assert abs(got[k] - want) < 1e-2


def test_gradient_against_differences():
    net = Gru(40, 3, seed=2)
    for n in net.NAMES:
        setattr(net, n, getattr(net, n).astype(np.float64))
    rnd = np.random.default_rng(4)
    x, y, h = rnd.integers(0, 43, (3, 6)), rnd.integers(0, 43, (3, 6)), rnd.normal(size=(3, 16))

    def loss():
        s, total = h, 0.0
        for t in range(6):
            s = net.step(net.wx[x[:, t]] + net.bh, s)
            total -= net.log_probs(s, y[:, t]).sum()
        return total / 18

    g, _ = net.gradient(x, y, h, 43)
    for n in net.NAMES:
        a = getattr(net, n)
        for _ in range(4):
            i = tuple(rnd.integers(0, k) for k in a.shape) if n != "wx" else (x[0, 0], rnd.integers(0, a.shape[1]))
            old, e = a[i], 1e-5
            a[i] = old + e
            up = loss()
            a[i] = old - e
            down = loss()
            a[i] = old
            assert abs((up - down) / (2 * e) - g[n][i]) < 1e-5, n


def test_empty(spark):
    assert op.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_teach_and_words_grow_with_the_vocabulary(spark):
    """Documents without an id, over 512 words of one ending, each word followed by the same one."""
    words = [f"{a}{b}{c}ing" for a in "bcdfghklmn" for b in "aeiou" for c in "bcdfghklmnprst"]
    rows = [(None, " ".join(words[(7 * d + i) % 700] for i in range(700))) for d in range(60)]
    got = op.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert all(r.doc_id is None and not r.held_out for r in got)
    assert sum(r.score for r in got) > 0.99 * sum(r.base_score for r in got)
    lexicon = op.Lexicon([(w.encode(), 60) for w in words], {0: (700 * 60, 700), op.MOST_RARE: (60, 0)})
    assert len(lexicon.place) == 701
    payload = op._put(np.zeros(2, np.int64).tobytes(), np.array([True, False]).tobytes(), np.array([True, True]).tobytes(), np.array([2, 1], np.int32).tobytes(), np.array([1, 0, 0], np.int32).tobytes(), op._join([op.END, words[0].encode()]))
    assert [x.tolist() for x in op._lessons(payload, lexicon)] == [[1, 0], [0]]


def test_words_are_numbered_by_first_use():
    words = b"a b a c b d a \xc3\xa9 d".split()
    place = op.Places({op.END: 0})
    assert list(map(place.__getitem__, words)) == [1, 2, 1, 3, 2, 4, 1, 5, 4]
    assert list(place) == [op.END, b"a", b"b", b"c", b"d", b"\xc3\xa9"]
