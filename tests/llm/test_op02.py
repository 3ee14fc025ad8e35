import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from corpusloom.llm import op02_pii as op


def brute(t):
    t = t or ""
    out = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    for k, p, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and op.luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ):
        out += [(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])]
    return out


def texts():
    rnd = random.Random(1)
    alphabet = ["a", "b.", "@", ".", "-", " ", "1", "25", "4111111111111111", "10.0.0.1", "+1", "(", ")", "é", "x@y.z", "\n", "%", "_", "255", "256", "00"]
    out = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    return out + [None, "", "a@b@c.d", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "9" * 3000, "1.0000255.3.4", "+1 (555) 123-4567.", "é a.b+c%d@h-1.x.y. ü 4111 1111-1111 1111"]


def test_base_spans_match_the_patterns():
    for t in texts():
        got = op.base_spans(t or "")
        assert [(k, s, e) for k in op.KINDS for s, e in got[k]] == brute(t), t


@pytest.fixture(scope="module")
def field():
    return op.fit()


def test_decoding_and_likelihood_against_enumeration():
    rnd = np.random.default_rng(3)
    f = op.Field()
    f.step = rnd.normal(size=f.step.shape)
    n, segments = 5, [(0, 2), (1, 3), (2, 3), (2, 5), (4, 5)]
    scores = rnd.normal(size=(len(segments), 4))
    ways = []
    for size in range(4):
        for ks in itertools.combinations(range(len(segments)), size):
            if all(segments[a][1] <= segments[b][0] for a, b in itertools.pairwise(ks)):
                for ys in itertools.product(range(1, 5), repeat=size):
                    total, at, before = 0.0, 0, 0
                    for k, y in [*zip(ks, ys), (None, 0)]:
                        i, j = segments[k] if k is not None else (n, n)
                        for _ in range(i - at):
                            total, before = total + f.step[before, 0], 0
                        if k is not None:
                            total, at, before = total + f.step[before, y] + scores[k, y - 1], j, y
                    ways.append((total, [(*segments[k], y) for k, y in zip(ks, ys)]))
    assert f.decode(n, segments, scores) == max(ways)[1]
    z = np.logaddexp.reduce([w for w, _ in ways])
    p, _ = f.marginals(n, segments, scores)
    for k, y in itertools.product(range(len(segments)), range(1, 5)):
        want = sum(np.exp(w - z) for w, found in ways if (*segments[k], y) in found)
        assert abs(p[k, y - 1] - want) < 1e-9


def test_held_out_sentences(field):
    rnd = random.Random(99)
    right = wrong = missed = 0
    for _ in range(300):
        t, spans = op._sentence(rnd)
        got = field.find(t)
        right, wrong, missed = right + len(set(got) & set(spans)), wrong + len(set(got) - set(spans)), missed + len(set(spans) - set(got))
    assert right >= 0.93 * (right + missed) and wrong <= 0.1 * right


def test_query_rows(spark, monkeypatch, field):
    monkeypatch.setattr(op, "fit", lambda: field)
    rows = [(i, t) for i, t in enumerate(texts()[-100:])] + [(None, "mail jo.doe (at) host.com now"), (7, "x" * 300_000 + " 10.0.0.1"), (7, "1 2 3 " * 1000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, n_ip int, spans string")
    got = {(r.doc_id, r.base_sha256): r for r in op.find(df).collect()}
    for d, t in rows:
        want = brute(t)
        r = got[d, hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, *_ in want) for k in op.KINDS)
        if d is None:
            assert r.spans == "email:5:25"
    assert op.find(df.limit(0)).count() == 0


def test_region_holds_long_tokens():
    t = "q" * 200 + " (at) example.com and more"
    assert op.regions(t)[0][0] == 0
