import random

from corpusloom.llm import op07_chat_format as op

DDL = "conv_id long, turn long, role string, text string, k string, piece int"


def brute(rows):
    convs = {}
    for c, t, r, x in set(rows):
        convs.setdefault(c, []).append((t if t is not None else -1, r or "", x or "", r, x))
    convs = {c: [(r, x) for *_, r, x in sorted(v, key=lambda y: y[:3])] for c, v in convs.items()}
    key = lambda c: (c is not None, c or 0)
    kept = {c: v for c, v in convs.items() if not any(d != c and w[: len(v)] == v and (len(w) > len(v) or key(d) < key(c)) for d, w in convs.items())}
    return {c: "\n".join(f"<|{r or 'unknown'}|>\n{(x or '').replace('<|', '< |')}<|end|>" for r, x in v) for c, v in kept.items()}


def made():
    rnd = random.Random(4)
    rows, c = [], 0
    for _ in range(30):
        base = [(rnd.choice(["user", "assistant"]), rnd.choice(["Hi", "Hi", "ok", f"x{rnd.randrange(9)}"])) for _ in range(rnd.choice([1, 2, 5, 30]))]
        for _ in range(rnd.choice([1, 2, 4])):
            cut, off = rnd.randrange(1, len(base) + 1), rnd.choice([0, 1, 250])
            rows += [(c, off + i, r, t) for i, (r, t) in enumerate(base[:cut])]
            c += 1
    rows += rows[:7]
    rows += [(None, 0, "user", "Hi"), (500, None, None, None), (500, 1, "user", "<|user|>"), (501, 3, "b", "y"), (501, 3, "a", "z"), (501, 3, "a", None)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    for seg, piece in ((256, 256), (3, 4)):
        monkeypatch.setattr(op, "SEGMENT", seg)
        monkeypatch.setattr(op, "PIECE", piece)
        got = {}
        for r in sorted(op.render(spark.createDataFrame([(*r, "k", 1) for r in rows], DDL).repartition(4)).collect(), key=lambda r: r.piece):
            got[r.conv_id] = got[r.conv_id] + "\n" + r.text if r.piece else r.text
        assert got == brute(rows)


def test_empty(spark):
    assert op.render(spark.createDataFrame([], DDL)).count() == 0
