import re
from collections import Counter

from corpusloom.llm.op03_quality_rules import clean, judge

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "The quiet river turned south past the mill and the old road followed it home."


def brute(t):
    w = WORD.findall(t or "")
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t", PROSE, "a b c d e " * 9, "x y z\n" * 5 + PROSE, "a b c d e f a b c d e g\x0b\x0ch", "é ü | # * $ % & < >\n\n é", "x" * 200_000, "w " * 30_000,
         "Home | About | Contact\n" + PROSE, PROSE + "\n### $$$ %%% ***", "All rights reserved.\n" * 8 + "Some words stand here.", "1 2 3 4 5 6 7 8 9 10 11 12"]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(TEXTS)], "doc_id long, text string, _n string, n_words int, _words string")
    got = {r.doc_id: r for r in judge(df).collect()}
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert [i for i, r in got.items() if r.kept] == [3, 10, 11]


def test_clean_removes_lines_and_keeps_columns(spark):
    df = spark.createDataFrame([(1, "Home | About | Contact\n" + PROSE, "s"), (1, PROSE, None), (None, "too short", "s")], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in clean(df).fillna("").collect()) == [(1, PROSE, ""), (1, PROSE, "s")]
    assert judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clean_keeps_clashing_columns(spark):
    names = ["_text", "_words", "_lines", "_solid", "_n", "_hash", "_good", "_row", "kept", "n_words"]
    df = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve.", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    (row,) = clean(df).collect()
    assert row.asDict() == df.first().asDict()
