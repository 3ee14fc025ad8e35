import random

from pyspark.sql import functions as F

from corpusloom.llm import op01_line_dedup
from corpusloom.llm.op01_line_dedup import PIECE, _named, _near, _odd, _pieces, _shingles, dedup_lines


def grams(x):
    x = x.lower()
    return {x[i : i + 12] for i in range(len(x) - 11)} if len(x) >= 12 else {x}


def brute(rows):
    lines = [(d, no, x) for d, t in rows for no, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    sets = [grams(x) for *_, x in lines]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)), key=lambda k: lines[k][:2])
                root[b] = a
    gone = {lines[i][:2] for i in range(len(lines)) if find(i) != i}
    return {d: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone) for d, t in rows}


def test_against_brute_force(spark):
    rnd = random.Random(6)
    vocab = ["".join(rnd.choice("abcdeéünorst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    some = lambda n: [rnd.choice(vocab) for _ in range(n)]
    bases = [some(n) for n in (1, 3, 12, 30, 30, 60, 150)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randrange(6)):
            w = list(rnd.choice(bases)) if rnd.random() < 0.5 else some(rnd.choice([2, 10, 30]))
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
            lines.append(rnd.choice(["", "", " "]) + " ".join(w))
            if rnd.random() < 0.2:
                lines.append(rnd.choice(["", "  "]))
        rows.append((d, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "short\nShort\nshort\n"), (103, "x" * 50_000)]
    df = spark.createDataFrame([(*r, 1, "c", "g") for r in rows], "doc_id long, text string, id int, check string, gone string").repartition(4)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    want = brute(rows)
    assert {d: r.text for d, r in got.items()} == want
    assert all(r.gone == "g" for r in got.values())
    assert (got[102].n_lines, got[102].n_removed) == (3, 2)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "the same line of text"), (1, "the same line of text\nown words in this one"), (2, "other"), (2, "other")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in dedup_lines(df).collect()) == [(0, "the same line of text"), (1, "own words in this one"), (2, "other"), (2, "other")]
    assert dedup_lines(df.limit(0)).count() == 0


def test_repeating_and_short_lines(spark):
    """Sets of few shingles: long lines that repeat themselves, and lines of 18 to 25 characters."""
    rnd = random.Random(9)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnop") for _ in range(n))
    rows = []
    for d in range(0, 240, 2):
        unit = some(rnd.choice([2, 3, 5, 9]))
        n = rnd.choice([200, 500, 1000]) // len(unit)
        rows += [(d, unit * n), (d + 1, unit * (n + rnd.randrange(1, 2 * n)))]
    for d in range(300, 900, 2):
        line = some(rnd.randrange(18, 24))
        rows += [(d, line), (d + 1, line + some(2))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == brute(rows)


def test_recall_at_the_threshold_by_size(spark):
    """One-line documents in pairs whose similarity is 3/4 or just over, of 4 to 64 shingles."""
    rnd = random.Random(12)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    for shingles in (4, 8, 16, 64):
        rows = []
        for d in range(0, 1200, 2):
            line = some(shingles + 11)
            rows += [(d, line), (d + 1, line[: len(line) - shingles // 4])]
        got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
        assert sum(got.values()) >= 0.99 * 600 and not any(got[d] for d in range(0, 1200, 2))


def test_clashing_columns_stay(spark):
    names = ["_id", "_hash", "_gone", "_all", "line", "id", "check", "band", "component", "n", "a", "b", "text_hash", "line_no", "m0", "t0"]
    df = spark.createDataFrame([(1, "one line of words\nanother line", *names), (2, "One line of words", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = {r.doc_id: r.asDict() for r in dedup_lines(df).collect()}
    assert all(got[d][n] == n for d in (1, 2) for n in names)
    assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["text"]) == (0, 1, "")


def test_hot_bands_of_several_components(spark):
    """Edits of two long lines: bands of over HOT members that hold components and lines linked with none."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randrange(2, 9)))
    bases, rows = [[word() for _ in range(40)] for _ in range(2)], []
    for d in range(300):
        w = list(bases[d % 2])
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    want = brute(rows)
    assert 2 < sum(t != "" for t in want.values()) < 250
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[d] != want[d] for d in got) <= 1


def test_shingles_are_hashed_in_pieces(spark):
    """Hashes of all code-point shingles, of up to PIECE in a row; short, accented and astral lines included."""
    lines = ["a", "elf zeichen", "zwölf zeiche", "café \U0001f600 über \U0001f600 naïve straße", "ab" * 40, "x" * 26, "x" * 27, "é\U00010348" * 14]
    df = spark.createDataFrame(list(enumerate(lines)), "id long, line string")
    shingles = [(i, g) for i, line in enumerate(lines) for g in grams(line)]
    coded = F.xxhash64(F.encode("g", "UTF-32"))
    want = {(r.i, r.h) for r in spark.createDataFrame(shingles, "i long, g string").select("i", coded.alias("h")).collect()}
    rows = _pieces(df).collect()
    assert {(r.id, r[f"h{j}"]) for r in rows for j in range(PIECE)} == want
    assert len(rows) == sum(max(1, -(-(len(line) - 11) // PIECE)) for line in lines)
    sets = df.select("id", F.encode("line", "UTF-32").alias("code")).select("id", _shingles("code").alias("s")).collect()
    assert {(r.id, h) for r in sets for h in r.s} == want and sum(len(r.s) for r in sets) == len(want)


def test_few_jobs_for_hot_bands(spark):
    """What the driver holds grows with the plans it makes: components are made twice at most, without rounds or sketches."""
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdeimnorst") for _ in range(rnd.randrange(2, 9)))
    base, rows = [word() for _ in range(40)], []
    for d in range(150):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = word()
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.sparkContext.setJobGroup("few-jobs", "")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    want = brute(rows)
    assert sum(got[d] != want[d] for d in got) <= 1
    assert jobs < 120, jobs


def test_bits_lose_no_link(spark):
    """Lines of 1 to 3000 shingles and edits of them: every pair at the threshold passes, most others do not."""
    rnd = random.Random(5)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for n in (12, 20, 60, 300, 3000):
        base = some(n)
        lines += [base, base + some(n // 20), base[: n - n // 8], base[n // 4 :], base[: n // 2] + some(n // 2), some(n)]
    odd = _odd(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    near = {(r.a, r.b) for r in _named(odd, "a").crossJoin(_named(odd, "b")).where("a < b").where(_near("a", "b")).select("a", "b").collect()}
    sets = [grams(x) for x in lines]
    linked = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert linked <= near and len(near) < 3 * len(linked)
    assert {r.id: r.n for r in odd.collect()} == {i: len(s) for i, s in enumerate(sets)}


def test_sets_are_made_with_the_pair_and_bands_are_not_sorted(spark, monkeypatch):
    """No sets are gathered by an aggregate to confirm pairs, and no rows are sorted to find the bands of several lines."""
    plans, write = {}, op01_line_dedup.materialize

    def kept(df, tag, *more):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, *more)

    monkeypatch.setattr(op01_line_dedup, "materialize", kept)
    line = "a line of words that is long enough to hold a good many shingles of twelve"
    df = spark.createDataFrame([(1, line), (2, line + " or so"), (3, "Another line\n" + line), (4, "none alike")], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in dedup_lines(df).collect()}
    assert got == {1: (1, 0), 2: (1, 1), 3: (2, 1), 4: (1, 0)}
    assert plans["links"] and all("Aggregate" not in x.split("Scan")[0] for x in plans["links"])
    assert plans["members"] and all("SortAggregate" not in x and "SortMergeJoin" not in x for x in plans["members"])


def test_bits_tell_long_lines_apart(spark):
    """Lines of over LONG characters that share half of their shingles fill WORDS longs; more words tell them apart and lose no link."""
    rnd = random.Random(8)
    some = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base = some(2400)
    lines = [base, base[:1600] + some(800), some(800) + base[800:], base[: 2400 - 550], base[100:] + some(150), base * 2, some(2400), base[:300]]
    odd = _odd(spark.createDataFrame(list(enumerate(lines)), "id long, line string"))
    near = {(r.a, r.b) for r in _named(odd, "a").crossJoin(_named(odd, "b")).where("a < b").where(_near("a", "b")).select("a", "b").collect()}
    sets = [grams(x) for x in lines]
    linked = {(i, j) for j in range(len(lines)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {(0, 3), (0, 4), (0, 5)} <= linked <= near
    assert not near & {(0, 1), (0, 2), (1, 2), (0, 6), (1, 6)}


def test_sets_are_made_by_compiled_projections(spark, monkeypatch):
    """explode evaluates what it is given row by row, without compiling it: it gets columns, no sets to make."""
    plans, write = {}, op01_line_dedup.materialize

    def kept(df, tag, *more):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, *more)

    monkeypatch.setattr(op01_line_dedup, "materialize", kept)
    df = spark.createDataFrame([(1, "a line of words that is long enough to hold shingles"), (2, "a line of words that is long enough to hold shingles too")], "id long, line string")
    op01_line_dedup._confirm(spark.createDataFrame([(1, 2)], "a long, b long"), df)
    _odd(df)
    for tag in ("links", "odd"):
        made = [x for x in plans[tag][0].split("\n") if "transform(" in x]
        assert made and all("Generate" not in x for x in made)
