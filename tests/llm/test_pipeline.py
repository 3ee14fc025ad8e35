"""The pipeline against the stages' brute-force forms, one after the other."""

import random

import corpus_pipeline as pipe
import test_op01
import test_op04
import test_op08
import test_op10


def made():
    rnd = random.Random(21)
    parts = {"en": "the th ing er and of to in is sh wh".split(), "de": "der die und ung keit sch ein ü ä ß ge".split()}
    rows = []
    for d in range(70):
        lang = rnd.choice(["en", "de"])
        word = lambda: "".join(rnd.choice(parts[lang]) for _ in range(rnd.choice([2, 3, 4])))  # noqa: E731, B023
        rows.append((d, "\n".join(" ".join(word() for _ in range(rnd.choice([8, 15, 40]))) for _ in range(rnd.choice([1, 2, 4]))), lang, rnd.choice(["a", "b", None])))
    for d in range(70, 84):  # copies, near copies and shared lines
        _, t, lang, s = rows[d - 60]
        rows.append((d, [t, t + " more words", t.split("\n")[0], rows[3][1] + "\n" + t][d % 4], lang, s))
    items = [(1, " ".join(rows[5][1].split()[:8])), (2, " ".join(rows[20][1].split()[-9:]))]
    rows += [(90, None, "en", "a"), (91, "", "en", "a"), (92, "12 34", None, "b")]
    return rows, items


def test_run_against_brute_force(spark, tmp_path):
    rows, items = made()
    docs = spark.createDataFrame([(d, t, lang, s, len(t or "")) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipe.run(spark, str(tmp_path)).collect()}

    texts = [(d, t) for d, t, *_ in rows if any(c.isalpha() for c in t or "")]  # language ID keeps every real text here
    kept = {r.doc_id for r in pipe.language_id(spark, docs, str(tmp_path)).collect()}
    assert kept == {d for d, _ in texts}
    texts = [(d, t) for d, t in test_op01.brute(texts).items() if t.strip()]
    near = test_op10.brute(texts)
    texts = [(d, t) for d, t in texts if near[d][2]]
    leaks = {d for d, _ in test_op08.brute(texts, items)}
    texts = [(d, t) for d, t in texts if d not in leaks]
    assert leaks
    source = {d: s for d, _, _, s in rows}
    size = {}
    for d, t in texts:
        size[source[d]] = size.get(source[d], 0) + len(t.split())
    want = test_op04.targets(size)
    assert set(got) <= {d for d, _ in texts}
    for d, t in texts:
        if d in got:
            r = got[d]
            assert (r.text, r.n_chars, r["size"]) == (t, len(t), len(t.split())) and 0 < r.taken <= 3 * r["size"]
            assert abs(r.target - want[r.source]) < 1e-6
    for s in size:
        assert abs(sum(r.taken for r in got.values() if r.source == s) - want[s]) <= 5 * 32


def test_stages():
    assert [n for n, _ in pipe.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_language_id_rejects_unlearned_languages(spark):
    rows, _ = made()
    long = "Вчера вечером мы долго гуляли по городу и говорили о книгах", "昨日は友達と一緒に東京へ行きました", "Χθες το βράδυ περπατήσαμε πολύ στην πόλη", "Wczoraj wieczorem długo spacerowaliśmy po mieście i rozmawialiśmy o książkach", "asdkjh qwepoi zxmnbv lkjqwe pqwoei zmxnbv qpwoei"
    short = "Вчера", "昨日", "Χθες"
    clean = [r[1].split()[0] for r in rows[:20]] + [" ".join(r[1].split()[:5]) for r in rows[20:40]]
    more = [(1000 + i, t, None, "a") for i, t in enumerate([*long, *short])] + [(2000 + i, t, None, "a") for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + more], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id: r.lang for r in pipe.language_id(spark, docs, "").collect()}
    assert not [d for d in kept if 1000 <= d < 2000]
    assert {d for d in kept if d >= 2000} == {2000 + i for i in range(len(clean))}
