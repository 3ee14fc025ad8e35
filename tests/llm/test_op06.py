import random
import zlib

from corpusloom.llm.op06_language_id import gram_ids, identify

PARTS = {"en": "the th ing er and of to in is sh wh".split(), "de": "der die und ung keit sch ein ü ä ß ge".split(), "fr": "le la eau oi é è ç que ai tion ment".split()}


def made():
    rnd = random.Random(8)
    rows = []
    for d in range(400):
        lang = rnd.choice(["en", "en", "de", "fr"])
        rows.append((d, " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.choice([1, 2, 3]))) for _ in range(rnd.choice([8, 30, 200]))), lang))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = made()
    extra = [(1000, None, "en"), (1001, "", "de"), (1002, "123 .!", None), (None, "the thing and the sh", None), (1003, "der und " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows + extra], "doc_id long, text string, lang string, grams string, score double").repartition(4)
    got = {r.doc_id: r for r in identify(df).collect()}
    held = [(d, lang) for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.97 * len(held)
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert [got[d].lang_pred for d in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de" and got[None].lang_pred == "en"
    assert got[0].grams == "x" and got[0].score == 0.5


def test_grams_are_the_blended_spectrum():
    # " ab c " has these n-grams, whatever stands between the letters
    want = {" ab c "[i : i + n] for n in (1, 2, 3) for i in range(7 - n)}
    assert len(gram_ids("Ab, 1 \n C!")) == len(want) and (gram_ids("ab c") == gram_ids("AB -- C")).all()


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.lang_score) for r in identify(df).collect()] == [("und", 0.0)]
    assert identify(df.limit(0)).count() == 0
