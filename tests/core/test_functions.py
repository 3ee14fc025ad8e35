"""Functions against plain Python on the cases that the shared tables lack."""

import re
import unicodedata

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import rules, stateful


def one(spark, rows, **cols):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *[c.alias(k) for k, c in cols.items()]).orderBy("i").collect()]


def test_normalize_cases(spark):
    rows = ["", "   ", "‘Hi’ “you”–me—", "a b", "﻿x", "SPK_1: hi there", "one\nSPK_1: hi", "[noise] (laugh) <unk> ok", "see https://a.b/c www.x.y end"]
    got = one(spark, rows, t=T.normalize(F.col("s"), "english", strip_bracketed=True, strip_speaker=True, remove_urls=True))
    assert [x[0] for x in got] == ["", "", "'hi' you me", "a b", "x", "hi there", "one spk 1 hi", "ok", "see end"]
    assert one(spark, ["ABC déf"], t=T.normalize(F.col("s"), "english", lowercase=False)) == [("d f".replace("d f", "déf"),)]


def test_languages(spark):
    rows = ["", "hello", "¡Hola!", "ñ", "über", "été", "Ωμέγα", "مرحبا", "你好", "你好 مرحبا", "123"]
    got = one(spark, rows, a=T.detect_language(F.col("s"), True, "unknown"), b=T.detect_language(F.col("s"), False, "auto"))
    assert [x[0] for x in got] == ["unknown", "english", "spanish", "spanish", "french", "french", "greek", "arabic", "chinese", "arabic", "unknown"]
    assert [x[1] for x in got] == ["auto", "english", "english", "spanish", "french", "french", "greek", "arabic", "chinese", "arabic", "auto"]


def test_soundex(spark):
    rows = ["Pfister", "Ashcraft", "Tymczak", "", "été", "123", "Lee", "Robert", "Honeyman"]
    assert [x[0] for x in one(spark, rows, k=T.soundex(F.col("s")))] == ["P123", "A226", "T522", "", "", "", "L000", "R163", "H555"]


def test_runs_frames_times(spark):
    assert one(spark, ["", "a", "aab", "xx\n\nyyyy"], r=T.longest_run(F.col("s"))) == [(0,), (1,), (2,), (4,)]
    assert one(spark, ["", "a", "aab", "aaaa"], r=T.ctc_frames(F.col("s"))) == [(0,), (1,), (4,), (7,)]
    assert one(spark, ["01:02:03.5", "2:03", "7.25"], r=T.seconds(F.col("s"))) == [(3723.5,), (123.0,), (7.25,)]
    assert one(spark, ["0", "3661.5", "59.9996"], r=T.srt_time(F.col("s").cast("double"))) == [("00:00:00,000",), ("01:01:01,500",), ("00:00:59,1000",)]


def test_distances(spark):
    df = spark.createDataFrame([("", "", 0.0), ("", "x", 1.0), ("abc", "abc", 0.0), ("abc", "abd", 1 / 3), ("abc", "", 1.0)], "a string, b string, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select("want", T.error_rate(F.col("a"), F.col("b")).alias("got")).collect())
    assert [r[0] for r in df.select(T.edit_distance(F.col("a"), F.col("b"), 1)).collect()] == [0, 1, 0, 1, 2]
    w = spark.createDataFrame([(["a", "b", "c"], ["a", "c"], 1), ([], ["x"], 1), (["a"], ["a"], 0)], "a array<string>, b array<string>, want int")
    assert all(r.got == r.want for r in w.select("want", T.word_edit_distance(F.col("a"), F.col("b")).alias("got")).collect())


def test_romanize_and_marks(spark):
    rows = ["Él está — ﬁne", "ÀÉ ñ", "", None]
    got = one(spark, rows, r=stateful.romanize("s"), d=stateful.strip_diacritics("s"))
    plain = lambda s: re.sub(r"\s+", " ", re.sub(r"[^a-z0-9' ]+", " ", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().lower())).strip()
    assert [x[0] for x in got] == [plain(s or "") for s in rows]
    assert [x[1] for x in got][:2] == ["El esta — fine", "AE n"]


def test_rule_engine(spark):
    df = spark.createDataFrame([(1,), (5,), (9,), (None,)], "x int")
    found = [("small", F.col("x") < 4), ("odd", F.col("x") % 2 == 1), ("big", F.col("x") > 8)]
    got = [(list(r.a), r.f) for r in df.select(rules.all_reasons(found).alias("a"), rules.first_reason(found, "ok").alias("f")).collect()]
    assert got == [(["small", "odd"], "small"), (["odd"], "odd"), (["odd", "big"], "odd"), ([], "ok")]
