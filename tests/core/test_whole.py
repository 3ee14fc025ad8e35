"""Queries on rows that a limit used to leave out."""

import datetime as dt
import math
import random

from corpusloom.plans.registry import QUERIES


def test_srt_entries_after_a_hundred_hours(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 7, t0, "a", 1.0), (2, 7, t0 + dt.timedelta(hours=123, seconds=5), "b", 1.0)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.entry for r in QUERIES["srt_entries"](spark, str(tmp_path)).collect()}
    assert got == {1: "1\n00:00:00,000\na", 2: "2\n123:00:05,000\nb"}


def test_clean_word_of_a_long_text(spark, tmp_path):
    text = "it's, " * 40 + "end!"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.word for r in QUERIES["clean_word"](spark, str(tmp_path)).collect()] == ["it's " * 40 + "end"]


def test_mean_word_confidence_on_ties_of_rounding(spark, tmp_path):
    rnd, rows = random.Random(3), []
    for user in range(400):
        rows += [(100 * user + i, user, "error" if user == 7 or rnd.random() < 0.1 else "click", round(rnd.random() * 100, 2)) for i in range(40)]
    dealt = rnd.sample(rows, len(rows))
    spark.createDataFrame(dealt, "event_id long, user_id long, event_type string, value double").repartition(12).write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for user in range(400):
        p = [v / 400 for _, u, kind, v in rows if u == user and kind != "error"]
        total = 0.0
        for x in p:  # sum() compensates
            total += x
        want[user] = math.floor(total / len(p) * 1e6 + 0.5) / 1e6 if p else 0.0
    assert {r.user_id: r.confidence for r in QUERIES["mean_word_confidence"](spark, str(tmp_path)).collect()} == want
