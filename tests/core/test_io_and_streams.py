"""Readers and writers round trip; streams equal their batch forms."""

import json

from pyspark.sql import functions as F

from corpusloom.sources import readers, writers
from corpusloom.streaming import streams


def test_samples_and_files(spark, tmp_path):
    (tmp_path / "v").mkdir()
    (tmp_path / "l").mkdir()
    for name, size in (("a.npy", 200_000), ("b.npy", 10), ("c.npy", 200_000)):
        (tmp_path / "v" / name).write_bytes(b"x" * size)
    for name, text in (("a.txt", "hello you"), ("c.txt", "  "), ("d.txt", "x\n\ny")):
        (tmp_path / "l" / name).write_text(text)
    rows = [{"id": "1", "video": "a.npy", "text": "two words"}, {"id": "2", "video": "b.npy", "text": "x"}, {"id": "3", "video": "c.npy", "text": " "}, {"id": "4", "video": "none.npy", "text": "x"}]
    (tmp_path / "m.json").write_text(json.dumps(rows))
    got = readers.samples(spark, str(tmp_path / "m.json"), str(tmp_path / "v")).collect()
    assert [(r.id, r.word_count, r.language) for r in got] == [("1", 2, "unknown")]
    assert [r.file for r in readers.labelled_videos(spark, str(tmp_path / "v"), str(tmp_path / "l")).collect()] == ["a"]
    assert [r.line for r in readers.text_lines(spark, str(tmp_path / "l"), 2).collect()] == ["hello you", "x"]
    assert readers.media_files(spark, str(tmp_path), [".NPY"], 2).count() == 2
    assert readers.placeholders(spark).count() == 5


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, ["a", "b"], "x"), (2, None, [], "x")], "i int, d double, r array<string>, bucket string")
    writers.write_csv(df, str(tmp_path / "c"))
    lines = sorted(x for p in (tmp_path / "c").glob("*.csv") for x in p.read_text().splitlines())
    assert "1,0.5000,a;b,x" in lines and "i,d,r,bucket" in lines
    writers.write_buckets(df, str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2
    writers.append_events(df.select("i"), str(tmp_path / "e"))
    writers.append_events(df.select("i"), str(tmp_path / "e"))
    assert spark.read.schema("i int").json(str(tmp_path / "e")).count() == 4
    assert sorted(r.bucket for r in writers.numbered_names(df, "bucket", "i").collect()) == ["x", "x__1"]
    words = spark.createDataFrame([(1, 0, 0.0, 0.5, "hi"), (1, 1, 0.5, 1.0, "you")], "k int, o int, s double, f double, w string")
    assert writers.subtitles(words, "k", "o", F.col("s"), F.col("f"), F.col("w")).first().srt == "1\n00:00:00,000 --> 00:00:00,500\nhi\n\n2\n00:00:00,500 --> 00:00:01,000\nyou\n"


def made(spark):
    return spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 997).alias("ts"), (F.col("id") % 3).alias("user_id"), F.when(F.col("id") % 5 < 3, "view").otherwise("click").alias("event_type"), F.col("id").cast("double").alias("value"), F.lit("{}").alias("props"))


def test_stream_equals_batch(spark, tmp_path):
    made(spark).repartitionByRange(6, "event_id").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    for name, f in (("tumbling", streams.tumbling), ("sessions", streams.sessions)):
        q = f(streams.read_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete" if name == "tumbling" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        want = f(batch.withColumn("ts", F.col("ts")))
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, want.collect()))


def test_stateful_streams_and_resume(spark, tmp_path):
    made(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: streams.read_events(spark, str(tmp_path / "in"))
    streams.run_available(streams.changes(src()), str(tmp_path / "out"), str(tmp_path / "ck"))
    streams.run_available(streams.changes(src()), str(tmp_path / "out"), str(tmp_path / "ck"))  # nothing new: nothing again
    rows = sorted((r.user_id, r.event_id, r.event_type) for r in made(spark).collect())
    want = [x for i, x in enumerate(rows) if i == 0 or rows[i - 1][0] != x[0] or rows[i - 1][2] != x[2]]
    assert sorted((r.user_id, r.event_id, r.event_type) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want
    streams.run_available(streams.ring(src(), 2, 5, 5000.0), str(tmp_path / "ring"), str(tmp_path / "ck2"))
    got = spark.read.parquet(str(tmp_path / "ring"))
    first = [r.value for r in made(spark).where("user_id = 0").orderBy("ts").collect()][1::2][:5]
    assert got.where("user_id = 0").orderBy("ts").first().mean == sum(first) / 5


def test_unfinished(spark):
    log = spark.createDataFrame([("a", "start"), ("b", "start"), ("a", "done"), (None, "x")], "k string, event string")
    assert [r.k for r in streams.unfinished(log, "k", "start", "done").collect()] == ["b"]
