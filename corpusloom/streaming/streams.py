"""Structured Streaming: windows, sessions, late data, count-fired rings, consecutive dedup and resumable work."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 4) -> DataFrame:
    """A file stream; `files` a trigger bounds a batch, so overload waits instead of being shed."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def tumbling(events: DataFrame, size: str = "1 day", late: str = "10 days", slide: str | None = None) -> DataFrame:
    """Counts of event-time windows behind a watermark; later rows are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 days") -> DataFrame:
    """Sessions of a user."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def ring(events: DataFrame, every: int, size: int, interval: float) -> DataFrame:
    """Keep each `every`-th row of a user; once `size` are held and `interval` seconds passed, fire on the last `size`.

    State is bounded: a counter, the time of the last firing and `size` values.
    """

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, fired, held = state.get if state.exists else (0, -1.0, [])
        held, out = list(held), []
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for ts, value in zip(rows["ts"], rows["value"]):
            n += 1
            if n % every:
                continue
            held = [*held, float(value)][-size:]
            at = ts.timestamp()
            if len(held) == size and (fired < 0 or at - fired >= interval):
                fired = at
                out.append((key[0], ts, sum(held) / size))
        state.update((n, fired, held))
        yield pd.DataFrame(out, columns=["user_id", "ts", "mean"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, ts timestamp, mean double", "n bigint, fired double, held array<double>", "append", GroupStateTimeout.NoTimeout)


def changes(events: DataFrame) -> DataFrame:
    """Rows whose type differs from the user's row before, across batches."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            if row.event_type != last:
                out.append((key[0], row.event_id, row.event_type))
            last = row.event_type
        state.update((last,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, event_id bigint, event_type string", "last string", "append", GroupStateTimeout.NoTimeout)


def unfinished(log: DataFrame, key: str, started: str, finished: str) -> DataFrame:
    """Keys that started and never finished, to be taken up again after a crash."""
    return log.where(F.col("event") == started).select(key).distinct().join(log.where(F.col("event") == finished).select(key), key, "left_anti")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, once, exactly once per row; a rerun with the same checkpoint goes on from there."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
