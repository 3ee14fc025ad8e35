"""Sinks. Spark's committer makes overwrites atomic; nothing is written one file a row, and inputs are never deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import four


def overwrite_json(df: DataFrame, path: str) -> None:
    """K1, K8, K10"""
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """K2: an event log of JSON lines."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K3, K4: header, null as empty, arrays joined by semicolons, four decimals."""
    cols = [F.array_join(c, ";").alias(c) if k.startswith("array") else F.format_string("%.4f", four(F.col(c))).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes]
    cols = [F.when(F.col(c).isNotNull(), x).alias(c) if k in ("double", "float") else x for x, (c, k) in zip(cols, df.dtypes)]
    df.select(*cols).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_buckets(df: DataFrame, path: str, by: str = "bucket") -> None:
    """Rows laid out by decision; rejected ones are a partition, not a deletion."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def numbered_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """K9: collision suffixes __1, __2, ... for equal names."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("_n", rn).withColumn(name, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("__", name, F.col("_n").cast("string")))).drop("_n")


def ngram_json(counts: DataFrame, path: str) -> None:
    """(words array, n) as rows of tab-joined keys."""
    counts.select(F.array_join("words", "\t").alias("key"), "n").write.mode("overwrite").json(path)


def subtitles(words: DataFrame, key: str, order: str, start, end, text) -> DataFrame:
    """K6, K7: key, srt: numbered entries in order; words of one clip."""
    from ..functions.text import srt_time

    x = words.select(key, F.struct(F.col(order).alias("o"), srt_time(start).alias("a"), srt_time(end).alias("b"), text.alias("t")).alias("w")).groupBy(key).agg(F.array_sort(F.collect_list("w")).alias("w"))
    return x.select(key, F.array_join(F.transform("w", lambda v, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(v["a"], F.lit(" --> "), v["b"]), v["t"], F.lit(""))), "\n").alias("srt"))
