"""Interval merging, window assignment and interval joins; times are float seconds, each join has an equality key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge(df: DataFrame, key: str, start: str, end: str, gap: float) -> DataFrame:
    """key, start, end, n of merged intervals: one begins where the gap to all before it exceeds `gap` (inclusive)."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = df.withColumn("_new", F.when(F.col(start) - reach <= gap, 0).otherwise(1))
    x = x.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(key, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("_island")


def hopping(words: DataFrame, key: str, mid: Column, anchor: Column, clip: float, stride: float) -> DataFrame:
    """A row for each (word, window): window k covers [anchor + k * stride, + clip) and holds words by their midpoint."""
    last = F.floor((mid - anchor) / stride)
    first = F.floor((mid - anchor - clip) / stride) + 1
    x = words.withColumns({"_anchor": anchor, "_k": F.explode(F.sequence(F.greatest(F.lit(0), first).cast("int"), last.cast("int")))})
    return x.withColumn("window_start", F.col("_anchor") + F.col("_k") * stride).drop("_anchor")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def semi_windows(windows: DataFrame, intervals: DataFrame, key: str, least: float) -> DataFrame:
    """Windows (start, end) whose midpoint lies in an interval (closed) or that overlap one by `least` seconds."""
    w, i = windows.alias("w"), intervals.alias("i")
    mid = (F.col("w.start") + F.col("w.end")) / 2
    near = ((mid >= F.col("i.start")) & (mid <= F.col("i.end"))) | (overlap(F.col("w.start"), F.col("w.end"), F.col("i.start"), F.col("i.end")) >= least)
    return w.join(i, (F.col(f"w.{key}") == F.col(f"i.{key}")) & near, "left_semi")
