"""Sequences of class scores, one row a frame (key, t, lp: array of log-probabilities); the blank is class `blank`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames(df: DataFrame, key: str, vector: str, classes: int) -> DataFrame:
    """A flat vector cut into frames of `classes` scores, each log-softmaxed."""
    n = F.floor(F.size(vector) / classes).cast("int")
    x = df.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(F.col(vector), i * classes + 1, classes))).alias("t", "raw"))
    x = x.withColumn("raw", F.transform("raw", lambda v: v.cast("double")))
    x = x.withColumn("norm", F.ln(F.aggregate(F.transform("raw", F.exp), F.lit(0.0), lambda a, v: a + v)))
    return x.select(key, "t", F.transform("raw", lambda v: v - F.col("norm")).alias("lp"))


def argmax(lp: Column) -> Column:
    """Index of the greatest value, the first of equals."""
    return F.array_position(lp, F.array_max(lp)).cast("int") - 1


def segments(x: DataFrame, key: str, blank: int) -> DataFrame:
    """key, seg, label, first, last, lp (mean per class): islands of equal non-blank labels; a blank breaks a run."""
    w = Window.partitionBy(key).orderBy("t")
    x = x.withColumn("label", argmax(F.col("lp")))
    x = x.withColumn("seg", F.sum(F.when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col("label") != blank).groupBy(key, "seg", "label").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.avg(F.exp(F.array_max("lp"))).alias("confidence"))


def greedy(x: DataFrame, key: str, blank: int) -> DataFrame:
    """key, decoded: repeats merged, blanks dropped, joined by spaces."""
    s = segments(x, key, blank).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seg", "label"))).alias("s"))
    return x.select(key).distinct().join(s, key, "left").select(key, F.coalesce(F.array_join(F.transform("s", lambda v: v["label"].cast("string")), " "), F.lit("")).alias("decoded"))
