"""Splits, weights, even picks and batches; seeded order is by a sha256 hash, so reruns and SQL agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column, seed: int) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), key.cast("string")), 256)


def grouped_split(df: DataFrame, group: str, seed: int = 42, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """group, split: whole groups in hash order; max(1, round(share * n)) each to val and test, the rest to train.

    One row a group enters the ranking, so its single ordering grows with the groups, not the rows.
    """
    g = df.select(group).distinct()
    n = F.count("*").over(Window.partitionBy())
    x = g.withColumns({"rn": F.row_number().over(Window.orderBy(seeded(F.col(group), seed))), "n": n})
    take = lambda share: F.greatest(F.lit(1), F.bround(n * share)).cast("long")
    x = x.withColumns({"nv": take(val), "nt": take(test)})
    return x.select(group, F.when(F.col("rn") <= F.col("nv"), "val").when(F.col("rn") <= F.col("nv") + F.col("nt"), "test").otherwise("train").alias("split"))


def hash_fraction(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 8 hex digits of the seeded hash; splits rows without any ordering."""
    return F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("double") / 2.0**32


def even_limit(df: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """Rows at the rounded positions of `most` even steps in each group (all of them, if there are no more)."""
    w = Window.partitionBy(group)
    x = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    if most == 1:
        return x.where("_i = 0").drop("_i", "_n")
    step = (F.col("_n") - 1) / (most - 1)
    near = F.floor(F.try_divide(F.col("_i"), step) + 0.5)
    hit = F.exists(F.sequence(near - 1, near + 1), lambda j: F.bround(j * step) == F.col("_i"))
    return x.where((F.col("_n") <= most) | hit).drop("_i", "_n")
