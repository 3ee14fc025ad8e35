r"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks, in DataFrame functions.

A document's size is its number of words. Sources, ordered by code point with null last, weigh WEIGHTS in turn and
share all sizes; a target stops at MOST times its source's size and the excess is shared again by weight (the level
at which it all fits is found in closed form from the sources ordered by the level at which each one fills up).

Blocks of BLOCK tokens are seats. Sources get seats by the highest quotients target / (2 s - 1), then each source's
shards (hash shards of about SHARD_TOKENS tokens) get its seats the same way, so every shard has an integer quota.
A shard lays its documents end to end in a seeded order and cuts that stream into blocks; a quota of q over n blocks
takes each block q div n times and a seeded cyclic run of q mod n blocks once more. A document takes the words of its
part of the stream, so documents mostly go whole, and none exceeds MOST times its size. All is integer arithmetic on
stored values and a keyed hash: reruns agree.

Scale. Only (doc_id, source, size) is shuffled. A hot source is split into shards by its size; windows over
shards see one row a shard, and the one over sources a row a source.

Cases. Null or empty text: size 0, nothing taken. Null doc_id: mixed as any other. Rows that repeat a doc_id: each
counts; equal ones are ordered at random but lie side by side. All sizes 0: targets 0. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, table

WEIGHTS, MOST, BLOCK, SHARD_TOKENS, SEED = (1, 2, 3), 3, 32, 500_000, 20260101


def sizes(docs: DataFrame) -> DataFrame:
    """docs with size: the number of words."""
    return docs.withColumn("size", F.size(F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE), "")).cast("long"))


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, size) -> source, source_size, target, one row a source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int")))
    per = per.withColumns({"cap": MOST * F.col("source_size"), "fill": MOST * F.col("source_size") / F.col("weight")})
    # Sources that fill up at a lower level are capped first; the level is common to all that are not capped.
    w = Window.orderBy("fill", F.col("source").isNull(), "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = w.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", (-F.col("level")).alias("back")))).over(Window.partitionBy())
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(-level["back"], F.lit(0.0)) * F.col("weight")).alias("target"))


def seats(units: DataFrame, group: list[str], total, share, order: list) -> DataFrame:
    """units with seats: `total` seats of each group dealt by the highest quotients share / (2 s - 1).

    The divisor total_share / total gives each unit round(share / divisor) seats, and the sum of those is off by at
    most half the number of units n; so unit i's seats differ from that by at most share_i * n / 2 and a little. Only
    those seats are ranked: a number in proportion to n, however many seats there are.
    """
    whole = Window.partitionBy(*group)
    x = units.withColumns({"_total": total, "_share": share}).withColumns({"_sum": F.sum("_share").over(whole), "_n": F.count("*").over(whole)})
    x = x.withColumn("_part", F.when(F.col("_sum") > 0, F.col("_share") / F.col("_sum")).otherwise(0.0))
    mid = F.round(F.col("_total") * F.col("_part"))
    slack = F.ceil(F.col("_part") * F.col("_n") / 2) + 2
    x = x.withColumns({"_low": F.greatest(F.lit(0), mid - slack).cast("long"), "_high": F.when(F.col("_part") > 0, mid + slack).otherwise(0).cast("long")})
    x = x.withColumn("_open", F.col("_total") - F.sum("_low").over(whole))
    tried = x.withColumn("_s", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    ranked = tried.withColumn("_rank", F.row_number().over(whole.orderBy((F.col("_share") / (2 * F.col("_s") - 1)).desc_nulls_last(), *order)))
    won = F.sum(F.when(F.col("_s").isNotNull() & (F.col("_rank") <= F.col("_open")), 1).otherwise(0))
    keys = units.columns
    return ranked.groupBy(*keys, "_low").agg(won.alias("_won")).select(*keys, (F.col("_low") + F.col("_won")).alias("seats"))


def mix_slim(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text, ...) -> doc_id, source, size, source_size, target, taken; a row for each row of docs."""
    sized = sizes(docs.select("doc_id", "source", "text"))
    key = F.concat_ws(":", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    slim = materialize(sized.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), "size", F.xxhash64(F.lit(SEED), key).alias("_h"), F.sha2(key, 256).alias("_order")), "sizes")
    targets = source_targets(slim.select(F.col("_source").alias("source"), "size"))
    targets = seats(targets, [], F.round(F.sum("target").over(Window.partitionBy()) / BLOCK).cast("long"), F.col("target"), [F.col("source").isNull(), F.col("source"), F.col("_s")])
    targets = materialize(targets.withColumn("shards", F.ceil(F.greatest(F.lit(1), F.col("source_size")) / SHARD_TOKENS).cast("int")), "targets")

    placed = slim.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn("shard", F.pmod(F.col("_h"), F.col("shards")).cast("int"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("quota"), F.first("source_size").alias("whole"))
    shards = seats(shards, ["source"], F.col("quota"), F.col("shard_size").cast("double"), [F.col("shard"), F.col("_s")])
    blocks = F.ceil(F.col("shard_size") / BLOCK).cast("long")
    shards = shards.withColumn("blocks", blocks).withColumn("got", F.least(F.col("seats"), MOST * F.col("blocks")))
    some = F.col("blocks") > 0
    shards = shards.select(
        F.col("source").alias("_s"), F.col("shard").alias("_shard"), "shard_size", "blocks",
        F.when(some, F.floor(F.try_divide(F.col("got"), F.col("blocks")))).otherwise(0).cast("long").alias("times"),
        F.when(some, F.col("got") % F.greatest(F.lit(1), F.col("blocks"))).otherwise(0).cast("long").alias("extra"),
        F.when(some, F.pmod(F.xxhash64(F.lit(SEED), F.coalesce("source", F.lit("\0")), "shard"), F.greatest(F.lit(1).cast("long"), F.col("blocks")))).otherwise(0).cast("long").alias("first"),
    )
    x = placed.join(shards, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")))
    end = F.sum("size").over(Window.partitionBy("source", "shard").orderBy("_order", "_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_end", end).withColumn("_begin", F.col("_end") - F.col("size"))

    def overlap(first, count):  # words of the document in `count` blocks from `first` on, not past the last block
        return F.greatest(F.lit(0).cast("long"), F.least("_end", (first + count) * BLOCK) - F.greatest(F.col("_begin"), first * BLOCK))

    zero = F.lit(0).cast("long")
    straight = F.least(F.col("extra"), F.col("blocks") - F.col("first"))
    taken = F.col("times") * F.col("size") + overlap(F.col("first"), straight) + overlap(zero, F.col("extra") - straight)
    return x.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes, repeats counted) added; columns of these names are replaced.

    Rows of one doc_id, source and size are taken alike but for the run's ends: the n-th by text gets the n-th least.
    """
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    same = ["doc_id", "source", "size"]
    (nth,) = fresh(names, "_nth")
    taken = mix_slim(docs.select("doc_id", "source", "text")).withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy("taken")))
    rows = sizes(docs.select(*[f"`{c}`" for c in names])).withColumn(nth, F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64("text"))))
    x, y = rows.alias("x"), taken.alias("y")
    on = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*same, nth)]
    return x.join(y, on).select(*[f"x.`{c}`" for c in names], "x.size", "y.source_size", "y.target", "y.taken")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_slim(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mixing": query}
ORACLES: dict[str, str] = {}
