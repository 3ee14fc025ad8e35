r"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A chat logged after every turn leaves conversations that are prefixes of longer ones. Turns are numbered within their
conversation (by turn, role, text); the rolling hash of the first k turns is the exclusive-or of hash(k, role, text),
two hashes of 64 bits, so equal prefixes have equal hashes. A conversation stays if no longer one has its hash among
its prefixes and, of equal ones, if it has the least conv_id; the others are removed by an anti-join. What stays is
rendered, PIECE turns to a row, in order of `piece`.

Skew. Rolling hashes are computed in segments of SEGMENT turn numbers and carried across segments by one row each, so a
conversation with a third of all turns is spread over many tasks. Prefixes are aggregated by hash before they are
compared, so a very common first turn is one row. No row or task gathers more than PIECE turns' text.

Cases. Rows that repeat a whole turn count once; turns with one number are ordered by role, then text. Null text
renders empty, null role as `unknown`; null turn comes first. Null conv_id: one conversation. Empty table: no rows.
``<|`` in a text is written ``< |``, so it can't be taken for a marker. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

SEGMENT, PIECE = 256, 256


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, k (from 1), role, text, and p1, p2: the hashes of the first k turns."""
    x = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").distinct()
    x = x.withColumn("seg", F.floor(F.col("turn") / SEGMENT).cast("long"))
    within = Window.partitionBy("conv_id", "seg")
    x = x.withColumn("rn", F.row_number().over(within.orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))))
    x = materialize(x, "turns")
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("seg")).rowsBetween(Window.unboundedPreceding, -1)
    start = x.groupBy("conv_id", "seg").count().select(F.col("conv_id").alias("_c"), F.col("seg").alias("_s"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("seg").eqNullSafe(F.col("_s"))
    x = x.join(start, same).withColumn("k", F.col("start") + F.col("rn")).drop("_c", "_s")
    parts = ["k", F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    x = x.withColumns({"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit("second"), *parts)})
    run = within.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    carried = x.groupBy("conv_id", "seg").agg(F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    none = F.lit(0).cast("long")
    carried = carried.select(F.col("conv_id").alias("_c"), F.col("seg").alias("_s"), *[F.coalesce(F.bit_xor(h).over(before), none).alias(f"c{h}") for h in ("h1", "h2")])
    x = x.withColumns({"r1": F.bit_xor("h1").over(run), "r2": F.bit_xor("h2").over(run)}).join(carried, same)
    return x.select("conv_id", "k", "role", "text", F.col("r1").bitwiseXOR(F.col("ch1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("ch2")).alias("p2"))


def snapshots(x: DataFrame) -> DataFrame:
    """conv_id of the conversations that another one contains; x: as numbered() returns."""
    ends = x.groupBy(F.col("conv_id").alias("_c")).agg(F.max(F.struct("k", "p1", "p2")).alias("end"))
    size = x.select("conv_id", "k", "p1", "p2").join(ends.select("_c", F.col("end.k").alias("n")), F.col("conv_id").eqNullSafe(F.col("_c")))
    whole = F.struct(F.col("conv_id").isNotNull().alias("known"), F.col("conv_id").alias("conv_id"))
    seen = size.groupBy("k", "p1", "p2").agg(F.max("n").alias("longest"), F.min(F.when(F.col("n") == F.col("k"), whole)).alias("first"))
    last = ends.select("_c", "end.*")
    found = last.join(seen, ["k", "p1", "p2"]).where((F.col("longest") > F.col("k")) | ~F.col("_c").eqNullSafe(F.col("first.conv_id")))
    return found.select(F.col("_c").alias("conv_id"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, piece (from 0), n_turns, text: maximal conversations in chat markup, PIECE turns to a row."""
    x = materialize(numbered(turns), "numbered")
    gone = snapshots(x).select(F.col("conv_id").alias("_c"))
    kept = x.join(gone, F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    line = F.concat(F.lit("<|"), F.replace(F.replace(F.coalesce("role", F.lit("unknown")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >")), F.lit("|>\n"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>"))
    kept = kept.select("conv_id", F.floor((F.col("k") - 1) / PIECE).cast("long").alias("piece"), F.struct("k", line.alias("line")).alias("turn"))
    out = kept.groupBy("conv_id", "piece").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list("turn")).alias("turns"))
    return out.select("conv_id", "piece", "n_turns", F.array_join(F.transform("turns", lambda t: t["line"]), "\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS l FROM t GROUP BY conv_id),
gone AS (SELECT DISTINCT a.conv_id FROM c a JOIN c b ON a.l[1] = b.l[1] AND b.l[1:len(a.l)] = a.l AND (len(b.l) > len(a.l) OR b.conv_id < a.conv_id)),
k AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM t WHERE conv_id NOT IN (SELECT conv_id FROM gone))
SELECT conv_id, CAST((k - 1) // {PIECE} AS BIGINT) AS piece, count(*) AS n_turns,
       string_agg('<|' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), '|>', '| >') || '|>' || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>', chr(10) ORDER BY k) AS text
FROM k GROUP BY conv_id, (k - 1) // {PIECE}
"""

QUERIES = {"op7_chat_format": query}
ORACLES = {"op7_chat_format": ORACLE}
