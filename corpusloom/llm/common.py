"""Shared pieces of the training-data operators: tables, scratch tables and distributed union-find."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space; everything between is a word.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir; on a single machine, else, one made here."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
        _ROOTS[app] = f"{base.rstrip('/')}/corpusloom-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:  # already stopped: a scheduler's cleaning of the checkpoint folder removes it
        return
    try:
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session may end first; leftovers do no harm
        pass


def release(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a scratch table that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        _drop(spark, f.rsplit("/", 1)[0])


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write df as a scratch table in the shared folder and read it back: cuts lineage, survives lost executors.

    by: a column to lay the files out by, so that a filter on it reads only its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and bytes in memory, that may be sent to every task; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16_000_000


def _bytes(field) -> Column:
    """About the bytes that a column takes in a row."""
    c = F.col(f"`{field.name}`")
    kind = field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return 24 + 8 * F.greatest(F.size(c), F.lit(0))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return 64 + 4 * F.coalesce(F.length(F.to_json(F.struct(c))), F.lit(0))
    return F.lit(8)


def small(df: DataFrame, most: int | None = None) -> DataFrame:
    """df marked for broadcast if it is measured to hold at most `most` (BROADCAST_ROWS) rows and BROADCAST_BYTES, else df."""
    most = BROADCAST_ROWS if most is None else most
    width = sum((_bytes(f) for f in df.schema), F.lit(8))
    rows, size = df.limit(most + 1).agg(F.count("*"), F.sum(width.cast("long"))).first()
    return F.broadcast(df) if rows <= most and (size or 0) <= BROADCAST_BYTES else df


def fresh(taken: list[str], *names: str) -> list[str]:
    """Each name, underscored until no column of `taken` has it (in any case)."""
    used, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in used:
            n += "_"
        used.add(n.lower())
        out.append(n)
    return out


def buckets(df: DataFrame, each: int, least: int) -> int:
    """Number of buckets so that one takes about `each` bytes of df as stored, `least` or more.

    The size is the optimizer's figure; where it has none (rows of the driver's), `least` it is.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size >= 2**60 else min(1_000_000, max(least, -(-size // each)))


def connected_components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Union-find over edges (a, b): returns (id, component), component being the smallest id reachable.

    Alternates large-star and small-star steps (each a join with a per-node minimum that partial aggregation
    shrinks before its shuffle), so a hub with a third of all edges only ever contributes minima. Rows whose
    ends are equal or null link nothing; ids without a link are absent from the result.
    """
    cur = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    cur, spark = materialize(cur, tag), edges.sparkSession

    def done(x: DataFrame) -> bool:
        """Each node has one parent at most, and no parent has one: a forest of stars."""
        ends = x.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(x.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    while not done(cur):
        sym = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = sym.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), tag)
        release(spark, cur)
        cur = new
    roots = cur.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return cur.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
