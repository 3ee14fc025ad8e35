"""Queries over embeddings: 64 floats stand for a vector, or for 8 frames of 8 class scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import sequences
from .base import query

FR = """WITH raw AS (SELECT vec_id, t, list_transform(embedding[t * 8 + 1 : t * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS r FROM embeddings, range(8) u(t)),
f AS (SELECT vec_id, t, list_transform(r, lambda x: x - ln(list_sum(list_transform(r, lambda y: exp(y))))) AS lp FROM raw)"""
ISLAND = f"""{FR}, l AS (SELECT *, list_position(lp, list_max(lp)) - 1 AS label FROM f), c AS (SELECT *, CASE WHEN label = lag(label) OVER (PARTITION BY vec_id ORDER BY t) THEN 0 ELSE 1 END AS new FROM l),
s AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY t) AS seg FROM c)"""


def frames(t) -> DataFrame:
    return sequences.frames(t("embeddings"), "vec_id", "embedding", 8)


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS mean, len(embedding) AS n FROM embeddings")
def mean_pool(t):
    """A33, S12"""
    total = F.aggregate(F.transform("embedding", lambda v: v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return t("embeddings").select("vec_id", F.round(total / F.size("embedding"), 5).alias("mean"), F.size("embedding").cast("long").alias("n"))


@query("SELECT label, k, count(*) AS n, round(avg(v), 5) AS mean FROM (SELECT label, CAST(k AS INTEGER) AS k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, range(64) u(k)) GROUP BY label, k")
def class_centroids(t):
    """A33 by label."""
    return t("embeddings").select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.count("*").alias("n"), F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"))


PAIR = "SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def pairs(t) -> DataFrame:
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")


def total(arr):
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v)


@query(f"SELECT round(avg(pow(list_dot_product(x, y) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(y, y))), 2)), 6) AS loss FROM ({PAIR})")
def decorrelation(t):
    """Mean squared cosine."""
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    return pairs(t).agg(F.round(F.avg(F.pow(dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))), 2)), 6).alias("loss"))


@query(f"SELECT round(avg(list_sum(list_transform(list_zip(x, y), lambda z: pow(z[1] - z[2], 2))) / 64), 6) AS loss FROM ({PAIR})")
def smoothness(t):
    """Mean squared step."""
    return pairs(t).agg(F.round(F.avg(total(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))) / 64), 6).alias("loss"))


@query(f"""{FR}, e AS (SELECT vec_id, t, k, exp(lp[k + 1]) AS p FROM f, range(8) u(k)), m AS (SELECT a.vec_id, a.t, a.k, avg(b.p) AS p FROM e a JOIN e b ON b.vec_id = a.vec_id AND b.k = a.k AND b.t IN ((a.t + 7) % 8, a.t, (a.t + 1) % 8) GROUP BY ALL)
SELECT vec_id, CAST(t AS INTEGER) AS t, round(ln(greatest(1e-8, max(p))), 5) AS top FROM (SELECT vec_id, t, p / sum(p) OVER (PARTITION BY vec_id, t) AS p FROM m) GROUP BY vec_id, t""")
def circular_smooth(t):
    """A centred moving average that wraps around, renormalised."""
    x = frames(t).select("vec_id", "t", F.posexplode(F.transform("lp", F.exp)).alias("k", "p"))
    near = x.withColumn("t", F.explode(F.array(*[F.pmod(F.col("t") + d, F.lit(8)) for d in (-1, 0, 1)]))).groupBy("vec_id", "t", "k").agg(F.avg("p").alias("p"))
    near = near.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("vec_id", "t")))
    return near.groupBy("vec_id", "t").agg(F.round(F.ln(F.greatest(F.lit(1e-8), F.max("p"))), 5).alias("top"))


@query(f"{ISLAND}, d AS (SELECT vec_id, seg, any_value(label) AS label FROM s WHERE label <> 0 GROUP BY vec_id, seg) SELECT vec_id, coalesce(string_agg(CAST(label AS VARCHAR), ' ' ORDER BY seg), '') AS decoded FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN d USING (vec_id) GROUP BY vec_id")
def greedy_ctc(t):
    """C1"""
    return sequences.greedy(frames(t), "vec_id", 0)


@query(f"{ISLAND} SELECT vec_id, label, CAST(min(t) AS INTEGER) AS first, CAST(max(t) AS INTEGER) AS last, round(avg(exp(list_max(lp))), 5) AS confidence FROM s WHERE label <> 0 GROUP BY vec_id, seg, label")
def ctc_segments(t):
    """W15, C4"""
    return sequences.segments(frames(t), "vec_id", 0).select("vec_id", F.col("label").cast("long").alias("label"), "first", "last", F.round("confidence", 5).alias("confidence"))


@query(f"""{FR}, p AS (SELECT vec_id, t // 2 AS chunk, exp(list_max(lp)) AS conf, -list_sum(list_transform(lp, lambda x: x * exp(x))) AS ent, exp(lp[1]) AS blank FROM f), a AS (SELECT vec_id, chunk, avg(conf) AS conf, avg(ent) AS ent, avg(blank) AS blank FROM p GROUP BY ALL),
g AS (SELECT vec_id, avg(conf) AS conf, avg(ent) AS ent, avg(blank) AS blank FROM p GROUP BY vec_id)
SELECT vec_id, string_agg(CASE WHEN a.conf < 0.9 * g.conf OR a.ent > 1.1 * g.ent OR a.blank > 1.1 * g.blank THEN 'N' ELSE 'C' END, '' ORDER BY chunk) AS tokens FROM a JOIN g USING (vec_id) GROUP BY vec_id""")
def reliability_tokens(t):
    """Chunks of frames against the sequence's means."""
    lp = F.col("lp")
    p = frames(t).select("vec_id", F.floor(F.col("t") / 2).alias("chunk"), F.exp(F.array_max(lp)).alias("conf"), (-total(F.transform(lp, lambda v: v * F.exp(v)))).alias("ent"), F.exp(F.get(lp, F.lit(0))).alias("blank"))
    means = [F.avg(m).alias(m) for m in ("conf", "ent", "blank")]
    a, g = p.groupBy("vec_id", "chunk").agg(*means).alias("a"), p.groupBy("vec_id").agg(*means).alias("g")
    x = a.join(g, "vec_id")
    bad = (F.col("a.conf") < 0.9 * F.col("g.conf")) | (F.col("a.ent") > 1.1 * F.col("g.ent")) | (F.col("a.blank") > 1.1 * F.col("g.blank"))
    x = x.select("vec_id", F.struct("chunk", F.when(bad, "N").otherwise("C").alias("s")).alias("z")).groupBy("vec_id").agg(F.array_sort(F.collect_list("z")).alias("z"))
    return x.select("vec_id", F.array_join(F.transform("z", lambda v: v["s"]), "").alias("tokens"))


@query(f"{FR}, p AS (SELECT vec_id, list_position(lp, list_max(lp)) - 1 AS got FROM f WHERE t = 0), n AS (SELECT label, got, count(*) AS n FROM embeddings JOIN p USING (vec_id) GROUP BY ALL) SELECT CAST(label AS INTEGER) AS label, CAST(got AS INTEGER) AS got, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM n QUALIFY row_number() OVER (ORDER BY CASE WHEN label = got THEN 1 ELSE 0 END, n DESC, label, got) <= 20")
def confusion_topk(t):
    """The 20 most frequent confusions and their row shares."""
    first = frames(t).where("t = 0").select("vec_id", sequences.argmax(F.col("lp")).alias("got"))
    n = t("embeddings").select("vec_id", "label").join(first, "vec_id").groupBy("label", "got").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))
    return n.orderBy((F.col("label") == F.col("got")).cast("int"), F.desc("n"), "label", "got").limit(20)


@query("WITH e AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS loss FROM embeddings), m AS (SELECT *, min(loss) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) SELECT label, count(*) AS epochs, count(*) FILTER (best IS NULL OR loss < best) AS improved, round(min(loss), 6) AS best FROM m GROUP BY label")
def early_stopping(t):
    """Epochs that improved on the best so far."""
    e = t("embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("loss"))
    e = e.withColumn("best", F.min("loss").over(Window.partitionBy("label").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)))
    return e.groupBy("label").agg(F.count("*").alias("epochs"), F.count_if(F.col("best").isNull() | (F.col("loss") < F.col("best"))).alias("improved"), F.round(F.min("loss"), 6).alias("best"))


@query("SELECT vec_id, CASE WHEN len(l) >= 70 THEN l[1:70] ELSE list_concat(l, list_transform(range(70 - len(l)), lambda i: l[-1])) END AS padded FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(round(CAST(x AS DOUBLE) * 1000) AS BIGINT)) AS l FROM embeddings)")
def pad_or_trim(t):
    """Padded to a length with the last value."""
    x = t("embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("long")).alias("l"))
    return x.select("vec_id", F.slice(F.concat("l", F.array_repeat(F.element_at("l", -1), F.greatest(F.lit(0), 70 - F.size("l")))), 1, 70).alias("padded"))
