"""Frame and clip sampling, smoothing, signal statistics and small conversions, over the shared tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import text as T
from .base import query
from .timed import E, by_user, timed

S = config.Sampling()
_FRAMES = "(10 * p_size + p_partkey % 7)"
_STEP = f"{S.last - S.first!r} / {S.samples - 1}"
_CENTRES = f"list_sort(list_distinct(list_transform(range({S.samples}), lambda j: CAST(round_even(({_FRAMES} - 1) * (CAST({S.first} AS DOUBLE) + j * (CAST({S.last - S.first!r} AS DOUBLE) / {S.samples - 1})), 0) AS BIGINT))))"


def frame_count():
    return 10 * F.col("p_size") + F.col("p_partkey") % 7


def centres(frames):
    """Evenly spread frames between the shares `first` and `last` of a video, halves rounded to even."""
    at = F.transform(F.sequence(F.lit(0), F.lit(S.samples - 1)), lambda j: F.bround((frames - 1) * (F.lit(S.first) + j * F.lit((S.last - S.first) / (S.samples - 1)))).cast("long"))
    return F.sort_array(F.array_distinct(at))


@query(f"SELECT p_partkey, array_to_string({_CENTRES}, ',') AS frames FROM part")
def frame_indices(t):
    """Distinct evenly spread frames."""
    return t("part").select("p_partkey", F.array_join(centres(frame_count()).cast("array<string>"), ",").alias("frames"))


@query(f"""WITH c AS (SELECT p_partkey, {_FRAMES} AS n, {_CENTRES} AS l FROM part), u AS (SELECT p_partkey, n, unnest(l) AS center, unnest(range(len(l))) AS place FROM c)
SELECT p_partkey, place, center, greatest(0, center - {S.half}) AS first_frame, least(n - 1, center + {S.half}) AS last_frame, round(greatest(0, center - {S.half}) / CAST({S.fps} AS DOUBLE), 6) AS first_second FROM u""")
def sampling_windows(t):
    """A window around each frame, clamped to the video."""
    x = t("part").select("p_partkey", frame_count().alias("n")).select("p_partkey", "n", F.posexplode(centres(F.col("n"))).alias("place", "center"))
    first = F.greatest(F.lit(0), F.col("center") - S.half)
    return x.select("p_partkey", F.col("place").cast("long").alias("place"), "center", first.alias("first_frame"), F.least(F.col("n") - 1, F.col("center") + S.half).alias("last_frame"), F.round(first / F.lit(float(S.fps)), 6).alias("first_second"))


@query(f"""WITH d AS (SELECT c_custkey, abs(c_acctbal) / 100 AS duration, greatest(0, abs(c_acctbal) / 100 - {S.clip}) AS usable FROM customer),
s AS (SELECT c_custkey, j AS place, usable, usable * (CAST(0.18 AS DOUBLE) + j * (CAST(0.64 AS DOUBLE) / {S.clips - 1})) AS s FROM d, range({S.clips}) r(j) WHERE duration > {S.clip} + 1)
SELECT c_custkey, place, round(least(CASE WHEN usable > 8 THEN greatest(2.0, s) ELSE s END, usable), 6) AS start FROM s UNION ALL SELECT c_custkey, 0, 0.0 FROM d WHERE duration <= {S.clip} + 1""")
def clip_starts(t):
    """Evenly spread clips of what a video leaves, not in its first two seconds if it is long; short ones have one."""
    x = t("customer").select("c_custkey", (F.abs("c_acctbal") / 100).alias("duration"))
    x = x.withColumn("usable", F.greatest(F.lit(0.0), F.col("duration") - S.clip))
    place = F.when(F.col("duration") <= S.clip + 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.lit(S.clips - 1).cast("long")))
    x = x.withColumn("place", F.explode(place)).withColumn("s", F.col("usable") * (F.lit(0.18) + F.col("place") * F.lit(0.64 / (S.clips - 1))))
    start = F.least(F.when(F.col("usable") > 8, F.greatest(F.lit(2.0), F.col("s"))).otherwise(F.col("s")), F.col("usable"))
    return x.select("c_custkey", "place", F.when(F.col("duration") <= S.clip + 1, 0.0).otherwise(F.round(start, 6)).alias("start"))


@query(f"SELECT p_partkey, j AS place, round(p_partkey + p_size * CAST(j AS DOUBLE) / {S.bins} + CAST(p_size AS DOUBLE) / {S.bins} / 2, 6) AS second FROM part, range({S.bins}) r(j)")
def sample_times(t):
    """The centres of equal bins of an interval."""
    x = t("part").select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(S.bins - 1).cast("long"))).alias("place"))
    return x.select("p_partkey", "place", F.round(F.col("p_partkey") + F.col("p_size") * F.col("place").cast("double") / S.bins + F.col("p_size").cast("double") / S.bins / 2, 6).alias("second"))


@query(f"SELECT p_partkey, array_to_string(list_filter(list_transform(range(least({S.strided}, p_size)), lambda i: i * {S.stride}), lambda i: i < p_size), ',') AS frames FROM part")
def strided_indices(t):
    """The first frames at a stride; the first one where there is no other."""
    at = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(S.strided), F.col("p_size")) - 1)), lambda i: i * S.stride), lambda i: i < F.col("p_size"))
    return t("part").select("p_partkey", F.array_join(at.cast("array<string>"), ",").alias("frames"))


_RADIUS = max(1, round(3 * S.sigma))
_KERNEL = [math.exp(-(k * k) / (2 * S.sigma**2)) for k in range(-_RADIUS, _RADIUS + 1)]
_KERNEL = [w / sum(_KERNEL) for w in _KERNEL]
_SUM = " + ".join(f"CAST({w!r} AS DOUBLE) * coalesce(lag(value, {-k}) OVER w, {'last' if k > 0 else 'first'})" for k, w in zip(range(-_RADIUS, _RADIUS + 1), _KERNEL, strict=True))


@query(f"""{E}, b AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id) AS first, first_value(value) OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS last FROM e)
SELECT event_id, round(CASE WHEN n < 3 THEN value ELSE {_SUM} END, 6) AS smooth FROM b WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)""")
def gaussian_smooth(t):
    """Gaussian smoothing, the edges repeated; fewer than three values stay."""
    whole = Window.partitionBy("user_id").orderBy("t", "event_id")
    all_ = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = timed(t).withColumns({"n": F.count("*").over(Window.partitionBy("user_id")), "first": F.first("value").over(all_), "last": F.last("value").over(all_)})
    total = sum((F.lit(w) * F.coalesce(F.lag("value", -k).over(whole), F.col("last" if k > 0 else "first")) for k, w in zip(range(-_RADIUS, _RADIUS + 1), _KERNEL, strict=True)), F.lit(0.0))
    return x.select("event_id", F.round(F.when(F.col("n") < 3, F.col("value")).otherwise(total), 6).alias("smooth"))


@query(f"""WITH p AS (SELECT label, 1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding)))) AS top FROM embeddings)
SELECT label, CASE WHEN avg(top) < {S.least_confidence} THEN round(avg(top), 6) END AS suppressed FROM p GROUP BY label""")
def untrained_guard(t):
    """the mean of the frames' highest probabilities where it is too low to show an output, else null."""
    x = t("embeddings").withColumn("most", F.array_max("embedding").cast("double"))
    x = x.select("label", (1 / F.aggregate(F.col("embedding"), F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - F.col("most")))).alias("top"))
    return x.groupBy("label").agg(F.avg("top").alias("mean")).select("label", F.when(F.col("mean") < S.least_confidence, F.round("mean", 6)).alias("suppressed"))


@query("SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value / 400 END), 0), 6) AS confidence FROM events GROUP BY user_id")
def mean_word_confidence(t):
    """The mean of the probabilities there are; 0 if there are none.

    Means that lie on half a millionth are common here, so the last bit decides: the sum is taken by event_id, as the table
    lies, however it is dealt out, and rounded by the arithmetic of the SQL (scaled, rounded, scaled back). A running sum,
    so a user's events may spill.
    """
    x = t("events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value") / 400).alias("p"))
    w = Window.partitionBy("user_id").orderBy("event_id", "p")
    x = x.withColumns({"sum": F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "at": F.row_number().over(w)})
    x = x.groupBy("user_id").agg((F.max_by("sum", "at") / F.count("p")).alias("mean"))
    return x.select("user_id", (F.round(F.coalesce("mean", F.lit(0.0)) * 1e6, 0) / 1e6).alias("confidence"))


@query("SELECT c_custkey, regexp_full_match(substr(c_name, CAST(1 + c_custkey % 12 AS BIGINT), 11), '[A-Za-z0-9_-]{11}') AS looks_like_id FROM customer")
def id_pattern(t):
    """eleven letters, digits, _ or -."""
    return t("customer").select("c_custkey", F.col("c_name").substr((1 + F.col("c_custkey") % 12).cast("int"), F.lit(11)).rlike(r"\A[A-Za-z0-9_-]{11}\z").alias("looks_like_id"))


@query("SELECT replace(lower(trim(o_orderpriority)), '-', '_') AS label, count(*) AS n FROM orders GROUP BY 1")
def normalize_label(t):
    """X22"""
    return t("orders").groupBy(F.replace(F.lower(F.trim("o_orderpriority")), F.lit("-"), F.lit("_")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / 255 - 0.5) / 0.5)), 6) AS total FROM embeddings")
def normalise_arrays(t):
    """(x / 255 - mean) / deviation of each element."""
    x = F.transform("embedding", lambda v: (v.cast("double") / 255 - 0.5) / 0.5)
    return t("embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT source, count(*) AS n, CASE WHEN count(*) < 50 THEN 2 WHEN count(*) < 200 THEN 4 WHEN count(*) < 1000 THEN 8 ELSE 16 END AS batch FROM documents GROUP BY source")
def batch_size(t):
    """By the number of samples."""
    n = F.count("*")
    return t("documents").groupBy("source").agg(n.alias("n"), F.when(n < 50, 2).when(n < 200, 4).when(n < 1000, 8).otherwise(16).alias("batch"))


@query(f"SELECT DISTINCT p_size AS epoch, round(least(1.0, (p_size + 1) / CAST({S.ramp} AS DOUBLE)) * {S.most_augmentation}, 6) AS scale FROM part")
def augmentation_ramp(t):
    """Grows with the epoch up to its most."""
    return t("part").select(F.col("p_size").alias("epoch"), F.round(F.least(F.lit(1.0), (F.col("p_size") + 1) / F.lit(float(S.ramp))) * S.most_augmentation, 6).alias("scale")).distinct()


_VOCABULARY = " 'abcdefghijklmnopqrstuvwxyz"


@query(f"SELECT item_id, array_to_string(list_transform(list_filter(string_split(lower(text), ''), lambda x: x <> '' AND contains('{_VOCABULARY.replace(chr(39), chr(39) * 2)}', x)), lambda x: instr('{_VOCABULARY.replace(chr(39), chr(39) * 2)}', x)), ' ') AS ids FROM benchmark")
def text_to_indices(t):
    """Places of the characters in the vocabulary; others are left out."""
    at = F.transform(F.split(F.lower("text"), ""), lambda x: F.when(x != "", F.instr(F.lit(_VOCABULARY), x)).otherwise(0))
    return t("benchmark").select("item_id", F.array_join(F.filter(at, lambda i: i > 0).cast("array<string>"), " ").alias("ids"))


@query(f"""WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
f AS (SELECT vec_id, i // {S.frame} AS k, count(*) AS n, sqrt(avg(CAST(v AS DOUBLE) * v) + 1e-12) AS rms FROM x GROUP BY 1, 2),
w AS (SELECT vec_id, sqrt(avg(CAST(v AS DOUBLE) * v) + 1e-12) AS rms FROM x GROUP BY 1)
SELECT vec_id, round(20 * log10(greatest(w.rms, 1e-8)), 6) AS rms_db, round(avg(CASE WHEN 20 * log10(greatest(f.rms, 1e-8)) >= {S.least_db} THEN 1.0 ELSE 0 END), 6) AS active FROM w JOIN f USING (vec_id) WHERE n = {S.frame} GROUP BY vec_id, w.rms""")
def audio_statistics(t):
    """Level of a signal in decibels, and the share of whole frames that reach a level; the tail is dropped."""
    level = lambda c: 20 * F.log10(F.greatest(F.sqrt(c + 1e-12), F.lit(1e-8)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size(a)
    frames = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / S.frame).cast("int") - 1), lambda k: F.slice("embedding", k * S.frame + 1, S.frame))
    x = t("embeddings").select("vec_id", F.col("embedding"), F.when(F.size("embedding") >= S.frame, frames).alias("frames"))
    loud = F.size(F.filter("frames", lambda f: level(mean(f)) >= S.least_db))
    return x.select("vec_id", F.round(level(mean(F.col("embedding"))), 6).alias("rms_db"), F.round(loud / F.size("frames"), 6).alias("active"))


@query(f"{E}, k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e) SELECT user_id, count(*) AS total, count(*) FILTER (i % {S.skip} = 0) AS extracted FROM k GROUP BY user_id")
def frame_decimation(t):
    """Every skip-th frame, skip being the whole part of the frame rates' quotient."""
    x = timed(t).select("user_id", (F.row_number().over(by_user()) - 1).alias("i"))
    return x.groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("i") % S.skip == 0).alias("extracted"))


@query(f"{E} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, t, event_id) AS rn FROM e) WHERE rn = 1")
def primary_face(t):
    """The largest; of equals, the first."""
    return timed(t).groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("t"), -F.col("event_id"))).alias("event_id"))


@query(f"{E} SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t DESC, event_id DESC) AS rn FROM e) WHERE rn = 1")
def last_candidates(t):
    """Of rows with one key, the last."""
    x = timed(t).groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "value"), F.struct("t", "event_id")).alias("r"))
    return x.select("user_id", "event_type", "r.event_id", "r.value")


@query(r"SELECT conv_id, turn, trim(regexp_replace(array_to_string(list_transform(string_split(text, ' '), lambda x: regexp_replace(x, '[^a-zA-Z0-9'' -]', '', 'g')), ' '), ' +', ' ', 'g')) AS label FROM conversations")
def clean_label(t):
    """The cleaned words of a clip, joined."""
    words = F.array_join(F.transform(F.split("text", " "), T.clean_word), " ")
    return t("conversations").select("conv_id", "turn", F.trim(F.regexp_replace(words, " +", " ")).alias("label"))
