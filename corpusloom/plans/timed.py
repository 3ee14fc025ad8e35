"""Queries over timed rows: events stand for words, detections and clips; conversations for captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Accent, Speaker, Visual
from ..functions import text as T
from ..operators import intervals, rules
from .base import query

E = "WITH e AS (SELECT event_id, user_id, event_type, value, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t FROM events)"
DAY = 86400.0


def timed(t) -> DataFrame:
    x = t("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return x.withColumn("t", (F.col("us") - F.min("us").over(Window.partitionBy("user_id"))) / 1e6)


def r6(c, name):
    return F.round(c, 6).alias(name)


def by_user():
    return Window.partitionBy("user_id").orderBy("t", "event_id")


@query(f"""{E}, i AS (SELECT user_id, t AS s, t + value * 100 AS f FROM e), m AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN s - reach <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT user_id, round(min(s), 6) AS "start", round(max(f), 6) AS "end", count(*) AS n FROM g GROUP BY user_id, island""")
def merge_intervals(t):
    """Touching or near intervals become one."""
    x = timed(t).select("user_id", F.col("t").alias("s"), (F.col("t") + F.col("value") * 100).alias("f"))
    return intervals.merge(x, "user_id", "s", "f", 3600.0).select("user_id", r6(F.col("start"), "start"), r6(F.col("end"), "end"), "n")


HOP = f"""{E}, w AS (SELECT user_id, event_id, event_type, t, t + value / 2 AS mid FROM e),
k AS (SELECT *, unnest(range(CAST(greatest(0, floor((mid - 172800) / 86400) + 1) AS BIGINT), CAST(floor(mid / 86400) AS BIGINT) + 1)) AS k FROM w)"""


def hops(t) -> DataFrame:
    x = timed(t).withColumn("mid", F.col("t") + F.col("value") / 2)
    return intervals.hopping(x, "user_id", F.col("mid"), F.lit(0.0), 2 * DAY, DAY)


@query(f"{HOP}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY t, event_id) AS rn FROM k) SELECT user_id, k, count(*) AS n_words, string_agg(event_type, ' ' ORDER BY rn) AS label FROM n WHERE rn <= 16 GROUP BY user_id, k HAVING count(*) >= 1")
def hopping_windows(t):
    """Windows of two days every day, by midpoint, the first 16 words."""
    x = hops(t).withColumn("rn", F.row_number().over(Window.partitionBy("user_id", "_k").orderBy("t", "event_id"))).where("rn <= 16")
    x = x.groupBy("user_id", F.col("_k").cast("long").alias("k")).agg(F.count("*").alias("n_words"), F.array_sort(F.collect_list(F.struct("rn", "event_type"))).alias("w"))
    return x.select("user_id", "k", "n_words", F.array_join(F.transform("w", lambda v: v["event_type"]), " ").alias("label"))


@query(f"{E}, d AS (SELECT user_id, max(t) AS dur FROM e GROUP BY user_id) SELECT user_id, count(*) AS clips, CAST(max(k) * 86400 AS DOUBLE) AS last_start FROM d, unnest(range(0, CAST(ceil(greatest(0, dur - 86400) / 86400) AS BIGINT))) u(k) GROUP BY user_id")
def fixed_windows(t):
    """Clips of a day; the last start lies before the end less a clip."""
    x = timed(t).groupBy("user_id").agg(F.max("t").alias("dur")).withColumn("n", F.ceil(F.greatest(F.lit(0.0), F.col("dur") - DAY) / DAY)).where("n > 0")
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return x.groupBy("user_id").agg(F.count("*").alias("clips"), (F.max("k") * DAY).alias("last_start"))


@query(f"""{E}, w AS (SELECT DISTINCT user_id, floor(t / 7200) * 7200 AS s FROM e WHERE event_type <> 'click'), f AS (SELECT user_id, t AS s, t + value * 100 AS f FROM e WHERE event_type = 'click')
SELECT user_id, s FROM w WHERE EXISTS (SELECT 1 FROM f WHERE f.user_id = w.user_id AND ((w.s + 3600 >= f.s AND w.s + 3600 <= f.f) OR greatest(0, least(w.s + 7200, f.f) - greatest(w.s, f.s)) >= 600))""")
def window_semi_join(t):
    """Windows whose middle is in an interval, or that overlap one long enough."""
    e = timed(t)
    w = e.where("event_type <> 'click'").select("user_id", (F.floor(F.col("t") / 7200) * 7200.0).alias("start")).distinct().withColumn("end", F.col("start") + 7200)
    i = e.where("event_type = 'click'").select("user_id", F.col("t").alias("start"), (F.col("t") + F.col("value") * 100).alias("end"))
    return intervals.semi_windows(w, i, "user_id", 600.0).select("user_id", F.col("start").alias("s"))


@query("""WITH c AS (SELECT conv_id, turn, role, 2.0 * turn AS s, 2.0 * turn + 2 AS f FROM conversations), p AS (SELECT DISTINCT conv_id, k FROM c, unnest(range(CAST(floor(s / 3) AS BIGINT), CAST(floor(f / 3) AS BIGINT) + 1)) u(k))
SELECT p.conv_id, k, count(*) AS n, string_agg(role, ' ' ORDER BY turn, role) AS text FROM p JOIN c ON c.conv_id = p.conv_id AND c.s < 3 * k + 3 AND c.f > 3 * k GROUP BY p.conv_id, k""")
def caption_concat(t):
    """Captions that overlap a clip (open at both ends), joined in order."""
    c = t("conversations").select("conv_id", "turn", "role", (2.0 * F.col("turn")).alias("s"), (2.0 * F.col("turn") + 2).alias("f"))
    x = c.withColumn("k", F.explode(F.sequence(F.floor(F.col("s") / 3).cast("long"), F.floor(F.col("f") / 3).cast("long")))).where((F.col("s") < 3 * F.col("k") + 3) & (F.col("f") > 3 * F.col("k")))
    x = x.groupBy("conv_id", "k").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("w"))
    return x.select("conv_id", "k", "n", F.array_join(F.transform("w", lambda v: v["role"]), " ").alias("text"))


@query(f"""{E}, w AS (SELECT user_id, event_id, event_type, t AS s, t + value * 1000 AS f FROM e), fr AS (SELECT DISTINCT user_id, floor(t / 21600) AS frame FROM e),
o AS (SELECT fr.user_id, frame, event_id, event_type, s, greatest(0, least(f, (frame + 1) * 21600) - greatest(s, frame * 21600)) AS ov FROM fr JOIN w ON w.user_id = fr.user_id AND s <= (frame + 1) * 21600 AND f >= frame * 21600)
SELECT user_id, CAST(frame AS BIGINT) AS frame, event_type AS primary_word, round(ov, 6) AS overlap, n FROM (SELECT *, count(*) OVER (PARTITION BY user_id, frame) AS n, row_number() OVER (PARTITION BY user_id, frame ORDER BY ov DESC, s, event_id) AS rn FROM o) WHERE rn = 1""")
def frame_word_primary(t):
    """Words that touch a frame (closed); the longest overlap wins, ties by word order. Joined by frame number."""
    e = timed(t)
    n = 21600.0
    w = e.select("user_id", "event_id", "event_type", F.col("t").alias("s"), (F.col("t") + F.col("value") * 1000).alias("f"))
    w = w.withColumn("frame", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil(F.col("s") / n) - 1).cast("long"), F.floor(F.col("f") / n).cast("long"))))
    frames = e.select("user_id", F.floor(F.col("t") / n).cast("long").alias("frame")).distinct()
    x = w.join(frames, ["user_id", "frame"]).withColumn("ov", intervals.overlap(F.col("s"), F.col("f"), F.col("frame") * n, (F.col("frame") + 1) * n))
    at = Window.partitionBy("user_id", "frame")
    x = x.withColumns({"n": F.count("*").over(at), "rn": F.row_number().over(at.orderBy(F.desc("ov"), "s", "event_id"))}).where("rn = 1")
    return x.select("user_id", "frame", F.col("event_type").alias("primary_word"), r6(F.col("ov"), "overlap"), "n")


@query(f"""{E} SELECT a.event_id FROM e a WHERE a.event_type = 'view' AND EXISTS (SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type <> 'view' AND b.t - 600 <= a.t AND a.t <= b.t + b.value * 10 + 600)""")
def speaking_frames(t):
    """Moments inside some padded word interval."""
    e = timed(t)
    a, b = e.where("event_type = 'view'").alias("a"), e.where("event_type <> 'view'").alias("b")
    return a.join(b, F.expr("a.user_id = b.user_id and b.t - 600 <= a.t and a.t <= b.t + b.value * 10 + 600"), "left_semi").select("event_id")


@query(f"{E}, v AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN value END AS seen FROM e) SELECT event_id, coalesce(last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0.5) AS filled FROM v")
def forward_fill(t):
    """The last known value, an initial one before."""
    x = timed(t).withColumn("seen", F.when(F.col("event_type").isin("click", "view"), F.col("value")))
    return x.select("event_id", F.coalesce(F.last("seen", True).over(by_user().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.5)).alias("filled"))


@query(f"{E} SELECT event_id, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)), 6) AS delta FROM e")
def consecutive_delta(t):
    """W12"""
    return timed(t).select("event_id", r6(F.abs(F.col("value") - F.lag("value").over(by_user())), "delta"))


@query(f"{E}, x AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e WHERE event_type <> 'purchase') SELECT event_id FROM x WHERE p IS DISTINCT FROM event_type")
def consecutive_dedup(t):
    """Blanks go first, then repeats of the one before."""
    x = timed(t).where("event_type <> 'purchase'").withColumn("p", F.lag("event_type").over(by_user()))
    return x.where(~F.col("p").eqNullSafe(F.col("event_type"))).select("event_id")


@query("SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS least, max(value) AS most, round(stddev_pop(value), 6) AS std FROM events GROUP BY user_id")
def summarize_stats(t):
    """A10, A7, A15"""
    return t("events").groupBy("user_id").agg(F.count("*").alias("n"), r6(F.avg("value"), "mean"), r6(F.median("value"), "median"), F.min("value").alias("least"), F.max("value").alias("most"), r6(F.stddev_pop("value"), "std"))


TRACK = """a AS (SELECT user_id, event_type AS track, count(*) AS n, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS motion, stddev_pop(value) AS std, avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END) AS rate, avg(value) AS mean FROM events GROUP BY ALL),
s AS (SELECT *, motion + 0.5 * std + 0.05 * rate + 0.05 * least(mean, 0.2) AS activity, n / sum(n) OVER (PARTITION BY user_id) AS visible FROM a)"""


def tracks(t) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.9)))
    x = t("events").groupBy("user_id", F.col("event_type").alias("track")).agg(F.count("*").alias("n"), p.alias("p"), F.stddev_pop("value").alias("std"), F.avg((F.col("value") > 20).cast("double")).alias("rate"), F.avg("value").alias("mean"))
    x = x.withColumn("motion", F.get("p", F.lit(1)) - F.get("p", F.lit(0)))
    return x.withColumns({"activity": F.col("motion") + 0.5 * F.col("std") + 0.05 * F.col("rate") + 0.05 * F.least("mean", F.lit(0.2)), "visible": F.col("n") / F.sum("n").over(Window.partitionBy("user_id"))})


@query(f"WITH {TRACK} SELECT user_id, track, n, round(motion, 6) AS motion, round(activity, 6) AS activity FROM s")
def track_activity(t):
    """A11, A13, A14"""
    return tracks(t).select("user_id", "track", "n", r6(F.col("motion"), "motion"), r6(F.col("activity"), "activity"))


K = Speaker()


@query(f"""WITH {TRACK}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY activity DESC, track) AS rn FROM s),
c AS (SELECT user_id, min(rn) AS rn FROM r WHERE rn > 1 AND visible >= {K.min_rival} GROUP BY user_id),
p AS (SELECT a.*, coalesce(x.activity, 0) AS rival, x.activity IS NOT NULL AS rivalled, coalesce(x.activity, 0) / greatest(a.activity, 1e-6) AS ratio FROM r a LEFT JOIN c USING (user_id) LEFT JOIN r x ON x.user_id = a.user_id AND x.rn = c.rn WHERE a.rn = 1)
SELECT user_id, track AS active, round(activity, 6) AS top, round(rival, 6) AS rival, round(ratio, 6) AS ratio,
 CASE WHEN visible < {K.min_track} THEN 'active_speaker_not_visible_enough' WHEN rate < {K.min_good} THEN 'active_speaker_mouth_not_trainable' WHEN visible / {K.min_track} < {K.min_primary} THEN 'active_speaker_not_primary_face'
 WHEN motion / 1000 < {K.min_motion} THEN 'mouth_not_moving_enough' WHEN mean / 400 < {K.min_open} THEN 'mouth_mostly_closed' WHEN rivalled AND ratio >= {K.rival_ratio} THEN 'competing_active_speaker' ELSE 'ok' END AS status FROM p""")
def active_vs_competitor(t):
    """The most active track, the best visible other, and the first rule that the former fails."""
    c = F.col
    x = tracks(t).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("activity"), "track")))
    top = F.min_by(F.struct("track", "activity", "visible", "rate", "motion", "mean"), "rn")
    x = x.groupBy("user_id").agg(top.alias("a"), F.max(F.when((c("rn") > 1) & (c("visible") >= K.min_rival), c("activity"))).alias("best"))
    x = x.select("user_id", "a.*", "best", F.coalesce("best", F.lit(0.0)).alias("rival"))
    x = x.withColumn("ratio", c("rival") / F.greatest("activity", F.lit(1e-6)))
    status = rules.first_reason([
        ("active_speaker_not_visible_enough", c("visible") < K.min_track),
        ("active_speaker_mouth_not_trainable", c("rate") < K.min_good),
        ("active_speaker_not_primary_face", c("visible") / K.min_track < K.min_primary),
        ("mouth_not_moving_enough", c("motion") / 1000 < K.min_motion),
        ("mouth_mostly_closed", c("mean") / 400 < K.min_open),
        ("competing_active_speaker", c("best").isNotNull() & (c("ratio") >= K.rival_ratio)),
    ], "ok")
    return x.select("user_id", c("track").alias("active"), r6(c("activity"), "top"), r6(c("rival"), "rival"), r6(c("ratio"), "ratio"), status.alias("status"))


V = Visual()
VIS = """WITH m AS (SELECT user_id, count(*) AS frames, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0 END) * 3 AS face_rate, min(value) / 10 AS lip, avg(value) / 1000 AS openness, stddev_pop(value) / 1000 AS motion, max(value) / 8 AS sharpness FROM events GROUP BY user_id)"""


def visual(t) -> DataFrame:
    return t("events").groupBy("user_id").agg(F.count("*").alias("frames"), (F.avg((F.col("event_type") == "view").cast("double")) * 3).alias("face_rate"), (F.min("value") / 10).alias("lip"), (F.avg("value") / 1000).alias("openness"), (F.stddev_pop("value") / 1000).alias("motion"), (F.max("value") / 8).alias("sharpness"))


@query(f"""{VIS} SELECT user_id, CASE WHEN frames <= 0 THEN 'no_frames' ELSE array_to_string(list_filter([CASE WHEN face_rate < {V.min_face_rate} THEN 'face_rate' END, CASE WHEN lip < {V.min_lip_size} THEN 'lip_size' END, CASE WHEN openness < {V.min_openness} THEN 'openness' END, CASE WHEN motion < {V.min_motion} THEN 'motion_low' END, CASE WHEN {V.max_motion} > 0 AND motion > {V.max_motion} THEN 'motion_high' END, CASE WHEN sharpness < {V.min_sharpness} THEN 'sharpness' END], lambda x: x IS NOT NULL), ';') END AS reasons,
 round(CASE WHEN frames <= 0 THEN 0 ELSE 1 END * (0.5 * face_rate + 0.2 * least(1, motion / {V.min_motion}) + 0.2 * least(1, openness / {V.min_openness}) + 0.1 * least(1, lip / {V.min_lip_size})), 6) AS score FROM m""")
def visual_reasons(t):
    """F2, F18"""
    c = F.col
    found = rules.all_reasons([("face_rate", c("face_rate") < V.min_face_rate), ("lip_size", c("lip") < V.min_lip_size), ("openness", c("openness") < V.min_openness), ("motion_low", c("motion") < V.min_motion), ("motion_high", F.lit(V.max_motion > 0) & (c("motion") > V.max_motion)), ("sharpness", c("sharpness") < V.min_sharpness)])
    part = lambda v, m: F.least(F.lit(1.0), c(v) / m)
    score = 0.5 * c("face_rate") + 0.2 * part("motion", V.min_motion) + 0.2 * part("openness", V.min_openness) + 0.1 * part("lip", V.min_lip_size)
    some = c("frames") > 0
    return visual(t).select("user_id", F.when(some, F.array_join(found, ";")).otherwise("no_frames").alias("reasons"), r6(F.when(some, score).otherwise(0.0), "score"))


A = Accent()
LAB = "WITH c AS (SELECT user_id, event_type AS label, sum(value) / 100 AS s FROM events GROUP BY ALL), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), m AS (SELECT user_id, label, s / n AS mean FROM c JOIN n USING (user_id)), a AS (SELECT user_id, max(CASE WHEN label IN ('view', 'click') THEN mean END) AS us, max(CASE WHEN label NOT IN ('view', 'click') THEN mean END) AS other, max(mean) AS top FROM m GROUP BY user_id)"


@query(f"{LAB} SELECT a.user_id, round(coalesce(us, 0), 6) AS us_score, round(coalesce(us, 0) - coalesce(other, 0), 6) AS margin, (SELECT min(label) FROM m WHERE m.user_id = a.user_id AND mean = top) AS top_label FROM a")
def label_score_margin(t):
    """Mean score per label over all clips, missing as 0; margin of the wanted labels."""
    n = Window.partitionBy("user_id")
    m = t("events").groupBy("user_id", F.col("event_type").alias("label")).agg(F.sum("value").alias("s"), F.count("*").alias("k")).withColumn("mean", F.col("s") / 100 / F.sum("k").over(n))
    us = F.col("label").isin("view", "click")
    x = m.withColumn("rn", F.row_number().over(n.orderBy(F.desc("mean"), "label"))).groupBy("user_id").agg(F.coalesce(F.max(F.when(us, F.col("mean"))), F.lit(0.0)).alias("us"), F.coalesce(F.max(F.when(~us, F.col("mean"))), F.lit(0.0)).alias("other"), F.max(F.when(F.col("rn") == 1, F.col("label"))).alias("top_label"))
    return x.select("user_id", r6(F.col("us"), "us_score"), r6(F.col("us") - F.col("other"), "margin"), "top_label")


@query(f"WITH m AS (SELECT user_id, avg(value) - 70 AS rms, avg(CASE WHEN value > 10 THEN 1.0 ELSE 0 END) AS active, max(value) / 100 AS english, avg(value) / 60 AS us, stddev_pop(value) / 100 AS margin, min(value) < 0.05 AS broken, count(*) FILTER (event_type IN ('view', 'click', 'signup')) AS clips, coalesce(avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0 END) FILTER (event_type IN ('view', 'click', 'signup')), 0) AS votes FROM events GROUP BY user_id) SELECT user_id, CASE WHEN broken THEN 'decode_error' WHEN clips = 0 THEN 'no_audio' WHEN rms < {A.min_rms} THEN 'too_quiet' WHEN active < {A.min_active} THEN 'not_enough_active_speech' WHEN english < {A.min_english} THEN 'non_english_or_uncertain_language' WHEN us < {A.min_score} THEN 'low_us_accent_score' WHEN margin < {A.min_margin} THEN 'ambiguous_us_accent_margin' WHEN votes < {A.min_votes} THEN 'not_enough_us_clip_votes' ELSE 'american_english' END AS decision FROM m")
def accent_decision(t):
    """the first rule that fails; a clip is a view, click or signup, the first two vote for the accent."""
    c = F.col
    clip = c("event_type").isin("view", "click", "signup")
    m = t("events").groupBy("user_id").agg((F.avg("value") - 70).alias("rms"), F.avg((c("value") > 10).cast("double")).alias("active"), (F.max("value") / 100).alias("english"), (F.avg("value") / 60).alias("us"), (F.stddev_pop("value") / 100).alias("margin"), (F.min("value") < 0.05).alias("broken"), F.count_if(clip).alias("clips"), F.coalesce(F.avg(F.when(clip, c("event_type").isin("view", "click").cast("double"))), F.lit(0.0)).alias("votes"))
    return m.select("user_id", rules.first_reason([("decode_error", c("broken")), ("no_audio", c("clips") == 0), ("too_quiet", c("rms") < A.min_rms), ("not_enough_active_speech", c("active") < A.min_active), ("non_english_or_uncertain_language", c("english") < A.min_english), ("low_us_accent_score", c("us") < A.min_score), ("ambiguous_us_accent_margin", c("margin") < A.min_margin), ("not_enough_us_clip_votes", c("votes") < A.min_votes)], "american_english").alias("decision"))


@query(f"{E}, k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM e) SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS place FROM k WHERE rn <= 3")
def topk_per_group(t):
    """The best three, then back in time order."""
    x = timed(t).withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("rn <= 3")
    return x.select("user_id", "event_id", F.row_number().over(by_user()).alias("place"))


@query(f"{E}, c AS (SELECT user_id, event_type, count(*) AS n, min(t) AS first FROM e GROUP BY ALL) SELECT user_id, event_type AS reason, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS rn FROM c) WHERE rn = 1")
def modal_reason(t):
    """The most common; of equals, the first seen."""
    x = timed(t).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("t").alias("first"))
    return x.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("first"))).alias("top")).select("user_id", F.col("top.event_type").alias("reason"), F.col("top.n").alias("n"))


@query("""WITH m AS (SELECT user_id, median(value) AS med FROM events GROUP BY user_id), d AS (SELECT user_id, value, med, abs(value - med) AS dev FROM events JOIN m USING (user_id)), a AS (SELECT user_id, greatest(5, any_value(med) * 0 + 3 * median(dev)) AS most FROM d GROUP BY user_id)
SELECT user_id, round(avg(value), 6) AS centre, count(*) AS inliers, round(quantile_cont(value, 0.95), 6) AS p95 FROM d JOIN a USING (user_id) WHERE dev <= most GROUP BY user_id""")
def robust_center(t):
    """Mean of the values near the median."""
    e = t("events").select("user_id", "value")
    d = e.join(e.groupBy("user_id").agg(F.median("value").alias("med")), "user_id").withColumn("dev", F.abs(F.col("value") - F.col("med")))
    a = d.groupBy("user_id").agg(F.greatest(F.lit(5.0), 3 * F.median("dev")).alias("most"))
    return d.join(a, "user_id").where("dev <= most").groupBy("user_id").agg(r6(F.avg("value"), "centre"), F.count("*").alias("inliers"), r6(F.percentile("value", 0.95), "p95"))


@query(f"{E}, w AS (SELECT event_id, event_type, t, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS rn FROM e) SELECT event_id, rn || chr(10) || printf('%02d:%02d:%02d,%03d', CAST(floor(t / 3600) AS BIGINT), CAST(floor(t / 60) AS BIGINT) % 60, CAST(floor(t) AS BIGINT) % 60, CAST(round((t - floor(t)) * 1000) AS BIGINT)) || chr(10) || event_type AS entry FROM w")
def srt_entries(t):
    """K6, K7, M2, M3"""
    x = timed(t).withColumn("rn", F.row_number().over(by_user()))
    return x.select("event_id", F.concat_ws("\n", F.col("rn").cast("string"), T.srt_time(F.col("t")), "event_type").alias("entry"))


@query("SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_count(t):
    """Batch form of the streaming window count."""
    x = t("events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return x.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("bucket"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k""")
def session_count(t):
    """Sessions end after six hours without an event; a gap of exactly that joins."""
    x = t("events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return x.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "n")


@query("WITH m AS (SELECT *, max(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) SELECT event_type, count(*) FILTER (seen IS NULL OR ts >= seen - INTERVAL '10 days') AS on_time, count(*) FILTER (ts < seen - INTERVAL '10 days') AS late FROM m GROUP BY event_type")
def late_drop(t):
    """Arrival order against a watermark of ten days; the running maximum is taken per slice of arrivals and carried."""
    e = t("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("event_id") / 1000).alias("slice"))
    carried = e.groupBy("slice").agg(F.max("ts").alias("m")).select("slice", F.max("m").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    own = F.max("ts").over(Window.partitionBy("slice").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    x = e.withColumn("own", own).join(carried, "slice").withColumn("seen", F.greatest("own", "before"))
    late = F.coalesce(F.col("ts") < F.col("seen") - F.expr("INTERVAL 10 DAYS"), F.lit(False))
    return x.groupBy("event_type").agg(F.count_if(~late).alias("on_time"), F.count_if(late).alias("late"))
