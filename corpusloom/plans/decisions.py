"""Accept-or-reject decisions, eligibility and their statistics, over the shared tables (the SQL names the stand-ins)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..operators import rules
from .base import query

V, Q = config.FullVideo(min_segments=4), config.SampleFilter()
c = F.col

_METRICS = """m AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS frames, 1.5 * avg(CASE WHEN event_type IN ('view', 'click', 'signup') THEN 1.0 ELSE 0 END) AS face_rate, avg(CASE WHEN value > 40 THEN 1.0 ELSE 0 END) AS good_rate,
 avg(CASE WHEN value > 150 THEN 1.0 ELSE 0 END) AS ambiguous, quantile_cont(value, 0.5) AS width, quantile_cont(value, 0.5) / 300 AS height, stddev_pop(value) / 200 AS yaw FROM events GROUP BY user_id)"""
_FULL = f"""CASE WHEN frames <= 0 THEN 'no_decodable_frames' WHEN face_rate < {V.min_face_rate} THEN 'low_face_detection_rate' WHEN good_rate < {V.min_good_rate} THEN 'mouth_or_face_too_small_or_unclear'
 WHEN ambiguous > {V.max_ambiguous} THEN 'ambiguous_multiple_faces' WHEN width < {V.min_mouth_width} THEN 'mouth_too_small' WHEN height < {V.min_height} THEN 'face_too_far' WHEN yaw > {V.max_yaw} THEN 'face_too_profile' ELSE 'trainable_visual_quality' END"""


def full_video(t):
    """user_id and the first rule that its metrics fail (the speaker's status is active_vs_competitor's)."""
    share = lambda x: F.avg(x.cast("double"))
    m = t("events").groupBy("user_id").agg(
        F.count_if(c("event_type") != "error").alias("frames"),
        (1.5 * share(c("event_type").isin("view", "click", "signup"))).alias("face_rate"),
        share(c("value") > 40).alias("good_rate"),
        share(c("value") > 150).alias("ambiguous"),
        F.percentile("value", 0.5).alias("width"),
        (F.stddev_pop("value") / 200).alias("yaw"),
    )
    decision = rules.first_reason([
        ("no_decodable_frames", c("frames") <= 0),
        ("low_face_detection_rate", c("face_rate") < V.min_face_rate),
        ("mouth_or_face_too_small_or_unclear", c("good_rate") < V.min_good_rate),
        ("ambiguous_multiple_faces", c("ambiguous") > V.max_ambiguous),
        ("mouth_too_small", c("width") < V.min_mouth_width),
        ("face_too_far", c("width") / 300 < V.min_height),
        ("face_too_profile", c("yaw") > V.max_yaw),
    ], "trainable_visual_quality")
    return m.select("user_id", decision.alias("decision"))


@query(f"WITH {_METRICS} SELECT user_id, {_FULL} AS decision FROM m")
def full_video_decision(t):
    """F4, without the check of the active speaker."""
    return full_video(t)


@query(f"""WITH {_METRICS}, f AS (SELECT user_id, {_FULL} AS decision FROM m),
g AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 60) AS usable FROM events GROUP BY ALL),
s AS (SELECT user_id, count(*) FILTER (usable >= 3) AS usable FROM g GROUP BY user_id),
r AS (SELECT user_id, event_type AS reason FROM g WHERE usable < 3 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
SELECT user_id, CASE WHEN usable >= {V.min_segments} THEN 'usable_visual_segment' WHEN decision = 'trainable_visual_quality' OR reason IS NULL THEN decision ELSE 'no_usable_visual_segment:' || reason END AS decision FROM f JOIN s USING (user_id) LEFT JOIN r USING (user_id)""")
def visual_decision(t):
    """Enough usable segments accept, else the whole video does, else the most common failure rejects."""
    g = t("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_if(c("value") > 60).alias("usable"))
    bad = c("usable") < 3
    s = g.groupBy("user_id").agg(F.count_if(~bad).alias("usable"), F.min_by(F.when(bad, c("event_type")), F.when(bad, F.struct(-c("n"), c("event_type")))).alias("reason"))
    whole = (c("decision") == "trainable_visual_quality") | c("reason").isNull()
    out = F.when(c("usable") >= V.min_segments, "usable_visual_segment").when(whole, c("decision")).otherwise(F.concat(F.lit("no_usable_visual_segment:"), "reason"))
    return full_video(t).join(s, "user_id").select("user_id", out.alias("decision"))


_WORDS = "list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '')"
_LETTERS = "regexp_replace(lower(text), '[^a-z]', '', 'g')"


@query(f"""WITH u AS (SELECT doc_id, len({_WORDS}) AS words, length({_LETTERS}) AS units, length({_LETTERS}) + len(regexp_extract_all({_LETTERS}, '{"|".join(x * 2 for x in "abcdefghijklmnopqrstuvwxyz")}')) AS frames, (doc_id % 100) / 100.0 AS confidence FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN {Q.max_words} > 0 AND words > {Q.max_words} THEN 'too_many_words' WHEN {Q.max_units} > 0 AND units > {Q.max_units} THEN 'too_many_char_units' WHEN {Q.max_frames} > 0 AND frames > {Q.max_frames} THEN 'ctc_too_dense' WHEN {Q.min_confidence} > 0 AND confidence < {Q.min_confidence} THEN 'low_word_confidence' ELSE 'kept' END AS reason FROM u""")
def sample_filter(t):
    """the first rule that a sample fails; a rule whose threshold is 0 is off. Units are letters; doubled ones take a frame more."""
    letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    doubled = F.regexp_count(letters, F.lit("|".join(x * 2 for x in "abcdefghijklmnopqrstuvwxyz")))
    x = t("documents").where("text is not null").select("doc_id", F.size(F.array_remove(F.split("text", "[ \\t\\n]+"), "")).alias("words"), F.length(letters).alias("units"), (F.length(letters) + doubled).alias("frames"), (c("doc_id") % 100 / 100).alias("confidence"))
    limits = [("too_many_words", "words", Q.max_words), ("too_many_char_units", "units", Q.max_units), ("ctc_too_dense", "frames", Q.max_frames)]
    found = [(name, c(col) > most) for name, col, most in limits if most > 0]
    if Q.min_confidence > 0:
        found.append(("low_word_confidence", c("confidence") < Q.min_confidence))
    return x.select("doc_id", rules.first_reason(found, "kept").alias("reason"))


@query("SELECT doc_id, contains(lower(coalesce(text, '')), 'creative commons') OR contains(lower(coalesce(text, '')), 'creativecommon') AS is_cc FROM documents")
def cc_license(t):
    """whether a licence text names the licence; null: no."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return t("documents").select("doc_id", (low.contains("creative commons") | low.contains("creativecommon")).alias("is_cc"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def trainable(t):
    """F16: the rows of one permission."""
    return t("orders").where("o_orderstatus = 'F'").select("o_orderkey")


_RATE = "SELECT user_id, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0 END) AS face, min(value) / 100 AS lip, stddev_pop(value) / 5000 AS open, avg(value) / 4 AS sharp FROM events GROUP BY user_id"


@query(f"SELECT user_id, face >= 0.7 AND lip >= 0.03 AND open >= 0.004 AND sharp >= 10 AS passes, round(0.4 * face + 0.2 * least(lip / 0.05, 1) + 0.2 * least(open / 0.01, 1) + 0.2 * least(sharp / 20, 1), 6) AS score FROM ({_RATE})")
def video_quality(t):
    """all four thresholds, and the weighted score."""
    x = t("events").groupBy("user_id").agg(F.avg((c("event_type") != "error").cast("double")).alias("face"), (F.min("value") / 100).alias("lip"), (F.stddev_pop("value") / 5000).alias("open"), (F.avg("value") / 4).alias("sharp"))
    part = lambda v, most: F.least(c(v) / most, F.lit(1.0))
    passes = (c("face") >= 0.7) & (c("lip") >= 0.03) & (c("open") >= 0.004) & (c("sharp") >= 10)
    return x.select("user_id", passes.alias("passes"), F.round(0.4 * c("face") + 0.2 * part("lip", 0.05) + 0.2 * part("open", 0.01) + 0.2 * part("sharp", 20), 6).alias("score"))


@query("SELECT c_custkey, lower(coalesce(c_name, '') || ' ' || coalesce(c_mktsegment, '') || ' ' || coalesce(array_to_string(string_split(c_mktsegment, 'E'), ' '), '')) AS text FROM customer")
def metadata_text(t):
    """The fields and tags as one lower-case text; a null is empty."""
    tags = F.array_join(F.split("c_mktsegment", "E"), " ")
    return t("customer").select("c_custkey", F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (c("c_name"), c("c_mktsegment"), tags)])).alias("text"))


@query("SELECT c_nationkey AS country, count(*) AS searched, count(*) FILTER (c_acctbal >= 3000) AS passed, count(*) FILTER (NOT coalesce(c_acctbal >= 3000, false)) AS filtered_out, round(100.0 * count(*) FILTER (c_acctbal >= 3000) / count(*), 6) AS pass_rate FROM customer GROUP BY c_nationkey")
def filter_statistics(t):
    """Passed and filtered, by country."""
    good = F.coalesce(c("c_acctbal") >= 3000, F.lit(False))
    return t("customer").groupBy(c("c_nationkey").alias("country")).agg(F.count("*").alias("searched"), F.count_if(good).alias("passed"), F.count_if(~good).alias("filtered_out"), F.round(100.0 * F.count_if(good) / F.count("*"), 6).alias("pass_rate"))


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS accepted, count(*) FILTER (o_orderstatus = 'O') AS rejected, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS errors FROM orders")
def state_summary(t):
    """Rows of each outcome."""
    s = c("o_orderstatus")
    return t("orders").agg(F.count("*").alias("total"), F.count_if(s == "F").alias("accepted"), F.count_if(s == "O").alias("rejected"), F.count_if(~s.isin("F", "O")).alias("errors"))


@query("SELECT d.doc_id FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE trim(coalesce(d.text, '')) <> '' AND e.label <> 0")
def manifest_filter(t):
    """Rows that have an embedding and a text and are not pooled (label 0)."""
    x = t("documents").where("trim(coalesce(text, '')) <> ''").select("doc_id")
    return x.join(t("embeddings").where("label <> 0").select(c("vec_id").alias("doc_id")), "doc_id")


@query("SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, r.l_extendedprice AS price FROM lineitem l JOIN lineitem r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber WHERE r.l_returnflag = 'R'")
def two_key_join(t):
    """Clips with their scores, by video and clip number."""
    scores = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", c("l_extendedprice").alias("price"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(scores, ["l_orderkey", "l_linenumber"])


@query("WITH v AS (SELECT p_size AS epoch, p_retailprice AS loss FROM part QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) = 1) SELECT epoch, loss FROM range(0, 61) r(epoch) LEFT JOIN v USING (epoch)")
def epoch_losses(t):
    """The first loss recorded for each epoch, null where there is none."""
    v = t("part").groupBy(c("p_size").cast("long").alias("epoch")).agg(F.min_by("p_retailprice", "p_partkey").alias("loss"))
    epochs = t("part").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"))).alias("epoch")).distinct()
    return epochs.join(v, "epoch", "left")


@query(f"WITH w AS (SELECT conv_id, sum(len({_WORDS})) AS words FROM conversations GROUP BY conv_id) SELECT count(*) AS transcripts, CAST(coalesce(sum(words), 0) AS BIGINT) AS words, round(coalesce(avg(words), 0), 6) AS mean_words FROM w")
def transcript_report(t):
    """Totals, and the mean words of a transcript (0 if there are none)."""
    w = t("conversations").groupBy("conv_id").agg(F.sum(F.size(F.array_remove(F.split("text", "[ \\t\\n]+"), ""))).alias("words"))
    return w.agg(F.count("*").alias("transcripts"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.round(F.coalesce(F.avg("words"), F.lit(0.0)), 6).alias("mean_words"))


@query("SELECT c_custkey, coalesce(n_name, 'unknown') AS country FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def channel_country(t):
    """Looked up, unknown by default."""
    n = t("nation").where("n_regionkey <> 2").select(c("n_nationkey").alias("c_nationkey"), "n_name")
    return t("customer").join(F.broadcast(n), "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("country"))  # a table of nations


@query("WITH f AS (SELECT user_id, quantile_cont(value, 0.5) AS centre FROM events GROUP BY user_id) SELECT user_id, CASE WHEN avg(abs(value - centre)) > 96 * 0.5 THEN 'smooth' ELSE 'fixed' END AS mode FROM events JOIN f USING (user_id) GROUP BY user_id")
def crop_mode(t):
    """Whether the mean distance from the fixed centre passes a share of the crop's size."""
    f = t("events").groupBy("user_id").agg(F.percentile("value", 0.5).alias("centre"))
    x = t("events").join(f, "user_id").groupBy("user_id").agg(F.avg(F.abs(c("value") - c("centre"))).alias("motion"))
    return x.select("user_id", F.when(c("motion") > 96 * 0.5, "smooth").otherwise("fixed").alias("mode"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_discount DESC, l_linenumber) AS place FROM lineitem")
def three_key_order(t):
    """T5: segments by three measures, highest first."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), F.desc("l_quantity"), F.desc("l_discount"), "l_linenumber"))
    return t("lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))
