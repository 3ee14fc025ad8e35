"""Queries of the operators with order-dependent state; SQL has no form for most, so tests compare with plain Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sequences, stateful
from .base import query
from .texts import english
from .timed import timed
from .vectors import frames


@query()
def assign_tracks(t):
    """J12-J14"""
    x = timed(t).select("user_id", F.floor(F.col("t") / 3600).cast("int").alias("frame"), F.col("event_id").alias("pos"), F.col("value").alias("cx"), (F.col("event_id") % 10).cast("double").alias("cy"))
    return stateful.assign_tracks(x, "user_id", 12.0)


@query()
def beam_search(t):
    """C2, C5, C6, T6"""
    x = stateful.beam_decode(frames(t), "vec_id")
    return x.select("vec_id", "rank", "decoded", F.round("score", 5).alias("score"))


@query()
def confusion_matrix(t):
    """A28"""
    b = t("benchmark").select("item_id", T.phonemes(F.col("text")).alias("target"))
    x = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("target").alias("got")), "item_id")
    return stateful.confusion(x)


@query()
def correct_tokens(t):
    """Whole texts, by the vocabulary and bigrams of the benchmark (small: the driver and each task hold them)."""
    tok = t("benchmark").select(T.tokens(english()).alias("tok"))
    words = tok.select(F.explode("tok").alias("w")).groupBy("w").count().collect()
    two = F.filter(F.transform("tok", lambda v, i: F.struct(v.alias("a"), F.get("tok", i + 1).alias("b"))), lambda v: v["b"].isNotNull())
    pairs = tok.select(F.explode_outer(two).alias("p")).where("p is not null").groupBy("p.a", "p.b").count().collect()
    docs = t("documents").select(F.col("doc_id").alias("id"), T.tokens(english()).alias("tok"))
    out = stateful.correct_tokens(docs, {r.w: r["count"] for r in words}, {(r.a, r.b): r["count"] for r in pairs})
    return out.select(F.col("id").alias("doc_id"), F.array_join("tok", " ").alias("text"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9'' ]+', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def romanize(t):
    """X16, H11"""
    return t("documents").select("doc_id", stateful.romanize("text").alias("text"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_diacritics(t):
    """X2 with diacritics removed."""
    return t("documents").select("doc_id", stateful.strip_diacritics("text").alias("text"))


@query("SELECT conv_id, turn, 2.0 * turn AS start, 2.0 * turn + 1.5 AS \"end\", text FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations) WHERE text <> ''")
def parse_captions(t):
    """Conversations written as captions and read back."""
    stamp = lambda c: F.format_string("00:%02d:%06.3f", F.floor(c / 60).cast("int"), c - 60 * F.floor(c / 60))
    s = 2.0 * F.col("turn")
    body = F.trim(F.regexp_replace("text", r"\s+", " "))
    x = t("conversations").select("conv_id", "turn", F.concat(F.lit("WEBVTT\n\n"), stamp(s), F.lit(" --> "), stamp(s + 1.5), F.lit("\n"), body, F.lit("\n\n")).alias("vtt"))
    x = x.select("conv_id", "turn", F.explode(stateful.parse_captions("vtt")).alias("c"))
    return x.select("conv_id", "turn", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.text").alias("text"))
