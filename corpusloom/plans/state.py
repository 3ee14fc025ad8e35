"""Queries over keyed state: incremental work, scores, splits, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules, sampling
from .base import query

c = F.col


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = a.l_orderkey AND o.o_orderstatus = a.l_linestatus)")
def incremental_pending(t):
    """Rows without a saved result of the same key and signature (null-safe)."""
    done = t("orders").select(c("o_orderkey").alias("k"), c("o_orderstatus").alias("sig"))
    a = t("lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return a.join(done, (c("l_orderkey") == c("k")) & c("l_linestatus").eqNullSafe(c("sig")), "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 45)")
def new_candidates(t):
    """Neither checked nor downloaded."""
    p = t("part").select("p_partkey", "p_size")
    checked = t("lineitem").where("l_quantity > 49").select(c("l_partkey").alias("p_partkey"))
    return p.join(checked, "p_partkey", "left_anti").join(p.where("p_size > 45").select("p_partkey"), "p_partkey", "left_anti").select("p_partkey")


@query("""WITH new AS (SELECT c_custkey AS k, round(c_acctbal * 2, 2) AS bal, 'new' AS src FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, c_acctbal, 'new' FROM customer WHERE c_custkey % 7 = 0)
SELECT coalesce(c_custkey, k) AS key, c_name AS name, coalesce(new.bal, c_acctbal) AS balance FROM customer FULL OUTER JOIN new ON c_custkey = k""")
def upsert_by_key(t):
    """Existing rows keep their columns, one is overwritten."""
    cu = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = cu.where("c_custkey % 3 = 0").select(c("c_custkey").alias("k"), F.round(c("c_acctbal") * 2, 2).alias("bal")).unionAll(cu.where("c_custkey % 7 = 0").select((c("c_custkey") + 1000000).alias("k"), c("c_acctbal").alias("bal")))
    return cu.join(new, c("c_custkey") == c("k"), "full_outer").select(F.coalesce("c_custkey", "k").alias("key"), c("c_name").alias("name"), F.coalesce("bal", "c_acctbal").alias("balance"))


MESSAGE = "CASE o_orderkey % 8 WHEN 0 THEN 'Too Many Requests' WHEN 1 THEN 'quota used' WHEN 2 THEN 'HTTP 403 Forbidden' WHEN 3 THEN 'connection reset' WHEN 4 THEN 'Video unavailable' WHEN 5 THEN 'timed out' WHEN 6 THEN 'odd ' || o_orderpriority ELSE 'not found' END"


@query(f"""WITH m AS (SELECT lower({MESSAGE}) AS m FROM orders), k AS (SELECT CASE WHEN m LIKE '%rate limit%' OR m LIKE '%too many requests%' THEN 'rate_limit' WHEN m LIKE '%quota%' THEN 'quota' WHEN m LIKE '%forbidden%' OR m LIKE '%blocked%' THEN 'blocked'
 WHEN m LIKE '%network%' OR m LIKE '%connection%' THEN 'network' WHEN m LIKE '%unavailable%' OR m LIKE '%not found%' THEN 'unavailable' WHEN m LIKE '%timeout%' OR m LIKE '%timed out%' THEN 'timeout' ELSE 'unknown' END AS kind FROM m) SELECT kind, count(*) AS n FROM k GROUP BY kind""")
def error_classification(t):
    """Ordered substring rules, counted."""
    m = t("orders").select(F.lower(F.expr(MESSAGE)).alias("m"))
    return m.select(error_kind(c("m")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


def error_kind(message, status=None):
    """The class of an error message and status code, by the first rule that fits."""
    low, code = F.lower(message), F.lit(None).cast("int") if status is None else status
    has = lambda *words: low.rlike("|".join(words))
    return rules.first_reason([
        ("rate_limit", code.eqNullSafe(429) | has("rate limit", "too many requests")), ("quota", has("quota")), ("blocked", code.eqNullSafe(403) | has("forbidden", "blocked")),
        ("network", code.isin(500, 502, 503, 504) | has("network", "connection")), ("unavailable", code.eqNullSafe(404) | has("unavailable", "not found")), ("timeout", has("timeout", "timed out")),
    ], "unknown")


@query("SELECT o_custkey, o_orderkey, running FROM (SELECT o_custkey, o_orderkey, sum(100 + o_orderkey % 5) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS running FROM orders) WHERE running + 100 <= 1000")
def running_quota(t):
    """Cost so far, until the next call would exceed the limit."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t("orders").select("o_custkey", "o_orderkey", F.sum(100 + c("o_orderkey") % 5).over(w).alias("running")).where("running + 100 <= 1000")


@query("SELECT p_partkey, (CASE WHEN p_type LIKE '%STEEL%' THEN 3 ELSE 0 END) + (CASE WHEN p_type LIKE '%BRASS%' OR p_type LIKE '%TIN%' THEN 2 ELSE 0 END) - (CASE WHEN p_brand LIKE '%1%' THEN 3 ELSE 0 END) + (CASE WHEN lower(p_name) LIKE '%a%' THEN 1 ELSE 0 END) AS score FROM part")
def score_rules(t):
    """Literal hits, each list once."""
    hit = lambda cond, n: F.when(cond, n).otherwise(0)
    return t("part").select("p_partkey", (hit(c("p_type").contains("STEEL"), 3) + hit(c("p_type").rlike("BRASS|TIN"), 2) - hit(c("p_brand").contains("1"), 3) + hit(F.lower("p_name").contains("a"), 1)).alias("score"))


@query("SELECT c_custkey, round(least(1, greatest(0, (CASE WHEN c_acctbal >= 8000 THEN 0.5 WHEN c_acctbal >= 5000 THEN 0.4 WHEN c_acctbal >= 2000 THEN 0.3 WHEN c_acctbal >= 0 THEN 0.25 ELSE 0.1 END) + (CASE c_nationkey % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 0.15 ELSE 0.1 END) + (CASE c_mktsegment WHEN 'BUILDING' THEN 0.1 WHEN 'MACHINERY' THEN -0.2 ELSE 0 END))), 6) AS confidence FROM customer")
def confidence_bands(t):
    """banded parts, clamped to [0, 1]."""
    b = c("c_acctbal")
    part = F.when(b >= 8000, 0.5).when(b >= 5000, 0.4).when(b >= 2000, 0.3).when(b >= 0, 0.25).otherwise(0.1)
    land = F.when(c("c_nationkey") % 3 == 0, 0.35).when(c("c_nationkey") % 3 == 1, 0.15).otherwise(0.1)
    seg = F.when(c("c_mktsegment") == "BUILDING", 0.1).when(c("c_mktsegment") == "MACHINERY", -0.2).otherwise(0.0)
    return t("customer").select("c_custkey", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), part + land + seg)), 6).alias("confidence"))


@query("SELECT p_partkey, substr(sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || '}'), 1, 16) AS signature FROM part")
def config_signature(t):
    """The first 16 hex digits of the hash of compact, key-sorted JSON."""
    return t("part").select("p_partkey", F.substring(F.sha2(F.to_json(F.struct(c("p_brand").alias("brand"), c("p_size").alias("size"))), 256), 1, 16).alias("signature"))


@query("SELECT count(*) AS total, round(100.0 * count(*) FILTER (p_size > 25) / count(*), 6) AS large_pct, CAST(floor(avg(nullif(p_size, 1))) AS BIGINT) AS avg_size, CAST(sum(nullif(p_size, 1)) AS BIGINT) AS total_size FROM part")
def candidate_stats(t):
    """Percentages, and means over truthy values, cut to whole numbers."""
    size = F.nullif("p_size", F.lit(1))
    return t("part").agg(F.count("*").alias("total"), F.round(100.0 * F.count_if(c("p_size") > 25) / F.count("*"), 6).alias("large_pct"), F.floor(F.avg(size)).alias("avg_size"), F.sum(size).cast("long").alias("total_size"))


@query("SELECT p_partkey, rule FROM (SELECT p_partkey, CASE WHEN p_retailprice < 950 THEN 'too_few_views' WHEN p_size < 5 THEN 'not_hd' WHEN p_type LIKE '%TIN%' THEN 'no_caption' ELSE 'kept' END AS rule FROM part)")
def filter_candidates(t):
    """The first rule that drops a candidate."""
    return t("part").select("p_partkey", rules.first_reason([("too_few_views", c("p_retailprice") < 950), ("not_hd", c("p_size") < 5), ("no_caption", c("p_type").contains("TIN"))], "kept").alias("rule"))


@query("SELECT o_orderkey, least(2.0 * pow(2, o_orderkey % 12), 300.0) AS delay FROM orders")
def backoff_delay(t):
    """M6, without the random part."""
    return t("orders").select("o_orderkey", F.least(2.0 * F.pow(F.lit(2.0), c("o_orderkey") % 12), F.lit(300.0)).alias("delay"))


@query("SELECT source, first_doc FROM (SELECT source, doc_id AS first_doc, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def ordered_distinct(t):
    """The first row of each key."""
    return t("documents").groupBy("source").agg(F.min("doc_id").alias("first_doc"))


SPLIT = """WITH g AS (SELECT DISTINCT source FROM documents), r AS (SELECT source, row_number() OVER (ORDER BY sha256('42:' || source)) AS rn, greatest(1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT)) AS k FROM g),
s AS (SELECT source, CASE WHEN rn <= k THEN 'val' WHEN rn <= 2 * k THEN 'test' ELSE 'train' END AS split FROM r)"""


@query(f"{SPLIT} SELECT doc_id, split FROM documents JOIN s USING (source)")
def grouped_split(t):
    """All documents of a source share a split."""
    d = t("documents").select("doc_id", "source")
    return d.join(sampling.grouped_split(d, "source"), "source").select("doc_id", "split")


@query(f"{SPLIT} SELECT split, count(*) AS docs, count(DISTINCT source) AS sources, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents JOIN s USING (source) GROUP BY split")
def split_report(t):
    """A40, A36, Z14"""
    d = t("documents").select("source", "n_chars")
    x = d.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars")).join(sampling.grouped_split(d, "source"), "source")
    return x.groupBy("split").agg(F.sum("docs").alias("docs"), F.count("*").alias("sources"), F.sum("chars").alias("chars"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS split FROM documents")
def sample_split(t):
    """By row, without an ordering."""
    return t("documents").select("doc_id", F.when(sampling.hash_fraction(c("doc_id"), 7) < 0.7, "train").otherwise("test").alias("split"))


@query("SELECT lang, count(*) AS n, round(pow(1.0 / count(*), 0.7), 9) AS weight FROM documents GROUP BY lang")
def language_weights(t):
    """U8: weights of the balanced sampler."""
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.pow(1.0 / F.count("*"), F.lit(0.7)), 9).alias("weight"))


WC = "len(list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> ''))"


@query(f"SELECT item_id, CASE WHEN {WC} = 1 THEN 'single_words' WHEN {WC} BETWEEN 1 AND 5 THEN 'short' ELSE 'full' END AS phase FROM benchmark")
def curriculum_phase(t):
    """F8, U9"""
    n = F.size(F.array_remove(F.split("text", "[ \\t\\n]+"), ""))
    return t("benchmark").select("item_id", F.when(n == 1, "single_words").when(n.between(1, 5), "short").otherwise("full").alias("phase"))


@query("WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM r WHERE n <= 10 OR i IN (SELECT CAST(round_even(j * (n - 1) / 9.0, 0) AS BIGINT) FROM range(10) x(j))")
def even_limit(t):
    """Ten evenly spread rows of each group."""
    return sampling.even_limit(t("documents").select("source", "doc_id"), "source", ["doc_id"], 10)


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents")
def batch_ids(t):
    """U10"""
    rn = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t("documents").select("source", "doc_id", F.floor((rn - 1) / 8).alias("batch"))


@query("SELECT source, doc_id, rn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 4")
def first_n_per_group(t):
    """T9, T10, W19"""
    return t("documents").select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("rn")).where("rn <= 4")


@query("SELECT quality, n_chars > 1000 AS long, count(*) AS n, round(avg(toxic), 6) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY ALL")
def label_report(t):
    """Labels against a rule."""
    x = t("labels").join(t("documents").select("doc_id", "n_chars"), "doc_id")
    return x.groupBy("quality", (c("n_chars") > 1000).alias("long")).agg(F.count("*").alias("n"), F.round(F.avg("toxic"), 6).alias("toxic"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def event_log_fields(t):
    """Fields of a tolerant JSON column."""
    return t("events").select("event_type", F.from_json("props", "k INT")["k"].alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))
