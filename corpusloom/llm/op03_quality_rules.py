r"""Line-first quality rules, in DataFrame functions only.

Each \n-split line with a word is judged by three rules; a line that any of them names is removed:

* punctuation: it has no letter, or over 10 % of its non-space characters are symbols of ``#*$%&|<>``;
* navigation: at most NAV_WORDS words, and two or more separators, or nothing but menu words;
* boilerplate: at most PLATE_CHARS characters, with a phrase of BOILERPLATE.

A document is rejected if the removed lines hold over LOSS_PERCENT of its non-space characters, or if a base count
fails it (under 10 words, or over 20 % of its words in repeated five-word windows).

Every step is a function of one row: no shuffle, and no group that could be hot. Repeated windows are found by
sorting (hash, position) pairs only in the documents that have any, so the cost stays near-linear in a text's length.

Cases. Null text: no words, no lines, base_failed, not kept. Repeated rows and null doc_ids: each row is judged
alone. Empty table: empty result. Extra columns are ignored (judge) or passed through unchanged (clean).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table

BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, LOSS_PERCENT, SYMBOL_PERCENT = 10, 20, 50, 10
NAV_WORDS, PLATE_CHARS = 12, 300
SEPARATORS = r"[|»›•·]| > | / | :: "
MENU = r"(?i)^[\x20\x09-\x0D]*(home|menu|next|previous|prev|back|back to top|top|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|sitemap|share|share this|print|help|faq|skip to content|read more|click here|more)([\x20\x09-\x0D,.|>/-]+(home|menu|next|previous|prev|back|top|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|sitemap|share|print|help|faq|read more|more))*[\x20\x09-\x0D.>|]*$"
BOILERPLATE = r"(?i)(all rights reserved|copyright ©|copyright \(c\)|terms of (use|service)|privacy policy|cookie policy|uses cookies|accept cookies|enable javascript|javascript is (disabled|required)|subscribe to our newsletter|powered by wordpress|add to cart|lorem ipsum)"


def line_fails(x):
    """True for a line that a rule names; x: a line with a word."""
    solid = F.length(F.translate(x, BLANKS, ""))
    symbols = F.length(x) - F.length(F.translate(x, SYMBOLS, ""))
    words = F.length(F.trim(x)) - F.length(F.translate(F.trim(x), " ", "")) + 1
    parts = F.regexp_count(x, F.lit(SEPARATORS))
    punctuation = (100 * symbols > SYMBOL_PERCENT * solid) | ~x.rlike(r"\p{L}")
    navigation = (words <= NAV_WORDS) & (F.length(x) <= PLATE_CHARS) & ((parts >= 2) | x.rlike(MENU))
    boilerplate = (F.length(x) <= PLATE_CHARS) & x.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def judged(docs: DataFrame) -> DataFrame:
    """docs with _words (array), _lines (lines with a word), _good (lines kept) and the counts of the contract."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    x = docs.withColumn("_text", text)
    x = x.withColumns({
        "_words": F.array_remove(F.split("_text", SPACE), ""),
        "_lines": F.filter(F.split("_text", "\n", -1), lambda v: F.translate(v, BLANKS, "") != ""),
        "_solid": F.length(F.translate("_text", BLANKS, "")).cast("long"),
        "_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
    })
    # _words is read three times here, so it is computed once per row and not once per window.
    x = x.withColumns({
        "_n": F.size("_words").cast("long"),
        "_hash": F.when(F.size("_words") >= 5, F.transform(F.sequence(F.lit(1), F.size("_words") - 4), lambda i: F.xxhash64(F.slice("_words", i, 5)))),
        "_good": F.filter("_lines", lambda v: ~line_fails(v)),
        "_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    })
    x = x.withColumn("_sorted", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.array_sort(F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hit = lambda v, i: F.coalesce(v["h"] == F.get("_sorted", i - 1)["h"], F.lit(False)) | F.coalesce(v["h"] == F.get("_sorted", i + 1)["h"], F.lit(False))
    x = x.withColumn("_at", F.array_sort(F.transform(F.filter("_sorted", hit), lambda v: v["i"])))
    cover = F.transform("_at", lambda v, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - v, F.lit(5))))
    return x.withColumn("_repeat", F.coalesce(F.when(F.size("_at") > 0, F.aggregate(cover, F.lit(0).cast("long"), lambda a, v: a + v)), F.lit(0).cast("long")))


def _verdict(x: DataFrame) -> dict:
    lost = F.aggregate(F.transform("_good", lambda v: F.length(F.translate(v, BLANKS, ""))), F.lit(0).cast("long"), lambda a, v: a + v)
    return {
        "n_words": F.col("_n"), "word_chars": F.col("_solid"), "n_symbols": F.col("_symbols"), "n_dup_lines": F.col("_dup_lines"), "n_repeat_words": F.col("_repeat"),
        "base_failed": (F.col("_n") < MIN_WORDS) | (100 * F.col("_repeat") > REPEAT_PERCENT * F.col("_n")),
        "n_lines": F.size("_lines").cast("long"), "n_failed_lines": (F.size("_lines") - F.size("_good")).cast("long"), "lost_chars": F.col("_solid") - lost,
    }


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, the counts, base_failed and kept, n_lines, n_failed_lines, lost_chars."""
    x = judged(docs.select("doc_id", "text"))
    x = x.select("doc_id", *[c.alias(n) for n, c in _verdict(x).items()])
    return x.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOSS_PERCENT * F.col("word_chars")))


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed; same columns as docs."""
    names = docs.columns
    x = judged(docs.select("text", F.struct(*[f"`{c}`" for c in names]).alias("_row")))  # user columns cannot clash there
    verdict = _verdict(x)
    good = ~verdict["base_failed"] & (100 * verdict["lost_chars"] <= LOSS_PERCENT * verdict["word_chars"])
    x = x.where(good).select("_row", F.array_join("_good", "\n").alias("_text"))
    return x.select(*[F.col("_text").alias(c) if c.lower() == "text" else F.col(f"_row.`{c}`") for c in names])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


def _q(s: str) -> str:
    return s.replace("'", "''")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '{SPACE}'), lambda x: x <> '') AS w,
         length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
wins AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS k FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
dup AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS c FROM dup),
rep AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
marks AS (
  SELECT doc_id, l, length(regexp_replace(l, '{SPACE}', '', 'g')) AS solid,
         length(l) - length(translate(l, '#*$%&|<>', '')) AS sym,
         length(trim(l)) - length(replace(trim(l), ' ', '')) + 1 AS nw,
         len(regexp_extract_all(l, '{_q(SEPARATORS)}')) AS seps
  FROM lines),
rated AS (
  SELECT *, (100 * sym > {SYMBOL_PERCENT} * solid OR NOT regexp_matches(l, '\p{{L}}'))
         OR (nw <= {NAV_WORDS} AND length(l) <= {PLATE_CHARS} AND (seps >= 2 OR regexp_matches(l, '{_q(MENU)}')))
         OR (length(l) <= {PLATE_CHARS} AND regexp_matches(l, '{_q(BOILERPLATE)}')) AS bad
  FROM marks),
per AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines,
               coalesce(sum(solid) FILTER (bad), 0) AS lost_chars FROM rated GROUP BY doc_id),
res AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(w) < {MIN_WORDS} OR 100 * coalesce(rep.n, 0) > {REPEAT_PERCENT} * len(w) AS base_failed,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(lost_chars, 0) AS BIGINT) AS lost_chars
  FROM d LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, NOT base_failed AND 100 * lost_chars <= {LOSS_PERCENT} * word_chars AS kept FROM res
"""

QUERIES = {"op3_quality_rules": query}
ORACLES = {"op3_quality_rules": ORACLE}
