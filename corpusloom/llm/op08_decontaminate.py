r"""Benchmark decontamination with SimHash windows and a multi-index Hamming search, in DataFrame functions only.

Words are runs without ASCII white space, lower-cased. An item of L words is compared with windows of L consecutive
words of a document (all of it, if it is shorter). Similarity is the weighted Jaccard of five-word shingles, a
shingle weighing its number of occurrences (items under five words: the whole sequence is the shingle); a document
is contaminated by an item if a window reaches PERCENT.

1. Windows. A window that shares no shingle with an item has similarity 0, and sliding a window right until its
   first shingle is one of the item's never lowers it. So windows are taken at each occurrence of an item's shingle,
   moved left only where the document ends: no other window can score higher.
2. Fingerprints. 64-bit SimHash over the words of the window.
3. Search. A fingerprint is cut into RADIUS + 1 blocks: two within RADIUS bits agree in one block at least, so a join
   on (size, block number, block value) finds every item within the radius. A pair is taken from its first common block.
4. Decision. The exact weighted similarity.

Scale. Item shingles and blocks are broadcast while their counted number is at most BROADCAST_ROWS, and joined by
shuffle beyond; likewise the keys of documents with a hit, and their windows' places. Only texts of documents with a hit
are shuffled, where the places exceed BROADCAST_BYTES; all texts where the keys do, too. Windows grow with the occurrences
of item shingles only, and every step is per window, so a passage that a third of the documents hold costs in proportion.

Cases. Null or empty text or item: contaminates nothing. Null doc_id: reported with a null doc_id. Rows that repeat a
doc_id: judged by their own text; equal texts give one row. Repeated items: each reported. Ties: the earliest window.
Empty tables: empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, fresh, materialize, small, table

SHINGLE, PERCENT, RADIUS, BITS = 5, 75, 20, 64
_WIDTH = BITS // (RADIUS + 1)  # bits of a block; the last one takes the rest


def _words(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), SPACE), "")


def _hashes(words: str, k):
    """Hashes of the k-word shingles of a column that the same projection reads elsewhere too."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<long>"))


def _simhash(features):
    """Bit b is set if over half of the features have it."""
    ones = lambda b: F.aggregate(features, F.lit(0), lambda a, h: a + F.getbit(h, b).cast("int"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(2 * ones(b) > F.size(features), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def _blocks(fp: str):
    def block(b):
        last = F.call_function("shiftrightunsigned", F.col(fp), (b * _WIDTH).cast("int"))
        return F.when(b < RADIUS, last.bitwiseAND(F.lit(2**_WIDTH - 1).cast("long"))).otherwise(last) + b.cast("long") * 2 ** (BITS - RADIUS * _WIDTH + 1)

    return F.transform(F.sequence(F.lit(0), F.lit(RADIUS)), block)


def _tagged(ordered: str):
    """Sorted hashes, each with the number of its occurrence: as sets, these intersect as the multisets do."""
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x).cast("int")))


def _fingerprinted(x: DataFrame) -> DataFrame:
    """x with words `words` and shingle size `k` -> fp, blocks, tags and weight."""
    x = x.withColumns({"_features": F.transform("words", lambda v: F.xxhash64(v)), "_ordered": F.sort_array(_hashes("words", F.col("k")))})
    x = x.withColumns({"fp": _simhash(F.col("_features")), "tags": _tagged("_ordered"), "weight": F.size("_ordered")})
    return x.withColumn("blocks", _blocks("fp")).drop("_features", "_ordered")


def _with_places(docs: DataFrame, at: DataFrame) -> DataFrame:
    """docs (doc_id, text_hash, text) that have a row in at (id, hash, at), with it; others are left out before a shuffle."""
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash"))
    return docs.join(small(at.select("id", "hash")), same, "left_semi").join(small(at), same)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text_hash, item_id, start (0-based word), similarity: a row per contaminated (document, item)."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    docs = whole.select("doc_id", "text_hash", _words(F.col("text")).alias("words"))
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumns({"size": F.size("words"), "k": F.least(F.lit(SHINGLE), F.size("words"))})
    items = materialize(_fingerprinted(items.withColumn("hashes", F.array_distinct(_hashes("words", F.col("k"))))), "items")

    found = None
    for (k,) in sorted(items.select("k").distinct().collect()):  # at most SHINGLE values
        wanted = items.where(F.col("k") == k).select(F.explode("hashes").alias("hash"), "size").distinct()
        placed = docs.withColumn("n", F.size("words")).withColumn("hashes", _hashes("words", F.lit(k)))
        placed = placed.select("doc_id", "text_hash", "n", F.posexplode_outer("hashes").alias("pos", "hash"))
        hit = placed.join(small(wanted), "hash").select("doc_id", "text_hash", "size", F.lit(k).alias("k"), F.greatest(F.lit(0), F.least("pos", F.col("n") - F.col("size"))).alias("start"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, text_hash long, item_id long, start int, similarity double")
    hits = materialize(found.distinct(), "hits")

    at = hits.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash")).agg(F.collect_list(F.struct("size", "k", "start")).alias("at"))
    texts = _with_places(whole, materialize(at, "at")).select("doc_id", "text_hash", "at", _words(F.col("text")).alias("words"))
    windows = texts.select("doc_id", "text_hash", F.explode_outer(F.transform("at", lambda v: F.struct(v["size"].alias("size"), v["k"].alias("k"), v["start"].alias("start"), F.slice("words", v["start"] + 1, v["size"]).alias("words")))).alias("w"))
    windows = materialize(_fingerprinted(windows.select("doc_id", "text_hash", "w.*")).drop("words"), "windows")

    index = items.select(F.col("item_id"), "size", F.col("fp").alias("item_fp"), F.col("blocks").alias("item_blocks"), F.col("tags").alias("item_tags"), F.col("weight").alias("item_weight"), F.explode("blocks").alias("block"))
    pairs = windows.withColumn("block", F.explode("blocks")).join(small(index), ["size", "block"])
    pairs = pairs.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS) & (F.col("block") == F.array_intersect("blocks", "item_blocks")[0]))
    pairs = pairs.withColumn("common", F.size(F.array_intersect("tags", "item_tags"))).withColumn("all", F.col("weight") + F.col("item_weight") - F.col("common"))
    good = pairs.where(100 * F.col("common") >= PERCENT * F.col("all")).select("doc_id", "text_hash", "item_id", F.struct((F.col("common") / F.col("all")).alias("similarity"), (-F.col("start")).alias("back")).alias("best"))
    best = good.groupBy("doc_id", "text_hash", "item_id").agg(F.max("best").alias("best"))
    return best.select("doc_id", "text_hash", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates; same columns as docs."""
    key, hashed = fresh(docs.columns, "_id", "_hash")
    bad = matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(key), F.col("text_hash").alias(hashed)).distinct()
    bad = materialize(bad, "contaminated")
    return docs.join(small(bad), F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(hashed)), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs (doc_id, item_id) of contaminated documents, with the best window's start and similarity."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.col("start").cast("long").alias("start"), F.round("similarity", 9).alias("similarity"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, w, len(w) AS size, least({SHINGLE}, len(w)) AS k FROM (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{SPACE}'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
bs AS (SELECT item_id, size, k, s, count(*) AS n FROM (SELECT item_id, size, k, array_to_string(w[i:i+k-1], ' ') AS s FROM b, unnest(range(1, len(w) - k + 2)) AS u(i)) GROUP BY ALL),
ds AS (SELECT doc_id, len(w) AS dn, kk.k, i, array_to_string(w[i:i+kk.k-1], ' ') AS s FROM d, (SELECT DISTINCT k FROM b) kk, unnest(range(1, len(w) - kk.k + 2)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, item_id, size, ds.k, greatest(1, least(i, dn - size + 1)) AS a, least(size, dn) AS len FROM ds JOIN bs USING (k, s)),
win AS (SELECT h.doc_id, h.item_id, h.a, h.size, h.k, h.len, ds.s, count(*) AS c FROM hit h JOIN ds ON ds.doc_id = h.doc_id AND ds.k = h.k AND ds.i BETWEEN h.a AND h.a + h.len - h.k GROUP BY ALL),
sim AS (SELECT win.doc_id, win.item_id, a, any_value(win.size - win.k + 1) + any_value(len - win.k + 1) AS both_n, sum(least(c, n)) AS common FROM win JOIN bs USING (item_id, s) GROUP BY win.doc_id, win.item_id, a)
SELECT doc_id, item_id, a - 1 AS start, round(common / (both_n - common), 9) AS similarity FROM sim WHERE 100 * common >= {PERCENT} * (both_n - common)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common DESC, a) = 1
"""

QUERIES = {"op8_decontaminate": query}
ORACLES = {"op8_decontaminate": ORACLE}
