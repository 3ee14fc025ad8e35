"""Substring de-duplication by super-k-mer partitioning.

A window is WINDOW consecutive words of one document (words: no ASCII white space, unchanged). A window's minimiser is
the least hash among its MMER-word pieces, so equal windows have equal minimisers. Consecutive windows that share one
travel as a single packed string, a super-k-mer, to the minimiser's bucket; there, sorting the windows' hashes brings
equal ones together and their words are compared, which counts them exactly. Every word that a repeated window covers
is removed; windows are judged on the input.

Skew. A task first sorts its own windows, CHUNK words at a time: windows that repeat within the chunk are settled
there, and one of each is sent. So a passage that a third of all documents hold reaches its bucket once per chunk.

Buckets. One for every BUCKET_BYTES of input as stored, and BUCKETS_PER_PARTITION times spark.sql.shuffle.partitions at
least, so a bucket's size does not grow with the input.

Cases. Null text: no words (n_words 0, the hash of the empty string). Documents under WINDOW words: nothing removed.
Rows that repeat a doc_id: each counts as a document of its own (equal texts repeat each other). Null doc_id: handled
like any other value. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, buckets, table
from .shingles import M1, U, WordHashes, mix, pieces

WINDOW, MMER = 35, 4
CHUNK = 12_000_000  # bytes of text that a task sorts at once
BUCKETS_PER_PARTITION, BUCKET_BYTES = 4, 4_000_000
_STEP = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_BACK = pow(_STEP, -1, 2**64)
_LETTERS = mix(np.arange(1, 257, dtype=U) * M1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[:1] = U(1)
    return np.multiply.accumulate(out)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` values, equal for equal runs wherever they start."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U)
    sums = np.concatenate(([U(0)], np.cumsum(h * _powers(_STEP, len(h)), dtype=U)))
    return mix((sums[size:] - sums[:-size]) * _powers(_BACK, n))


def repeated(text, begins: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows text[begin:end]: which repeat, and which are not the first of their kind. Equal words decide."""
    order = np.argsort(hashes, kind="stable")
    x = hashes[order]
    twin = np.flatnonzero(x[1:] == x[:-1])
    many, later = np.zeros(len(begins), bool), np.zeros(len(begins), bool)
    one, two = order[twin], order[twin + 1]
    for i, j, a, b, c, d in zip(one.tolist(), two.tolist(), begins[one].tolist(), ends[one].tolist(), begins[two].tolist(), ends[two].tolist(), strict=True):
        if text[a:b] == text[c:d]:
            many[i] = many[j] = later[j] = True
        else:  # two texts with one hash: look at all windows with it
            same = [k for k in order[np.searchsorted(x, hashes[i]) : np.searchsorted(x, hashes[i], "right")].tolist()]
            seen: dict = {}
            for k in sorted(same):
                key = text[begins[k] : ends[k]]
                key = key if isinstance(key, bytes) else tuple(key)
                if key in seen:
                    many[k] = many[seen[key]] = later[k] = True
                else:
                    seen[key] = k
    return many, later


def spans(starts: np.ndarray) -> bytes:
    """Sorted window starts as merged [start, end) word ranges, packed."""
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    return np.stack([starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [len(starts) - 1]))] + WINDOW], axis=1).astype(np.uint32).tobytes()


COLUMNS = [pa.field("bucket", pa.int32()), pa.field("doc_id", pa.int64()), pa.field("text_hash", pa.int64()), pa.field("packed", pa.binary())]
SCHEMA = "bucket int, doc_id long, text_hash long, packed binary"


def _pack(buckets: int):
    """(doc_id, text_hash, text) -> a row per bucket with super-k-mers, and per document the ranges settled here."""

    def run(batches):
        hashes, press = WordHashes(), zstandard.ZstdCompressor(3)
        for batch in batches:
            column = batch.column(2).cast(pa.binary())
            for lo, hi in pieces(column, CHUNK):
                yield from chunk(batch.slice(lo, hi - lo), column.slice(lo, hi - lo).to_pylist(), hashes, press)

    def chunk(batch, texts, hashes, press):
        lists = [t.split() if t else [] for t in texts]
        words = [w for x in lists for w in x]
        sizes = np.array([len(x) for x in lists], np.int64)
        del lists
        ends = np.cumsum(sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        n = len(words) - WINDOW + 1
        if n <= 0:
            return
        h = hashes.of(words)
        at = np.flatnonzero(doc[: n] == doc[WINDOW - 1 :])  # windows inside one document
        if not len(at):
            return
        many, later = repeated(words, at, at + WINDOW, window_hashes(h, WINDOW)[at])
        ids, texts_hash = batch.column(0).cast(pa.int64()), batch.column(1)
        rows = [[], [], [], []]

        def put(*row):
            for x, v in zip(rows, row, strict=True):
                x.append(v)

        settled = at[many]
        for d, s in zip(*_by(doc[settled], settled), strict=True):
            put(int(mix(np.array([d], U))[0] % U(buckets)), ids[d].as_py(), texts_hash[d].as_py(), spans(s - (ends[d] - sizes[d])))
        low = mix(window_hashes(h, MMER) ^ M1)
        step = 1
        while step < WINDOW - MMER + 1:  # 32 pieces to a window: five doublings
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        sent = at[~later]
        key = low[sent]
        new = np.concatenate(([True], (np.diff(sent) != 1) | (key[1:] != key[:-1]) | (doc[sent][1:] != doc[sent][:-1])))
        first = sent[new]
        last = sent[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(sent) - 1]))] + WINDOW
        bucket = (mix(key[new]) % U(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        offset = ends - sizes
        id_of = np.array([x if x is not None else 0 for x in ids.to_pylist()], np.int64)
        null_of = np.array([x is None for x in ids.to_pylist()], np.int64)
        hash_of = np.array(texts_hash.to_pylist(), np.int64)
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts):
            a, b = first[part], last[part]
            d = doc[a]
            head = np.stack([id_of[d], null_of[d], hash_of[d], a - offset[d]], axis=1).astype(np.int64).tobytes()
            body = b"\n".join(b" ".join(words[s:e]) for s, e in zip(a.tolist(), b.tolist(), strict=True))
            put(int(bucket[part[0]]), None, None, press.compress(np.int64(len(part)).tobytes() + head + body))
            if len(rows[0]) >= 256:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, COLUMNS, strict=True)], schema=pa.schema(COLUMNS))
                rows = [[], [], [], []]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, COLUMNS, strict=True)], schema=pa.schema(COLUMNS))

    return run


def _by(keys: np.ndarray, values: np.ndarray):
    """Distinct sorted keys and, for each, its values (keys are sorted already)."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    return (keys[np.concatenate(([0], cut))].tolist() if len(keys) else []), (np.split(values, cut) if len(keys) else [])


def _count(rows: pa.Table) -> pa.Table:
    """The rows of one bucket -> the ranges that windows repeated across chunks cover, and those settled before.

    The words stay one byte string: a window's hash is a difference of running sums over its bytes.
    """
    out = [[], [], []]
    heads, bodies, press = [], [], zstandard.ZstdDecompressor()
    for text_hash, doc_id, packed in zip(rows["text_hash"], rows["doc_id"], rows["packed"], strict=True):
        if text_hash.is_valid:
            for x, v in zip(out, (doc_id.as_py(), text_hash.as_py(), packed.as_py()), strict=True):
                x.append(v)
            continue
        raw = press.decompress(packed.as_py())
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        heads.append(np.frombuffer(raw, np.int64, 4 * n, 8).reshape(n, 4))
        bodies.append(raw[8 + 32 * n :])
    if heads:
        head, body = np.concatenate(heads), b"\n".join(bodies)
        del heads, bodies
        letters = np.frombuffer(body, np.uint8)
        gaps = np.flatnonzero((letters == 32) | (letters == 10))
        word_at, word_end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(letters)]))
        last = np.concatenate((np.flatnonzero(letters[gaps] == 10), [len(gaps)]))  # of each super-k-mer, its last word
        first = np.concatenate(([0], last[:-1] + 1))
        runs = last - first + 2 - WINDOW
        within = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        start = np.repeat(first, runs) + within
        doc, begin = np.repeat(np.arange(len(head)), runs), np.repeat(head[:, 3], runs) + within
        sums = np.concatenate(([U(0)], np.cumsum(_LETTERS[letters] * _powers(_STEP, len(letters)), dtype=U)))
        a, b = word_at[start], word_end[start + WINDOW - 1]
        hashes = mix((sums[b] - sums[a]) * _powers(_BACK, len(letters))[a])
        del sums
        many, _ = repeated(body, a, b, hashes)
        doc, begin = doc[many], begin[many]
        if len(doc):
            owner = head[doc, :3]
            order = np.lexsort((begin, owner[:, 2], owner[:, 1], owner[:, 0]))
            owner, begin = owner[order], begin[order]
            cut = np.flatnonzero((owner[1:] != owner[:-1]).any(axis=1)) + 1
            for o, s in zip(owner[np.concatenate(([0], cut))].tolist(), np.split(begin, cut), strict=True):
                for x, v in zip(out, (None if o[1] else o[0], o[2], spans(s)), strict=True):
                    x.append(v)
    return pa.table({"doc_id": pa.array(out[0], pa.int64()), "text_hash": pa.array(out[1], pa.int64()), "packed": pa.array(out[2], pa.binary())})


def _cut(batches):
    """(doc_id, text, ranges) -> doc_id, n_words, n_removed, kept_sha256, kept_text."""
    for batch in batches:
        out = [[], [], [], []]
        texts = batch.column(1).cast(pa.binary())
        for i in range(batch.num_rows):
            words = (texts[i].as_py() or b"").split()
            gone = np.zeros(len(words) + 1, np.int64)
            for packed in batch.column(2)[i].as_py() or ():
                x = np.frombuffer(packed, np.uint32).reshape(-1, 2)
                np.add.at(gone, x[:, 0], 1)
                np.add.at(gone, x[:, 1], -1)
            gone = np.cumsum(gone)[:-1] > 0
            removed = int(gone.sum())
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed else words)
            for x, v in zip(out, (len(words), removed, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), ranges: packed [start, end) word ranges to remove, as a list."""
    number = buckets(docs, BUCKET_BYTES, max(64, BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_pack(number), SCHEMA)
    found = found.groupBy("bucket").applyInArrow(_count, "doc_id long, text_hash long, packed binary")
    return found.groupBy("doc_id", "text_hash").agg(F.collect_list("packed").alias("ranges"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_words, n_removed, kept_sha256, kept_text; a row for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = repeated_ranges(docs).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "ranges")
    both = docs.join(ranges, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")), "left")
    return both.select("doc_id", "text", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, md5(array_to_string(w[i:i+{WINDOW - 1}], ' ')) AS k FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i)),
dup AS (SELECT doc_id, i FROM wins QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT DISTINCT doc_id, j FROM dup, unnest(range(i, i + {WINDOW})) AS u(j)),
words AS (SELECT doc_id, j, w[j] AS x FROM d, unnest(range(1, len(w) + 1)) AS u(j)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS s, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

QUERIES = {"op9_substring_dedup": query}
ORACLES = {"op9_substring_dedup": ORACLE}
