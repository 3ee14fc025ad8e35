"""MinHash near-duplicate detection with HyperMinHash registers.

A document's set is its distinct five-word shingles (words: no ASCII white space; A-Z lowered). Each set gets 128
registers of 16 bits (leading-zero count and 10 mantissa bits); four registers make a band of one long. Bands propose,
a collision-corrected Jaccard estimate thins out, the full sets decide, union-find groups.

Memory. Texts are read in pieces, and blocks hold BLOCK sets or BLOCK_BYTES, so a task holds two blocks of bounded size.

Skew. Equal sets share a 16-byte key and are one node, so thousands of copies cost one. Within a band, members are
compared with one centre (its least key), which is linear. Only bands that still hold more than one component after
that are looked at again: their members, grouped by the bands they share, are cut into blocks, and each
pair of blocks is a task that compares registers, skips what is connected already and emits only confirmed links. So
no link that a band proposes is lost, no task holds more than two blocks, and no pairs are written out.

Cases. Null or empty text, or no word: n_shingles 0, linked with nothing, component_id = doc_id, kept. Null doc_id:
takes part; it is kept only if its whole component has no doc_id. Rows that repeat a doc_id share their fate when
texts agree, else each follows its own text. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as S
from .common import SPACE, connected_components, materialize, table

PERCENT = 75
#: A pair is compared in full if its estimate reaches this: five standard deviations of 128 registers below 0.75.
LEAST_ESTIMATE = 0.55
#: Sets, and bytes of them, in a block.
BLOCK, BLOCK_BYTES = 1000, 16_000_000
SIGNED = "doc_id long, text_hash long, n_shingles long, key binary, bands array<long>"
SETS = "key binary, regs binary, shingles binary"


def _sets(batches, column=1):
    """(piece of a batch, row, set): pieces hold a bounded number of bytes of text, whatever the batch holds."""
    hashes = S.WordHashes()
    for whole in batches:
        for lo, hi in S.pieces(whole.column(column).cast(pa.binary())):
            batch = whole.slice(lo, hi - lo)
            texts = batch.column(column).cast(pa.binary())
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                yield batch, i, S.shingle_set(hashes.of(t.lower().split())) if t else np.empty(0, S.U)


def _sign(batches):
    """(doc_id, text, text_hash) -> SIGNED."""
    out, last = [], None

    def rows():
        ids = last.column(0)
        return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), last.column(2), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_shingles", "key", "bands"])

    for batch, _, s in _sets(batches):
        if last is not None and batch is not last:
            yield rows()
            out.clear()
        last = batch
        out.append((len(s), S.set_key(s), S.registers(s).view(np.int64)) if len(s) else (0, None, None))
    if last is not None:
        yield rows()


def _full(batches):
    """(key, text) -> SETS, for the texts whose set has that key (a doc_id may stand for several texts)."""
    out, held = [], 0

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(3)], ["key", "regs", "shingles"])

    for batch, i, s in _sets(batches):
        key = S.set_key(s) if len(s) else b""
        if key == batch.column(0)[i].as_py():
            out.append((key, S.registers(s).tobytes(), s.tobytes()))
            held += s.nbytes
        if held > 8_000_000:
            yield rows()
            out, held = [], 0
    if out:
        yield rows()


def _verify(batches):
    """(a, b, regs_a, set_a, regs_b, set_b) -> confirmed (a, b)."""
    for batch in batches:
        a, b, *parts = (batch.column(i) for i in range(6))
        good = []
        for i in range(batch.num_rows):
            ra, sa, rb, sb = (np.frombuffer(p[i].as_py(), kind) for p, kind in zip(parts, (np.uint16, S.U, np.uint16, S.U), strict=True))
            if 100 * min(len(sa), len(sb)) >= PERCENT * max(len(sa), len(sb)) and S.estimate((ra == rb).mean(), len(sa), len(sb))[0] >= LEAST_ESTIMATE and S.similar(sa, sb, PERCENT):
                good.append(i)
        yield pa.RecordBatch.from_arrays([x.take(pa.array(good, pa.int64())) for x in (a, b)], ["a", "b"])


def _tile(rows: pa.Table) -> pa.Table:
    """The sets of one block, or of two: links that connect what was not connected, a spanning forest of them."""
    block = rows["block"].to_numpy()
    order = np.argsort(block, kind="stable")
    keys, block = rows["key"].take(pa.array(order)).to_pylist(), block[order]
    _, label = np.unique(np.array([x.hex() for x in rows["component"].take(pa.array(order)).to_pylist()]), return_inverse=True)
    regs = np.stack([np.frombuffer(rows["regs"][i].as_buffer(), np.uint16) for i in order.tolist()])
    sets = [np.frombuffer(rows["shingles"][i].as_buffer(), S.U) for i in order.tolist()]  # views, no copies
    size = np.array([len(x) for x in sets])
    second = int(np.searchsorted(block, block[0], "right"))
    alone = second == len(block)
    links = []
    for i in range(len(block) if alone else second):
        at = np.arange(i + 1 if alone else second, len(block))
        at = at[(label[at] != label[i]) & (100 * np.minimum(size[at], size[i]) >= PERCENT * np.maximum(size[at], size[i]))]
        if len(at):
            equal = (regs[at] == regs[i]).mean(axis=1)
            for j in at[S.estimate(equal, size[at], size[i]) >= LEAST_ESTIMATE].tolist():
                if label[j] != label[i] and S.similar(sets[i], sets[j], PERCENT):
                    links.append((keys[i], keys[j]))
                    label[label == label[j]] = label[i]
    return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, text_hash, n_shingles, component_id, kept; a row for each row of docs."""
    signed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash")).mapInArrow(_sign, SIGNED), "signed")
    rows = signed.where("key is not null")
    banded = rows.select("key", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("band"), "key")
    several = banded.groupBy("band").agg(F.min("key").alias("centre"), F.max("key").alias("other")).where("centre <> other").select("band", "centre")
    members = materialize(banded.join(several, "band").distinct(), "members")
    stars = materialize(members.where("key <> centre").select(F.col("centre").alias("a"), F.col("key").alias("b")).distinct(), "pairs")

    reps = rows.join(members.select("key").distinct(), "key").groupBy("key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("key", "r.*")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("string").alias("text"))
    texts = texts.join(reps, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("key", "text")
    sets = materialize(texts.mapInArrow(_full, SETS).dropDuplicates(["key"]), "sets")

    left = sets.select(F.col("key").alias("a"), F.col("regs").alias("regs_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("regs").alias("regs_b"), F.col("shingles").alias("set_b"))
    full = stars.join(left, "a").join(right, "b").select("a", "b", "regs_a", "set_a", "regs_b", "set_b")
    links = materialize(full.mapInArrow(_verify, "a binary, b binary"), "links")
    found = connected_components(links)

    placed = members.join(found, members["key"] == found["id"], "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    open_ = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("key").alias("centre")).where("lo <> hi").select("band", "centre")
    again = materialize(placed.join(open_, "band").select("key", "component", "centre").distinct(), "open")
    if not again.isEmpty():
        group = connected_components(again.select(F.col("key").alias("a"), F.col("centre").alias("b")))
        group = again.select("key", "component").distinct().join(group.select(F.col("id").alias("key"), F.col("component").alias("grp")), "key")
        weight = sets.select("key", F.octet_length("shingles").alias("bytes"))
        of_size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES))
        blocks = group.join(weight, "key").groupBy("grp").agg(of_size.cast("int").alias("blocks"))
        dealt = group.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "component").join(sets, "key")
        more = materialize(dealt.groupBy("grp", "i", "j").applyInArrow(_tile, "a binary, b binary"), "more")
        if not more.isEmpty():
            found = connected_components(links.unionByName(more))

    class_doc = rows.groupBy("key").agg(F.min("doc_id").alias("doc"))
    grouped = found.join(class_doc, found["id"] == class_doc["key"]).select("key", "component", "doc")
    least = grouped.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_key = grouped.join(least, "component").select("key", "component_id")
    alone = class_doc.join(of_key, "key", "left_anti").select("key", F.col("doc").alias("component_id"))
    out = signed.join(of_key.unionByName(alone), "key", "left")
    out = out.select("doc_id", "text_hash", "n_shingles", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, least(5, len(w)) AS k FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+k-1], ' ')) AS s FROM k, unnest(range(1, len(w) - k + 2)) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON a = r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op10_hyperminhash_near_dedup": query}
ORACLES = {"op10_hyperminhash_near_dedup": ORACLE}
