"""Language-model scores: smoothed unigram counts of the whole corpus, and a gated recurrent network.

Tokens are words (no ASCII white space, A-Z lowered) and one end a document. Documents whose crc32(doc_id) mod 5 is 1
are held out; the others teach.

1. Chunks. A task packs up to CHUNK bytes of text into a chunk: its distinct words, each token as a word's number, and
   each word's count in teaching documents. A word goes once per chunk to its hash bucket, so a word that makes up a
   third of all tokens is a row per chunk there, and no task ever holds the whole vocabulary.
2. Buckets add the counts up over all chunks, answer each chunk, and give the totals, the most frequent words and the
   totals of the rare classes (words by the hash of their ending).
3. The network (gru.py): the frequent words in classes, the others in rare classes; both grow with the vocabulary up to
   MOST_WORDS and MOST_RARE, which bound a task's weights and moments to about 5 MB. Its output starts at the counts;
   it starts on START_DOCS teaching documents at most, then every chunk trains on all its teaching documents
   and the weights are averaged.
4. Every whole document is scored in its chunk, the state carried from window to window. A rare word's probability is
   its class's times (c + 0.5) / (N_class + 0.5 (V_class + 1)).

Cases. Null or empty text: the end token alone. Null doc_id: teaches, not held out. Repeated rows: each counts. No
teaching document: all counts are 0 and the network is untrained. Empty table: empty result.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buckets, materialize, table
from .gru import Gru
from .shingles import pieces

END = b"\n"  # no word holds white space
MOST_WORDS, LEAST_RARE, MOST_RARE = 2048, 16, 64  # rare: powers of two
RUN = 64  # frequent words to a row
CHUNK, START_DOCS, START_TOKENS, RATE = 24_000_000, 300, 300_000, 0.01
#: Documents read side by side in the start, and in a chunk: a wide window costs numpy little more than a narrow one.
START_LANES, LANES = 32, 512
BUCKET_BYTES = 16_000_000
FOLDS, HELD = 5, 1


def rare_class(word: bytes, rare: int = MOST_RARE) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % rare


def rare_classes(vocabulary: int) -> int:
    """Number of rare classes: doubles until no class would have over 64 words beyond the frequent ones."""
    rare = LEAST_RARE
    while rare < MOST_RARE and vocabulary - MOST_WORDS > 64 * rare:
        rare *= 2
    return rare


class Places(dict):
    """word -> its number by first use; a known word's lookup runs no Python code."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _join(words: list[bytes]) -> bytes:
    """Words, END included, as one string."""
    return b" ".join(b"\0end" if w == END else b"." + w for w in words)


def _split(data: bytes) -> list[bytes]:
    return [END if w == b"\0end" else w[1:] for w in data.split(b" ")] if data else []


def _put(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(struct.pack(f"<{len(parts)}q", *map(len, parts)) + b"".join(parts))


def _get(data: bytes, n: int) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * n, []
    for size in struct.unpack(f"<{n}q", raw[: 8 * n]):
        out.append(raw[at : at + size])
        at += size
    return out


ROWS = "kind string, chunk long, bucket int, payload binary"


def _batch(kind, chunk, bucket, payload):
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())], ["kind", "chunk", "bucket", "payload"])


def _chunks(buckets: int):
    """(doc_id, teaches, text) -> a row `docs` for each chunk, and a row `words` for each of its buckets."""

    def run(batches):
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            column = batch.column(2).cast(pa.binary())
            for lo, hi in pieces(column, CHUNK):
                yield from chunk(number, batch.slice(lo, hi - lo), column.slice(lo, hi - lo))
                number += 1

    def chunk(number, batch, texts):
        place = Places({END: 0})
        teaches = np.array(batch.column(1).to_pylist(), bool)
        ids, sizes = [], []
        for t in texts:
            words = (t.as_py() or b"").lower().split()
            ids.append(np.fromiter(map(place.__getitem__, words), np.int32, len(words)))
            ids.append(np.zeros(1, np.int32))
            sizes.append(len(words) + 1)
        ids, sizes = np.concatenate(ids), np.array(sizes, np.int32)
        counts = np.bincount(ids[np.repeat(teaches, sizes)], minlength=len(place)).astype(np.int64)
        words = list(place)
        docs = batch.column(0).to_pylist()
        yield _batch(["docs"], [number], [0], [_put(np.array([d if d is not None else 0 for d in docs], np.int64).tobytes(), np.array([d is None for d in docs], bool).tobytes(), teaches.tobytes(), sizes.tobytes(), ids.tobytes(), _join(words))])
        dealt = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(dealt, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1):
            yield _batch(["words"], [number], [int(dealt[part[0]])], [_put(part.astype(np.int32).tobytes(), counts[part].tobytes(), _join([words[i] for i in part.tolist()]))])

    return run


COUNTED = "kind string, chunk long, word binary, n long, v long, payload binary"


def _count(rows: pa.Table) -> pa.Table:
    """The words of one bucket -> `reply` rows (counts for each chunk), runs of `top` words, and totals by rare class."""
    total: dict[bytes, int] = {}
    parts = []
    for chunk, payload in zip(rows["chunk"].to_pylist(), rows["payload"], strict=True):
        at, counts, words = _get(payload.as_py(), 3)
        words = _split(words)
        for w, c in zip(words, np.frombuffer(counts, np.int64).tolist(), strict=True):
            total[w] = total.get(w, 0) + c
        parts.append((chunk, at, words))
    out = [("reply", chunk, None, 0, 0, _put(at, np.fromiter((total[w] for w in words), np.int64, len(words)).tobytes())) for chunk, at, words in parts]
    known = [(c, w) for w, c in total.items() if c and w != END]
    known.sort(key=lambda x: (-x[0], x[1]))
    for at in range(0, min(len(known), MOST_WORDS), RUN):
        run = known[at : min(at + RUN, MOST_WORDS)]
        out.append(("top", 0, run[0][1], run[0][0], len(run), _put(np.array([c for c, _ in run], np.int64).tobytes(), _join([w for _, w in run]))))
    n, v = np.zeros(MOST_RARE + 1, np.int64), np.zeros(MOST_RARE + 1, np.int64)
    for c, w in known:
        r = rare_class(w)
        n[r] += c
        v[r] += 1
    n[MOST_RARE] = total.get(END, 0)
    out.append(("class", 0, None, 0, 0, _put(n.tobytes(), v.tobytes())))
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({k: pa.array([x[i] for x in out], t) for i, (k, t) in enumerate(zip(("kind", "chunk", "word", "n", "v", "payload"), kinds, strict=True))})


class Lexicon:
    """Frequent words (END first), and for each rare class N and V without them; N and V of all."""

    def __init__(self, top: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]]):
        self.place = {END: 0} | {w: i + 1 for i, (w, _) in enumerate(top)}
        ends = classes.get(MOST_RARE, (0, 0))[0]
        self.counts = np.array([ends, *(c for _, c in top)], float)
        self.n = sum(n for n, _ in classes.values())
        self.v = sum(v for _, v in classes.values()) + (ends > 0)
        self.rare = rare_classes(self.v)
        self.rare_n, self.rare_v = (np.array([classes.get(r, (0, 0))[k] for r in range(MOST_RARE)], float).reshape(-1, self.rare).sum(axis=0) for k in range(2))
        for w, c in top:
            self.rare_n[rare_class(w, self.rare)] -= c
            self.rare_v[rare_class(w, self.rare)] -= 1

    def inputs(self, words: list[bytes]) -> np.ndarray:
        size = len(self.place)
        return np.fromiter((self.place[w] if w in self.place else size + rare_class(w, self.rare) for w in words), np.int64, len(words))


def _open(payload: bytes):
    docs, null, teaches, sizes, ids, words = _get(payload, 6)
    sizes = np.frombuffer(sizes, np.int32).astype(np.int64)
    return np.frombuffer(docs, np.int64), np.frombuffer(null, bool), np.frombuffer(teaches, bool), sizes, np.frombuffer(ids, np.int32), _split(words)


def _lessons(payload: bytes, lexicon: Lexicon) -> list[np.ndarray]:
    """The teaching documents of a chunk."""
    _, _, teaches, sizes, ids, words = _open(payload)
    inputs, starts = lexicon.inputs(words), np.cumsum(sizes) - sizes
    return [inputs[ids[starts[i] : starts[i] + sizes[i]]] for i in np.flatnonzero(teaches).tolist()]


def _average(rows: pa.Table) -> pa.Table:
    """Weights averaged by tokens learnt from."""
    n = np.array(rows["n"].to_pylist(), float)
    mean = sum(np.frombuffer(p.as_py(), np.float32).astype(float) * w for p, w in zip(rows["payload"], n / max(1.0, n.sum()), strict=True))
    return pa.table({"grp": pa.array([0], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "payload": pa.array([np.asarray(mean, np.float32).tobytes()], pa.binary())})


def learn(docs: DataFrame, chunks: DataFrame, lexicon: Lexicon) -> Gru:
    """The network: a start on a bounded sample, then one round of training in every chunk on all it has, averaged."""
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    teaching = docs.where(F.col("teaches") & F.col("text").isNotNull()).withColumn("hash", F.xxhash64("text"))
    first = teaching.select(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"), F.col("hash").alias("t")).orderBy("h", "d", "t").limit(START_DOCS).distinct()
    texts = teaching.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("t"))).dropDuplicates(["doc_id", "hash"])
    texts = texts.select(F.encode("text", "UTF-8").alias("t")).limit(START_DOCS).collect()
    lessons = [lexicon.inputs([*bytes(r.t).lower().split(), END]) for r in sorted(texts, key=lambda r: bytes(r.t or b"")) if r.t is not None]
    model = Gru(len(lexicon.place), lexicon.rare).prior(np.concatenate([lexicon.counts, lexicon.rare_n]))
    for k in range(max(2, START_TOKENS // sum(map(len, lessons))) if lessons else 0):
        model.train(lessons, START_LANES, RATE, seed=k)
    sent = context.broadcast((model.pack(), lexicon, len(lexicon.place)))

    def run(batches):
        flat, words, size = sent.value
        for batch in batches:
            for chunk, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lessons = _lessons(payload.as_py(), words)
                local = Gru(size, words.rare).load(np.frombuffer(flat, np.float32))
                local.train(lessons, LANES, RATE / 2, seed=chunk % 1000)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sum(map(len, lessons))], pa.int64()), pa.array([local.pack()], pa.binary())], ["chunk", "n", "payload"])

    trained = chunks.select("chunk", "payload").mapInArrow(run, "chunk long, n long, payload binary")
    groups = max(1, int(chunks.count() ** 0.5))
    trained = trained.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int")).groupBy("grp").applyInArrow(_average, "grp int, n long, payload binary")
    final = trained.withColumn("grp", F.lit(0)).groupBy("grp").applyInArrow(_average, "grp int, n long, payload binary").first()
    return model.load(np.frombuffer(bytes(final.payload), np.float32)) if final and final.n else model


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    number = buckets(docs, BUCKET_BYTES, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS, F.lit(HELD + 1))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (rest != HELD).alias("teaches"), F.col("text").cast("string").alias("text"))
    packed = materialize(docs.mapInArrow(_chunks(number), ROWS), "chunks", "kind")
    chunks = packed.where("kind = 'docs'")
    counted = materialize(packed.where("kind = 'words'").groupBy("bucket").applyInArrow(_count, COUNTED), "counts", "kind")
    top = counted.where("kind = 'top'").orderBy(F.desc("n"), "word").limit(MOST_WORDS).collect()
    found = [_get(bytes(r.payload), 2) for r in top]  # a word of the first MOST_WORDS is in a run whose first word is
    known = sorted((-c, w) for counts, words in found for c, w in zip(np.frombuffer(counts, np.int64).tolist(), _split(words), strict=True))
    classes = [np.array([np.frombuffer(x, np.int64) for x in _get(bytes(r.payload), 2)]) for r in counted.where("kind = 'class'").toLocalIterator()]
    totals = sum(classes, np.zeros((2, MOST_RARE + 1), np.int64))
    lexicon = Lexicon([(w, -c) for c, w in known[:MOST_WORDS]], {r: (int(n), int(v)) for r, (n, v) in enumerate(totals.T)})
    model = learn(docs, chunks, lexicon)
    sent = spark.sparkContext.broadcast((model.pack(), lexicon, len(lexicon.place)))

    def run(batches):
        flat, lex, size = sent.value
        net = Gru(size, lex.rare).load(np.frombuffer(flat, np.float32))
        for batch in batches:
            for payload, replies in zip(batch.column(0), batch.column(1), strict=True):
                ids_, null, teaches, sizes, ids, words = _open(payload.as_py())
                count = np.zeros(len(words))
                for reply in replies.as_py():
                    at, c = _get(reply, 2)
                    count[np.frombuffer(at, np.int32)] = np.frombuffer(c, np.int64)
                inputs, starts = lex.inputs(words), np.cumsum(sizes) - sizes
                owner = np.repeat(np.arange(len(sizes)), sizes)
                per = lambda x: np.bincount(owner, x[ids], len(sizes))
                base = per(np.log10((count + 0.5) / (lex.n + 0.5 * (lex.v + 1))))
                rare = inputs - size
                cls = np.maximum(rare, 0)
                within = np.where(rare >= 0, np.log10(count + 0.5) - np.log10(lex.rare_n[cls] + 0.5 * (lex.rare_v[cls] + 1)), 0.0)
                full = net.score(inputs[ids], starts, sizes) / np.log(10) + per(within)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids_, pa.int64(), mask=null), pa.array(~teaches), pa.array(sizes, pa.int64()), pa.array(per((count > 0).astype(float)).astype(np.int64)), pa.array(np.full(len(sizes), lex.n), pa.int64()), pa.array(base), pa.array(full.astype(float))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    replies = counted.where("kind = 'reply'").groupBy("chunk").agg(F.collect_list("payload").alias("replies"))
    both = chunks.select("chunk", "payload").join(replies, "chunk").select("payload", "replies")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": query}
ORACLES: dict[str, str] = {}
