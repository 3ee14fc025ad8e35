"""Language identification with string kernels.

A text's lower-cased letters, all else being one space, give its set of character n-grams of 1 to 3 characters (the
blended spectrum, presence only, hashed to 2**HASH_BITS). The kernel of two texts is the size of the sets' intersection
over the geometric mean of their sizes. LANDMARKS texts span a Nystrom feature space, in which kernel ridge regression
is fitted one language against the rest. A batch of documents is scored by two matrix products: presence times
landmarks, then kernel values times coefficients.

Fitting sample (a documented bound): of documents whose crc32(doc_id) mod 5 is not 0, with a language and a letter, the
PER_LANGUAGE least by a hash of doc_id for each language. Only their n-gram sets reach the driver. Everything is scored.

Near. The score cannot tell a text in no learned language (the languages' scores sum to about 1), so `lang_near` says
whether enough of a text's n-grams occur in the sample. What is enough is calibrated for each language and size: NEAR
times the LOW quantile of the share that fragments of the sample's documents (1 to 64 words, and whole) have in common
with other documents, less 1 / sqrt(n-grams) for the chance of few. A language with nothing to compare with rejects
nothing; single words of an unlearned language in a learned script often pass.

Skew and scale. The sample's per-language limit is applied within tasks before the shuffle; scoring is one pass without
a shuffle; the model sent to tasks is bounded by LANDMARKS and HASH_BITS.

Cases. Null text, or no letter: `und`, score 0, not near. No labelled document: all `und`, none near. Null doc_id: held out, scored. Ties
between languages: the first by code point. Repeated rows: scored alike. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table
from .shingles import pieces

GRAMS, HASH_BITS = (1, 2, 3), 18
PER_LANGUAGE, LANDMARKS, RIDGE, FOLDS = 300, 64, 1e-3, 5
BATCH = 64
FRAGMENTS, NEAR, LOW = (1, 2, 4, 8, 16, 64), 0.8, 0.01
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint64)
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-cased code point, or a space if it is no letter; built once a process."""
    if not _LETTERS:
        out = np.full(0x110000, 32, np.uint64)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                out[cp] = ord(low[0])
        _LETTERS.append(out)
    return _LETTERS[0]


def gram_ids(text: str | None) -> np.ndarray:
    """Sorted distinct n-gram ids of a whole text; empty without a letter."""
    cps = _letters()[np.frombuffer((text or "").encode("utf-32-le"), np.uint32)]
    blank = cps == 32
    if blank.all():
        return np.empty(0, np.int64)
    cps, blank = np.pad(cps, 1, constant_values=32), np.pad(blank, 1, constant_values=True)
    cps = cps[~(blank & np.concatenate(([False], blank[:-1])))]
    seen = np.zeros(1 << HASH_BITS, bool)
    h = np.zeros(len(cps), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(cps) < n:
            break
        h = (h[: len(cps) - n + 1] * np.uint64(0x100000001B3) + cps[n - 1 :] + np.uint64(1)) & np.uint64(0xFFFFFFFFFFFF)
        if n in GRAMS:
            seen[((h * _MULT[n - 1]) >> np.uint64(16)) & np.uint64((1 << HASH_BITS) - 1)] = True
    return np.flatnonzero(seen)


class Model:
    """Landmark n-grams, their matrix and the coefficients of each language."""

    def __init__(self, sets: list[np.ndarray], langs: list[str]):
        self.langs = sorted(set(langs))
        each = max(1, LANDMARKS // max(1, len(self.langs)))
        chosen = [i for lang in self.langs for i in [k for k, x in enumerate(langs) if x == lang][:each]]
        grams = np.unique(np.concatenate([sets[i] for i in chosen]))
        self.column = np.full(1 << HASH_BITS, -1, np.int32)
        self.column[grams] = np.arange(len(grams))
        self.marks = np.zeros((len(grams), len(chosen)), np.float32)
        for j, i in enumerate(chosen):
            self.marks[self.column[sets[i]], j] = 1 / np.sqrt(len(sets[i]))
        k = self.kernel(sets).astype(float)
        values, vectors = np.linalg.eigh(k[chosen])
        keep = values > 1e-8 * values[-1]
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.hstack([k @ root, np.ones((len(sets), 1))])
        y = np.where(np.array(langs)[:, None] == np.array(self.langs)[None, :], 1.0, -1.0)
        fit = np.linalg.solve(phi.T @ phi + RIDGE * len(sets) * np.eye(phi.shape[1]), phi.T @ y)
        self.coef, self.bias = (root @ fit[:-1]).astype(np.float32), fit[-1].astype(np.float32)

    def calibrate(self, sets: list[np.ndarray], langs: list[str], parts: list[list[np.ndarray]]) -> "Model":
        """Learns which n-grams the sample has, and the share of them that each language's texts have by size."""
        seen = np.zeros(1 << HASH_BITS, np.int32)
        for s in sets:
            seen[s] += 1
        self.known, self.usual = seen > 0, {}
        for lang in self.langs:
            found: dict[int, list[float]] = {}
            for s, own, few in zip(sets, langs, parts, strict=True):
                for x in [s, *few] if own == lang else []:
                    found.setdefault(len(x).bit_length(), []).append((seen[x] > 1).mean())  # seen in another document
            sizes = sorted(found)
            self.usual[lang] = sizes, [float(np.quantile(found[k], LOW, method="lower")) for k in sizes]
        return self

    def near(self, sets: list[np.ndarray], langs: list[str]) -> list[bool]:
        """Whether a text (its language as predicted) has as many known n-grams as a text of its size should."""
        return [len(s) > 0 and bool(self.known[s].mean() >= NEAR * np.interp(len(s).bit_length(), *self.usual[lang]) - len(s) ** -0.5) for s, lang in zip(sets, langs, strict=True)]

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        out = []
        for at in range(0, len(sets), BATCH):
            part = sets[at : at + BATCH]
            p = np.zeros((len(part), len(self.marks)), np.float32)
            for i, s in enumerate(part):
                c = self.column[s]
                p[i, c[c >= 0]] = 1 / np.sqrt(max(1, len(s)))
            out.append(p @ self.marks)
        return np.concatenate(out) if out else np.zeros((0, self.marks.shape[1]), np.float32)

    def predict(self, sets: list[np.ndarray]) -> tuple[list[str], list[float]]:
        f = self.kernel(sets) @ self.coef + self.bias
        best = f.argmax(axis=1) if len(sets) else []
        score = np.clip((f.max(axis=1, initial=-1.0) + 1) / 2, 0, 1)
        return [self.langs[b] if len(s) else "und" for b, s in zip(best, sets, strict=True)], [float(x) if len(s) else 0.0 for x, s in zip(score, sets, strict=True)]


def _fragments(text: str) -> list[np.ndarray]:
    """N-gram ids of runs of words, two of each length in FRAGMENTS that the text is longer than."""
    words = text.split()
    runs = [words[at : at + n] for n in FRAGMENTS if n < len(words) for at in ((len(words) - n) // 3, (len(words) - n) * 2 // 3)]
    return [x for x in (gram_ids(" ".join(run)) for run in runs) if len(x)]


def _sets(batches):
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1)]
        grams = pa.array([gram_ids(t).astype(np.int32).tobytes() for t in texts], pa.binary())
        parts = pa.array([[x.astype(np.int32).tobytes() for x in _fragments(t)] for t in texts], pa.list_(pa.binary()))
        yield pa.RecordBatch.from_arrays([batch.column(0), grams, parts], ["lang", "grams", "parts"])


def fold(doc_id):
    """crc32(doc_id as text) mod FOLDS; 0 for a null."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS, F.lit(0))


def fit(docs: DataFrame) -> Model | None:
    """A model of the sample (see above), or None if there is nothing to learn from."""
    docs = docs.select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "h"))
    sample = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0) & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", "h").withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE)
    chosen = sample.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l"), F.col("h").alias("_h")).distinct()
    same = (F.col("doc_id") == F.col("_d")) & (F.col("lang") == F.col("_l")) & (F.col("h") == F.col("_h"))
    texts = docs.join(F.broadcast(chosen), same).dropDuplicates(["doc_id", "lang", "h"]).select("lang", "text")  # a repeated row counts once
    rows = sorted((r.lang, bytes(r.grams), [bytes(x) for x in r.parts]) for r in texts.mapInArrow(_sets, "lang string, grams binary, parts array<binary>").collect())
    ids = lambda x: np.frombuffer(x, np.int32).astype(np.int64)
    rows = [(lang, ids(x), [ids(y) for y in parts]) for lang, x, parts in rows if x]
    order = np.random.default_rng(0).permutation(len(rows))
    langs, sets, parts = ([rows[i][k] for i in order] for k in range(3))
    return Model(sets, langs).calibrate(sets, langs, parts) if rows else None


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, text, lang, ...) -> the columns `keep` (None: all) of docs, with lang_pred, lang_score and lang_near; columns of these
    names are replaced."""
    model = fit(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in keep or docs.columns if c.lower() not in ("lang_pred", "lang_score", "lang_near")]
    (scored,) = fresh(names, "_scored")

    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi in pieces(batch.column(0).cast(pa.binary())):
                part = batch.slice(lo, hi - lo)
                sets = [gram_ids(t.as_py()) for t in part.column(0)]
                lang, score = m.predict(sets) if m else (["und"] * len(sets), [0.0] * len(sets))
                near = m.near(sets, lang) if m else [False] * len(sets)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(near, pa.bool_())], [*names, "lang_pred", "lang_score", "lang_near"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema.fields)
    return docs.select(F.col("text").cast("string").alias(scored), *[f"`{c}`" for c in names]).mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_near boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


QUERIES = {"op6_language_id": query}
ORACLES: dict[str, str] = {}
