r"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

Base patterns (leftmost, non-overlapping per kind; failing matches dropped): email, ip (four numbers of at most 255),
card (13 to 19 digits passing Luhn), phone (a plus sign, 9 to 15 digits). All run in linear time.

The field labels segments of tokens (letters, digits, single other characters, white space within a line) with one of
the four kinds or none. A segment's score is the sum of weights of features of the whole span (digit counts and groups,
separators, Luhn, at-signs spelled out, what stands around it) and of the step from the previous label. An entity has at
most MAX_TOKENS tokens and MAX_GROUPS groups of digits, so dynamic programming over end position, length and label finds the best segmentation jointly
in time linear in the tokens. Runs of text without a digit, an at-sign or a spelled-out one hold no candidate segment;
they are all `none`, which splits a text exactly into independent regions. Weights are fitted by gradient ascent on the
conditional likelihood (forward-backward over segmentations) of generated, labelled sentences with a fixed seed.

Found segments are added if they overlap no base span; base spans stay as they are.

Cases. Null or empty text: no spans. Null doc_id and repeated rows: each row alone. Empty table: empty result. Offsets
are code points, end exclusive. Everything is per row: no shuffle, no group, memory bounded by one text.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .shingles import pieces

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
MAX_TOKENS, MAX_GROUPS = 24, 6
EPOCHS, STEP, DECAY, SENTENCES, SEED = 20, 0.5, 1e-3, 300, 7

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, t.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(t, start - 1):
            start -= 1
        m = _DOMAIN.match(t, at + 1) if start < at else None
        if m:
            out["email"].append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at)  # what precedes this sign belongs to no later match
        at = t.find("@", max(end, at + 1))
    for m in _IP.finditer(t):
        if m[1] and all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(t):
        if 13 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in _PHONE.finditer(t):
        if 9 <= len(_only_digits(m[0])) <= 15:
            out["phone"].append(m.span())
    return out


# The field -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\S\n]+|.", re.S)
_TRIGGER = re.compile(r"[0-9@]|(?i:[\[({] ?at ?[\])}])|(?i: at (?=[a-z0-9-]+ dot ))")
_AT = re.compile(r"@|(?i:[\[({] ?at ?[\])}]| at )")
_DOT = re.compile(r"\.|(?i:[\[({] ?dot ?[\])}]| dot )")
_MAIL = re.compile(r"(?i)[a-z0-9_%+-]+(?:(?:\.|[\[({ ]+dot[\])} ]+)[a-z0-9_%+-]+)* ?(?:@|[\[({ ]+at[\])} ]+) ?[a-z0-9-]+(?:(?:\.|[\[({ ]+dot[\])} ]+)[a-z0-9-]+)+")
_HINTS = (("phone", re.compile(r"(?i)(tel|phone|call|fax|mobile|cell|ring)\W*(us|me|at|on)?\W*$")), ("card", re.compile(r"(?i)(card|visa|mastercard|amex|credit|debit)\W*(no|number)?\W*$")), ("ip", re.compile(r"(?i)(ip|host|server|address)\W*$")), ("email", re.compile(r"(?i)(mail|e-mail|contact|write)\W*(to|at|us|me)?\W*$")))


def features(text: str, a: int, b: int) -> list[str]:
    """Whole-span features of text[a:b]."""
    s = text[a:b]
    digits = _only_digits(s)
    n = len(digits)
    groups = re.findall(r"[0-9]+", s)
    rest = re.sub(r"[0-9]", "", s)
    marks = "".join(sorted(set(rest)))
    before, after = text[a - 1 : a], text[b : b + 1]
    out = ["bias", f"groups={min(len(groups), 6)}", "n=" + (str(n) if n in (7, 8) else "0" if not n else "<7" if n < 7 else "9-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+")]
    out.append("marks=" + (marks if len(marks) <= 4 and not re.search(r"[^\W_]", marks) else "letters" if re.search(r"[^\W\d_]", rest) else "many"))
    if _MAIL.fullmatch(s):
        out.append("mail")
    elif _AT.search(s):
        out.append("at")
    if n and re.search(r"[^\W\d_]", rest):
        out.append("mixed")
    if 13 <= n <= 19 and luhn(digits) and len(set(digits)) > 1:
        out.append("luhn")
    if 13 <= n <= 19 and re.fullmatch(r"[0-9]{4}(?:[ ._-]{1,3}[0-9]{4}){2}[ ._-]{1,3}[0-9]{1,7}", s):
        out.append("fours")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("octets" + ("." if re.fullmatch(r"[0-9]+(?: ?\. ?[0-9]+){3}", s) else "?"))
    if re.fullmatch(r"(?:\+|00)?[ ]?[0-9]{1,3}?[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{1,4})?", s) and len(groups) >= 3:
        out.append("dialled")
    if re.fullmatch(r"(19|20)[0-9]{2}[-/. ][0-9]{1,2}[-/. ][0-9]{1,2}.*", s):
        out.append("date")
    if s[:1].isspace() or s[-1:].isspace() or s[-1:] in ".,-(" or s[:1] in ".,-)":
        out.append("ragged")
    out.append("left=" + ("word" if before.isalnum() or before in "_" and before else "mark" if before in tuple(".-+@/=\"#:$") else "open"))
    out.append("right=" + ("word" if after.isalnum() else "mark" if after in tuple("-@/=\"%:") else "open"))
    if before in tuple(".-") and before and text[a - 2 : a - 1].isdigit():
        out.append("left cut")
    if after in tuple(".-") and after and text[b + 1 : b + 2].isalnum():
        out.append("right cut")
    lead = text[max(0, a - 24) : a]
    out += [f"hint={k}" for k, p in _HINTS if p.search(lead)]
    return out


def regions(t: str) -> list[tuple[int, int]]:
    """Parts of lines within MAX_TOKENS tokens of a trigger; elsewhere no candidate segment exists."""
    out: list[tuple[int, int]] = []
    starts, stop = [], -1
    for m in _TRIGGER.finditer(t):
        if m.start() >= stop:
            stop = t.find("\n", m.end())
            stop = len(t) if stop < 0 else stop
            starts = [x.start() for x in _TOKEN.finditer(t, t.rfind("\n", 0, m.start()) + 1, stop)]
        first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
        a = starts[max(0, first - MAX_TOKENS)]
        b = starts[last + MAX_TOKENS + 1] if last + MAX_TOKENS + 1 < len(starts) else stop
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidates(t: str, a: int, b: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token bounds of a region, and the segments (first token, token after the last) that may be an entity."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(t, a, b)]
    cuts = [x[0] for x in tokens] + [b]
    digits = np.concatenate(([0], np.cumsum([e - s if "0" <= t[s] <= "9" else 0 for s, e in tokens])))
    groups = np.concatenate(([0], np.cumsum(["0" <= t[s] <= "9" for s, _ in tokens])))
    spelled = sorted({next((i for i, (s, e) in enumerate(tokens) if s <= m.start() < e), 0) for m in _AT.finditer(t, a, b)})
    out = []
    for i, (s, e) in enumerate(tokens):
        c = t[s]
        if not (c.isalnum() or c in "+("):
            continue
        near = [x for x in spelled if i < x < i + MAX_TOKENS]
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            if digits[j] - digits[i] > 19 or groups[j] - groups[i] > MAX_GROUPS:
                break
            last = t[tokens[j - 1][0]]
            if last.isalnum() and (7 <= digits[j] - digits[i] or 4 <= digits[j] - digits[i] and t.count(".", s, cuts[j]) == 3 or near and near[0] < j - 1 and _MAIL.fullmatch(t, s, tokens[j - 1][1])):
                out.append((i, j))
    return cuts, out


class Field:
    """Weights by (feature, label) and by (label, next label)."""

    def __init__(self):
        self.weight: dict[str, np.ndarray] = {}
        self.step = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        zero = np.zeros(len(KINDS))
        return np.array([sum((self.weight.get(f, zero) for f in fs), zero) for fs in feats]).reshape(-1, len(KINDS))

    def decode(self, n: int, segments: list[tuple[int, int]], scores: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation of n tokens: (first, after, label) of its entities."""
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (_, j) in enumerate(segments):
            ends[j].append(k)
        best = np.full((n + 1, len(LABELS)), -np.inf)
        best[0, 0] = 0.0
        back: dict = {}
        for j in range(1, n + 1):
            x = best[j - 1] + self.step[:, 0]
            best[j, 0], back[j, 0] = x.max(), (j - 1, int(x.argmax()))
            for k in ends[j]:
                i = segments[k][0]
                x = best[i][:, None] + self.step[:, 1:]
                top = x.max(axis=0) + scores[k]
                for y in np.flatnonzero(top > best[j, 1:]):
                    best[j, y + 1], back[j, int(y) + 1] = top[y], (i, int(x[:, y].argmax()))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def marginals(self, n: int, segments, scores):
        """Forward-backward: P(segment k has kind y), and expected counts of label steps."""
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j) in enumerate(segments):
            starts[i].append(k)
            ends[j].append(k)
        lse = np.logaddexp.reduce
        f = np.full((n + 1, len(LABELS)), -np.inf)
        f[0, 0] = 0.0
        for j in range(1, n + 1):
            f[j, 0] = lse(f[j - 1] + self.step[:, 0])
            for k in ends[j]:
                f[j, 1:] = np.logaddexp(f[j, 1:], lse(f[segments[k][0]][:, None] + self.step[:, 1:], axis=0) + scores[k])
        b = np.full((n + 1, len(LABELS)), -np.inf)
        b[n] = 0.0
        steps = np.zeros_like(self.step)
        z = lse(f[n])
        p = np.zeros((len(segments), len(KINDS)))
        for i in range(n - 1, -1, -1):
            b[i] = self.step[:, 0] + b[i + 1, 0]
            for k in starts[i]:
                b[i] = np.logaddexp(b[i], lse(self.step[:, 1:] + (scores[k] + b[segments[k][1], 1:])[None, :], axis=1))
            steps[:, 0] += np.exp(f[i] + self.step[:, 0] + b[i + 1, 0] - z)
            for k in starts[i]:
                x = np.exp(f[i][:, None] + self.step[:, 1:] + (scores[k] + b[segments[k][1], 1:])[None, :] - z)
                steps[:, 1:] += x
                p[k] = x.sum(axis=0)
        return p, steps

    def find(self, t: str) -> list[tuple[str, int, int]]:
        out = []
        for a, b in regions(t):
            cuts, segments = candidates(t, a, b)
            if segments:
                scores = self.scores([features(t, cuts[i], cuts[j]) for i, j in segments])
                out += [(LABELS[y], cuts[i], cuts[j]) for i, j, y in self.decode(len(cuts) - 1, segments, scores)]
        return out


def _sentence(rnd: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence with its entities."""
    d = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    w = lambda: "".join(rnd.choice("aeioulnrstdmpk") for _ in range(rnd.randrange(2, 9)))

    def card():
        x = rnd.choice("3456") + d(rnd.choice([14, 14, 14, 13]))
        x += next(c for c in "0123456789" if luhn(x + c))
        return rnd.choice([x, "-".join(x[i : i + 4] for i in range(0, len(x), 4)), " ".join(x[i : i + 4] for i in range(0, len(x), 4)), ".".join(x[i : i + 4] for i in range(0, len(x), 4)), " - ".join(x[i : i + 4] for i in range(0, len(x), 4))])

    def phone():
        a, b, c = rnd.choice("23456789") + d(2), d(3), d(4)
        return rnd.choice([f"+{d(1)} ({a}) {b}-{c}", f"+{rnd.randrange(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rnd.randrange(10, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"+{rnd.randrange(10, 99)}{a}{b}{c}"])

    def email():
        u, h, x = w() + rnd.choice(["", d(2), "." + w()]), w() + rnd.choice(["", d(1)]), rnd.choice(["com", "org", "de", "co.uk", "example.com"])
        return rnd.choice([f"{u}@{h}.{x}", f"{u}@{h}.{x}", f"{u} @ {h}.{x}", f"{u} (at) {h}.{x}", f"{u}[at]{h}[dot]{x.split('.')[0]}", f"{u} at {h} dot {x.split('.')[0]}", f"{u} [at] {h}.{x}"])

    def ip():
        x = [str(rnd.randrange(256)) for _ in range(4)]
        return rnd.choice([".", ".", " . "]).join(x)

    def other():
        return rnd.choice([f"20{d(2)}-{rnd.randrange(10, 13)}-{rnd.randrange(10, 29)}", f"{d(1)}.{d(1)}.{d(1)}", f"$ {d(3)},{d(3)}.{d(2)}", d(rnd.randrange(1, 7)), d(rnd.randrange(7, 13)), f'"{d(9)}{w()}{d(9)}"', f"#{d(8)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}/{d(2)}", f"19{d(2)}-20{d(2)}", f"{w()}={w()}{d(9)}{w()}", f"{d(3)}.{d(5)}.{d(2)}.{d(9)}", f"@{w()}", f"{w()} at {w()}", f"{d(3)} {d(2)} {d(3)} {d(3)}", f"AK{d(9)}Z{d(2)}", f"{d(1)}.{d(8)}", f"{d(20)}", f"{d(4)} {d(4)}", f"12{d(14)}"])

    makers = {"card": card, "phone": phone, "email": email, "ip": ip}
    hints = {"card": ["card", "visa number"], "phone": ["call", "tel:", "phone"], "email": ["mail", "write to"], "ip": ["host", "ip"]}
    text, spans = " ".join(w() for _ in range(rnd.randrange(1, 5))), []
    for _ in range(rnd.choice([1, 1, 2])):
        kind = rnd.choice([*KINDS, None, None, None])
        if kind and rnd.random() < 0.5:
            text += " " + rnd.choice(hints[kind])
        text += " "
        s = makers[kind]() if kind else other()
        if kind:
            spans.append((kind, len(text), len(text) + len(s)))
        text += s + rnd.choice(["", "", ",", "."]) + " " + " ".join(w() for _ in range(rnd.randrange(1, 5)))
    return text, spans


def fit(sentences: int = SENTENCES, epochs: int = EPOCHS) -> Field:
    """Weights that maximise the conditional likelihood of generated sentences (AdaGrad, fixed seed)."""
    rnd, field, cases = random.Random(SEED), Field(), []
    names: dict[str, int] = {}
    for _ in range(sentences):
        t, spans = _sentence(rnd)
        for a, b in regions(t):
            cuts, segments = candidates(t, a, b)
            feats = [[names.setdefault(f, len(names)) for f in features(t, cuts[i], cuts[j])] for i, j in segments]
            place = {(cuts[i], cuts[j]): k for k, (i, j) in enumerate(segments)}
            truth = [(place[s, e], LABELS.index(k)) for k, s, e in spans if (s, e) in place]
            cases.append((len(cuts) - 1, segments, feats, sorted(truth, key=lambda x: segments[x[0]])))
    w = np.zeros((len(names), len(KINDS)))
    seen_w, seen_s = np.full_like(w, 1e-6), np.full_like(field.step, 1e-6)
    for _ in range(epochs):
        gw, gs = -DECAY * w * len(cases), -DECAY * field.step * len(cases)
        for n, segments, feats, truth in cases:
            p, steps = field.marginals(n, segments, np.array([w[f].sum(axis=0) for f in feats]).reshape(-1, len(KINDS)))
            for k, y in truth:
                p[k, y - 1] -= 1
            for k in np.flatnonzero(np.abs(p).sum(axis=1) > 1e-9):
                gw[feats[k]] -= p[k]
            gs -= steps
            at, before = 0, 0
            for k, y in [*truth, (None, 0)]:
                i, j = segments[k] if k is not None else (n, n)
                gs[before, 0] += i > at
                gs[0, 0] += max(0, i - at - 1)
                if k is not None:
                    gs[0 if i > at else before, y] += 1
                    at, before = j, y
        seen_w += gw**2
        seen_s += gs**2
        w += STEP * gw / np.sqrt(seen_w)
        field.step += STEP * gs / np.sqrt(seen_s)
    field.weight = {f: w[i] for f, i in names.items()}
    return field


def all_spans(t: str, field: Field) -> tuple[dict, list[tuple[str, int, int]]]:
    base = base_spans(t)
    held = sorted(x for v in base.values() for x in v)
    added = [(k, s, e) for k, s, e in field.find(t) if not any(a < e and s < b for a, b in held)] if len(held) < 50 else _clear(field.find(t), held)
    return base, [(k, s, e) for k in KINDS for s, e in sorted(base[k] + [(a, b) for y, a, b in added if y == k])]


def _clear(found, held):
    mark, out = np.zeros(max(e for _, e in held) + 2, np.int32), []
    for s, e in held:
        mark[s] += 1
        mark[e] -= 1
    taken = np.concatenate(([0], np.cumsum(np.cumsum(mark) > 0)))
    for k, s, e in found:
        lo, hi = min(s, len(taken) - 1), min(e, len(taken) - 1)
        if taken[hi] == taken[lo]:
            out.append((k, s, e))
    return out


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    sent = docs.sparkSession.sparkContext.broadcast(fit())
    fields = [("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]

    def run(batches):
        field = sent.value
        for batch in batches:
            for lo, hi in pieces(batch.column(1).cast(pa.binary())):
                part, out = batch.slice(lo, hi - lo), []
                for t in part.column(1):
                    base, every = all_spans(t.as_py() or "", field)
                    plain = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
                    n = [len(base[k]) for k in KINDS]
                    out.append((*n, hashlib.sha256(plain.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in every), len(every) - sum(n)))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([x[i] for x in out], f) for i, (_, f) in enumerate(fields)]], ["doc_id", *[n for n, _ in fields]])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pii": query}
ORACLES: dict[str, str] = {}
