"""A gated recurrent language model in numpy with a class-factored output layer.

Input ids are frequent words, rare classes and a start mark; a frequent word is predicted as class, then word within the
class; a rare word as its class, then by its smoothed share of the class's occurrences (given by the caller).
"""

from __future__ import annotations

import numpy as np

HIDDEN, IN_CLASS, WINDOW, BLOCK = 16, 64, 32, 2048
F32 = np.float32


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Gru:
    """words: number of frequent words, multiples of IN_CLASS to a class; rare: number of rare classes.

    Ids: 0..words-1 frequent, words..words+rare-1 rare classes, words+rare the start mark.
    """

    NAMES = ("wx", "uh", "bh", "wc", "bc", "ww", "bw")

    def __init__(self, words: int, rare: int, seed: int = 0):
        self.words, self.rare, h = words, rare, HIDDEN
        self.frequent = -(-words // IN_CLASS)
        rnd = np.random.default_rng(seed)
        put = lambda *shape: rnd.normal(0, 0.1, shape).astype(F32)
        self.wx, self.uh, self.bh = put(words + rare + 1, 3 * h), put(h, 3 * h), np.zeros(3 * h, F32)  # gates z, r, candidate
        self.wc, self.bc = put(h, self.frequent + rare), np.zeros(self.frequent + rare, F32)
        self.ww, self.bw = put(self.frequent, h, IN_CLASS), np.zeros((self.frequent, IN_CLASS), F32)
        spare = self.frequent * IN_CLASS - words
        if spare:
            self.bw[-1, IN_CLASS - spare :] = -30  # places without a word

    def prior(self, counts: np.ndarray) -> "Gru":
        """Output biases that give each id its share of `counts` (a half added), whatever the state."""
        n = np.log(np.asarray(counts, float) + 0.5)
        self.bw.ravel()[: self.words] = n[: self.words]
        self.bc[: self.frequent] = np.log(np.exp(self.bw.astype(float)).sum(axis=1))
        self.bc[self.frequent :] = n[self.words :]
        shift = self.bc[: self.frequent, None]
        self.bw = (self.bw - shift).astype(F32)  # logarithms of shares: small numbers train better
        self.bc = (self.bc - self.bc.max()).astype(F32)
        return self

    def pack(self) -> bytes:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES]).astype(F32).tobytes()

    def load(self, flat: np.ndarray) -> "Gru":
        at = 0
        for n in self.NAMES:
            x = getattr(self, n)
            setattr(self, n, flat[at : at + x.size].reshape(x.shape).astype(F32).copy())
            at += x.size
        return self

    def step(self, x, h, keep=None):
        """x: input rows of wx (lanes, 3 HIDDEN); h: (lanes, HIDDEN) -> new state."""
        n = HIDDEN
        u = h @ self.uh
        g = sigmoid(x[:, : 2 * n] + u[:, : 2 * n])
        z, r = g[:, :n], g[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * u[:, 2 * n :])
        new = h + z * (c - h)
        if keep is not None:
            keep.append((h, z, r, c, u[:, 2 * n :]))
        return new

    def class_of(self, ids):
        return np.where(ids < self.words, ids // IN_CLASS, self.frequent + ids - self.words)

    def log_probs(self, states, ids):
        """Natural log P(id | state) of frequent words, or of the rare class."""
        cls = self.class_of(ids)
        out = np.empty(len(ids), np.result_type(states, self.wc))
        for at in range(0, len(ids), BLOCK):  # a block's arrays stay in the processor's cache
            a = states[at : at + BLOCK] @ self.wc
            a += self.bc
            a -= a.max(axis=1, keepdims=True)
            out[at : at + BLOCK] = a[np.arange(len(a)), cls[at : at + BLOCK]]
            np.exp(a, out=a)
            out[at : at + BLOCK] -= np.log(a.sum(axis=1))
        order = np.argsort(cls, kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.frequent + 1))
        for c in range(self.frequent):
            for lo in range(cuts[c], cuts[c + 1], BLOCK):
                at = order[lo : min(lo + BLOCK, cuts[c + 1])]
                b = states[at] @ self.ww[c]
                b += self.bw[c]
                b -= b.max(axis=1, keepdims=True)
                got = b[np.arange(len(at)), ids[at] - c * IN_CLASS]
                np.exp(b, out=b)
                out[at] += got - np.log(b.sum(axis=1))
        return out

    def score(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, lanes: int = 4096) -> np.ndarray:
        """Sum of log_probs of each document ids[start : start + size], its state carried from window to window."""
        total = np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        table = self.wx + self.bh
        for lo in range(0, len(order), lanes):
            docs = order[lo : lo + lanes]
            at, size = starts[docs], sizes[docs]
            h, last = np.zeros((len(docs), HIDDEN), F32), np.full(len(docs), self.words + self.rare)
            t, most = 0, int(size[0]) if len(size) else 0
            while t < most:
                window = min(most, t + max(WINDOW, 200_000 // max(1, int((size > t).sum()))))
                states, wanted, owner = [], [], []
                while t < window:
                    live = int(np.searchsorted(-size, -t, "left"))  # sizes fall, so the living lanes come first
                    h = self.step(table[last[:live]], h[:live])
                    last = ids[at[:live] + t]
                    states.append(h)
                    wanted.append(last)
                    owner.append(docs[:live])
                    t += 1
                total += np.bincount(np.concatenate(owner), self.log_probs(np.concatenate(states), np.concatenate(wanted)), len(sizes))
        return total

    def train(self, docs: list[np.ndarray], lanes: int, rate: float, seed: int) -> "Gru":
        """One pass of truncated back-propagation (Adam): lanes read documents end to end, WINDOW tokens at a time."""
        rnd = np.random.default_rng(seed)
        stream = np.concatenate([np.concatenate(([self.words + self.rare], docs[i])) for i in rnd.permutation(len(docs))]) if docs else np.empty(0, np.int64)
        lanes = max(1, min(lanes, len(stream) // (2 * WINDOW)))
        width = len(stream) // lanes
        stream = stream[: lanes * width].reshape(lanes, width)
        h = np.zeros((lanes, HIDDEN), F32)
        m = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        v = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        start, k = self.words + self.rare, 0
        for t in range(0, width - 1, WINDOW):
            x, y = stream[:, t : min(t + WINDOW, width - 1)], stream[:, t + 1 : min(t + WINDOW, width - 1) + 1]
            grads, h = self.gradient(x, y, h, start)
            k += 1
            for n in self.NAMES:
                m[n] += F32(0.1) * (grads[n] - m[n])
                v[n] += F32(0.001) * (grads[n] ** 2 - v[n])
                step = np.sqrt(v[n] * F32(1 / (1 - 0.999**k))) + F32(1e-8)
                setattr(self, n, getattr(self, n) - F32(rate / (1 - 0.9**k)) * m[n] / step)
        return self

    def gradient(self, x, y, h, start):
        """Gradients of the mean loss over one window, and the state it ends in; the state is reset at start marks."""
        n, kept, states = HIDDEN, [], []
        steps = x.shape[1]
        for t in range(steps):
            h = np.where((x[:, t] == start)[:, None], F32(0), h)
            h = self.step(self.wx[x[:, t]] + self.bh, h, kept)
            states.append(h)
        s, ids = np.stack(states).reshape(-1, n), y.T.ravel()
        real = ids != start
        count = max(1, int(real.sum()))
        g = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        cls = self.class_of(np.where(real, ids, 0))
        ds = np.empty_like(s)
        for at in range(0, len(ids), BLOCK):
            own = s[at : at + BLOCK]
            p = own @ self.wc
            p += self.bc
            p -= p.max(axis=1, keepdims=True)
            np.exp(p, out=p)
            share = F32(1 / count) * real[at : at + BLOCK].astype(F32)
            p *= (share / p.sum(axis=1))[:, None]
            p[np.arange(len(p)), cls[at : at + BLOCK]] -= share
            g["wc"] += own.T @ p
            g["bc"] += p.sum(axis=0)
            ds[at : at + BLOCK] = p @ self.wc.T
        order = np.flatnonzero(real)[np.argsort(cls[real], kind="stable")]
        cuts = np.searchsorted(cls[order], np.arange(self.frequent + 1))
        for c in range(self.frequent):
            at = order[cuts[c] : cuts[c + 1]]
            if len(at):
                own = s[at]
                q = own @ self.ww[c]
                q += self.bw[c]
                q -= q.max(axis=1, keepdims=True)
                np.exp(q, out=q)
                q *= (F32(1 / count) / q.sum(axis=1))[:, None]
                q[np.arange(len(at)), ids[at] - c * IN_CLASS] -= F32(1 / count)
                g["ww"][c], g["bw"][c] = own.T @ q, q.sum(axis=0)
                ds[at] += q @ self.ww[c].T
        ds = ds.reshape(steps, -1, n)
        dh, moved = np.zeros_like(h), []
        for t in range(steps - 1, -1, -1):
            before, z, r, c, uc = kept[t]
            dh = dh + ds[t]
            dz, dc = dh * (c - before) * z * (1 - z), dh * z * (1 - c * c)
            dr = dc * uc * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            moved.append(dx)
            g["bh"] += dx.sum(axis=0)
            g["uh"] += before.T @ du
            dh = np.where((x[:, t] == start)[:, None], F32(0), dh * (1 - z) + du @ self.uh.T)
        rows, dx = x.T[::-1].ravel(), np.concatenate(moved)
        for k in range(dx.shape[1]):
            g["wx"][:, k] = np.bincount(rows, dx[:, k], len(self.wx))
        return g, h
