"""Hashed n-gram features and the linear models trained on them.

A text is a bag of hashed ids; ``bags`` gives the ids of every text of a slice
at once, and a score is the sum of one weight for each id (a sparse dot
product), so scoring is a gather and a running sum.  Training reads a bounded
sample of labelled rows that one task holds as arrays of ids.
"""

from __future__ import annotations

import numpy as np

from . import kernel as K

U64 = np.uint64


def bags(t: K.Texts, bits: int, word_ns: tuple[int, ...] = (1, 2), char_ns: tuple[int, ...] = (), prefix_ns: tuple[int, ...] = (), strip: bool = False) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family of n-grams: (ids, first), ids of text i at first[i]:first[i + 1].

    ``prefix_ns``: the first n bytes of each word of more bytes than that.
    ``strip``: words lose ASCII punctuation at their end.
    """
    low = K.lower_ascii(t.buf)
    t = K.Texts(low, t.off)
    w = K.words(t)
    out = []
    shift = U64(64 - bits)
    sums = K.prefix_sums(low) if word_ns or prefix_ns else None
    end = w.end
    if strip and len(end):
        for _ in range(2):
            last = low[end - 1]
            cut = (end - w.start > 1) & np.isin(last, np.frombuffer(b".,!?;:", np.uint8))
            end = end - cut
    if word_ns:
        h = K.span_hash(sums, w.start, end)
        for n in word_ns:
            if n == 1:
                out.append((K.mix(h + U64(1)) >> shift, w.first))
            elif n == 2:
                # a word twice in a row is one pattern, whatever the word
                at = np.flatnonzero(w.doc[1:] == w.doc[:-1])
                x = np.where(h[at] == h[at + 1], U64(2), h[at] * U64(0x9FB21C651E98DF25) + h[at + 1])
                out.append((K.mix(x) >> shift, np.searchsorted(w.doc[at], np.arange(len(t) + 1))))
            else:
                x, doc = K.shingles(h, w.first, n)
                out.append((K.mix(x + U64(n)) >> shift, np.searchsorted(doc, np.arange(len(t) + 1))))
    for n in prefix_ns:
        long = end - w.start > n
        h = K.span_hash(sums, w.start[long], w.start[long] + n)
        out.append((K.mix(h + U64(64 + n)) >> shift, np.concatenate([[0], np.cumsum(long)])[w.first]))
    for n in char_ns:
        if len(low) < n:
            out.append((np.zeros(0, np.uint64), np.zeros(len(t) + 1, np.int64)))
            continue
        x = np.zeros(len(low) - n + 1, dtype=np.uint64)
        for k in range(n):
            x = (x << U64(8)) | low[k : len(low) - n + 1 + k]
        at = np.arange(len(x))
        ok = np.ones(len(x), bool)
        inner = t.off[1:-1]
        for k in range(1, n):  # a run must not cross into the next text
            cross = inner - k
            ok[cross[(cross >= 0) & (cross < len(x))]] = False
        first = np.searchsorted(at[ok], t.off)
        out.append((((x[ok] + U64(n)) * U64(0x9E3779B97F4A7C15)) >> shift, first))
    return out


def present(families: list[tuple[np.ndarray, np.ndarray]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, ids): the distinct ids of each text, family f at f << bits and up, in one array by text."""
    n = len(families[0][1]) - 1
    keys = []
    for f, (ids, first) in enumerate(families):
        doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
        keys.append((doc << U64(32)) | (ids + (U64(f) << U64(bits))))
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    first = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << U64(32))
    return first, (key & U64(0xFFFFFFFF)).astype(np.int32)


def mean_bags(families: list[tuple[np.ndarray, np.ndarray]], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, share of the family's n-grams) of each text."""
    out = []
    for i in range(len(families[0][1]) - 1):
        ids, share = [], []
        for f, (x, first) in enumerate(families):
            u, c = np.unique(x[first[i] : first[i + 1]], return_counts=True)
            ids.append((u + (U64(f) << U64(bits))).astype(np.int32))
            share.append((c / max(1, c.sum())).astype(np.float32))
        out.append((np.concatenate(ids), np.concatenate(share)))
    return out


def mean_margin(families: list[tuple[np.ndarray, np.ndarray]], bits: int, bias: float, weights: np.ndarray) -> np.ndarray:
    """bias + for each family the mean weight of its n-grams (a dot product with their shares)."""
    z = np.full(len(families[0][1]) - 1, bias)
    for f, (ids, first) in enumerate(families):
        part = weights[f << bits : (f + 1) << bits]
        z += K.per_doc_sum(part[ids.astype(np.int64)].astype(np.float64), first) / np.maximum(1, np.diff(first))
    return z


def sigmoid(z: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.0, l2: float = 0.1, epochs: int = 6) -> tuple[float, np.ndarray]:
    """Logistic regression by follow-the-regularised-leader updates, one row at a time.

    Each coordinate keeps z (its regularised gradient sum) and n (its sum of
    squared gradients); its weight is the closed-form minimiser of the sum so
    far plus the L1 and L2 terms, and 0 while |z| <= l1.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)

    def weight(i: np.ndarray, l1_: float | np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1_, 0.0, -(zi - np.sign(zi) * l1_) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            ids, x = rows[r]
            i = np.append(ids, size)
            v = np.append(x, 1.0)
            reg = np.full(len(i), l1)
            reg[-1] = 0.0
            w = weight(i, reg)
            g = (sigmoid(float(w @ v)) - y[r]) * v
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    every = np.arange(size)
    return float(weight(np.array([size]), 0.0)[0]), weight(every, l1)


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, rate: float = 0.5, l2: float = 1e-4, epochs: int = 4, extra: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Logistic regression by adaptive stochastic gradients (bias, weights, weights of extra columns)."""
    m = 0 if extra is None else extra.shape[1]
    w, n = np.zeros(size + 1 + m), np.full(size + 1 + m, 1e-8)
    tail = np.arange(size, size + 1 + m)
    rng = np.random.default_rng(11)
    order = np.arange(len(rows))
    for _ in range(epochs):
        rng.shuffle(order)
        for r in order:
            ids, x = rows[r]
            i = np.concatenate([ids, tail])
            v = np.concatenate([x, [1.0], extra[r]] if m else [x, [1.0]])
            g = (sigmoid(float(w[i] @ v)) - y[r]) * v + l2 * w[i]
            n[i] += g * g
            w[i] -= rate * g / np.sqrt(n[i])
    return float(w[size]), w[:size], w[size + 1 :]


def fit_platt(margin: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) is a probability (Newton steps, smoothed targets)."""
    pos, neg = float((y == 1).sum()), float((y == 0).sum())
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)
