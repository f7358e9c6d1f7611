"""Hashed word and character n-gram logistic regression, in numpy, for scoring texts in Arrow batches.

A text's features are those of its words: the word itself and the runs of three to five bytes of the word between boundary marks,
each hashed to one of ``DIM`` weights. A word's share of the score is therefore a property of the word, computed once per
distinct word of a batch, and a text's score is a pooled sum over its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from provena.llm.common import Words, cut, mix

DIM, GRAMS = 1 << 18, (3, 4, 5)


def word_features(words: pa.Array, step: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, one after the other, and where those of each word start (one more for the end); ``step`` words at
    a time."""
    parts = [_word_features(words.slice(at, step)) for at in range(0, len(words), step)]
    ends = np.concatenate([np.diff(s) for _, s in parts]) if parts else np.empty(0, np.int64)
    return np.concatenate([f for f, _ in parts]) if parts else np.empty(0, np.int32), np.concatenate([[0], np.cumsum(ends)])


def _word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = [b"\x02" + w.lower() + b"\x03" for w in cut(words)]
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    left = ends[owner] - np.arange(len(data)) if len(data) else np.empty(0, np.int64)  # bytes from here to the word's end
    found, owners, code = [], [], np.zeros(len(data), np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(data * np.uint64(0x9E3779B97F4A7C15) + (ends[owner] - left - (ends - sizes)[owner]).astype(np.uint64)), out=total[1:]) if len(data) else None
    found.append(mix(total[ends] - total[ends - sizes]))
    owners.append(np.arange(len(texts)))
    for k in range(max(GRAMS)):
        n = max(0, len(data) - k)
        code = code[:n] * np.uint64(257) + data[k : k + n] + np.uint64(1)
        if k + 1 in GRAMS:
            whole = left[:n] > k
            found.append(mix(code[whole] * np.uint64(16) + np.uint64(k)))
            owners.append(owner[:n][whole])
    features, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return (features % np.uint64(DIM)).astype(np.int32)[order], np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(texts)))])


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the runs ``starts[i]`` to ``starts[i + 1]``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


class Texts:
    """A batch's words as a sparse matrix: ``text, word, value`` triples and the features of each distinct word.

    pool "mean": a word counts by its share of the text's words; "root": by its count over the root of their number, so that
    long texts dilute a few telling words less."""

    def __init__(self, words: Words, pool: str):
        n = len(words.starts) - 1
        counts = np.diff(words.starts)
        self.text, self.word = np.repeat(np.arange(n), counts), words.index.astype(np.intp)
        share = np.maximum(counts, 1) if pool == "mean" else np.sqrt(np.maximum(counts, 1))
        self.value = np.repeat((1 / share).astype(np.float32), counts)
        self.n = n
        self.features, self.starts = word_features(words.distinct)
        self.by_feature: tuple | None = None

    def word_scores(self, weights: np.ndarray) -> np.ndarray:
        """Every word has a feature, so no run is empty."""
        return np.add.reduceat(weights.astype(np.float32)[self.features], self.starts[:-1]) if len(self.features) else np.zeros(0)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, self.value * self.word_scores(weights)[self.word], minlength=self.n)

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        if self.by_feature is None:  # the words of each feature, one feature after the other
            owner = np.repeat(np.arange(len(self.starts) - 1, dtype=np.int32), np.diff(self.starts))
            order = np.argsort(self.features, kind="stable")
            self.by_feature = (owner[order], *np.unique(self.features[order], return_index=True))
        by_word = np.bincount(self.word, self.value * residual[self.text], minlength=len(self.starts) - 1).astype(np.float32)
        owner, present, begin = self.by_feature
        out = np.zeros(DIM)
        if len(present):
            out[present] = np.add.reduceat(by_word[owner], begin)
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: Texts, extra: np.ndarray, labels: np.ndarray, use: np.ndarray, l2: float, rounds: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the hashed features and of the ``extra`` columns (the last is the intercept), by Adam on the texts with ``use``."""
    w, v = np.zeros(DIM), np.zeros(extra.shape[1])
    m1, m2 = [np.zeros(DIM), np.zeros(len(v))], [np.zeros(DIM), np.zeros(len(v))]
    n = max(1, use.sum())
    for t in range(1, rounds + 1):
        r = (sigmoid(texts.scores(w) + extra @ v) - labels) * use / n
        for k, (p, g) in enumerate(((w, texts.gradient(r) + l2 * w), (v, extra.T @ r))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            p -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-9)
    return w, v


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """``a, b`` of the calibrated probability ``sigmoid(a * score + b)``, by Newton's method on smoothed targets."""
    pos, neg = labels.sum(), (1 - labels).sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * scores + b)
        g = np.array([((p - target) * scores).sum() + 1e-3 * (a - 1), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * scores * scores).sum() + 1e-3, (h * scores).sum()], [(h * scores).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)
