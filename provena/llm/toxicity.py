"""Toxicity by classifier chains over hashed n-gram models.

The chain predicts ``low_quality``, ``toxic`` and ``toxic_low_quality`` in this order; each later linear model also reads the earlier
categories' log-odds, and is trained on those that models of the other folds gave (out of fold), as it will meet them in use. All three
come from the label table alone (``quality``, ``toxic`` and the conjunction of both); it has no finer kinds of toxicity. A category of
which the sample has one value only is predicted as that value.

Fitted in one executor task on at most ``SAMPLE`` labelled documents (those least by a hash of their id). Calibration and thresholds
come from different halves of the out-of-fold predictions: Platt's method on one half, the threshold of the best F1 on the other.
Weights are broadcast: three times a fixed ``linear.DIM``.

Cases: a null text counts as empty; a text without words is not toxic, with probability 0. Without labels of both kinds nothing is
toxic. A probability equal to its threshold counts as the category. A text of any length is scored whole; a batch holds a few of the
longest only. Repeated rows give repeated rows, a null ``doc_id`` stays null, an empty table gives no rows. Other input columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import Words, bounded_labels, fitted, map_batches, table
from provena.llm.linear import Texts, fit, platt, sigmoid

SAMPLE, FOLDS = 4_000, 2
CATEGORIES = ("low_quality", "toxic", "toxic_low_quality")
_SETTINGS = {"l2": 1e-5, "rounds": 50, "rate": 0.3}


def base_columns(words: Words) -> np.ndarray:
    n = np.diff(words.starts)
    return np.stack([np.log1p(n) / 5, np.ones(len(n))], axis=1)


def _best_threshold(p: np.ndarray, labels: np.ndarray) -> float:
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + labels.sum())
    k = int(np.argmax(f1))
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(min(max((p[order[k]] + after) / 2, 0.05), 0.95))


def train(rows: list[tuple[int, str, int, int]]) -> list[tuple] | None:
    """One ``(weights, extra weights, a, b, threshold)`` for each category from ``(doc_id, text, quality, toxic)`` rows, or None if all
    are toxic or none is."""
    toxic, bad = np.array([r[3] for r in rows], dtype=float), np.array([1 - r[2] for r in rows], dtype=float)
    if len(set(toxic.tolist())) < 2:
        return None
    words = Words(pa.array([r[1] for r in rows], pa.large_string()))
    texts, extra = Texts(words, "mean"), base_columns(words)
    fold, chain = np.arange(len(rows)) % FOLDS, []
    half = np.arange(len(rows)) // FOLDS % 2 == 0  # calibration; the other half chooses the threshold
    for y in (bad, toxic, bad * toxic):
        if len(set(y.tolist())) < 2:
            w, v, a, b, threshold = np.zeros(1), np.zeros(extra.shape[1]), 0.0, 30.0 if y[0] else -30.0, 0.5
            held = np.zeros(len(rows))
        else:
            held, w, v = np.zeros(len(rows)), 0.0, 0.0
            for k in range(FOLDS):
                own, more = fit(texts, extra, y, (fold != k).astype(float), **_SETTINGS)
                held[fold == k] = (texts.scores(own) + extra @ more)[fold == k]
                w, v = w + own / FOLDS, v + more / FOLDS
            # the scores of the folds' mean are as spread out as those that are calibrated
            a, b = platt(held[half], y[half])
            threshold = _best_threshold(sigmoid(a * held + b)[~half], y[~half])
        chain.append((w.astype(np.float32), v, a, b, threshold))
        extra = np.concatenate([np.clip(a * held + b, -6, 6)[:, None], extra], axis=1)
    return chain


def toxicity(docs: DataFrame, chain: list[tuple] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, each category's calibrated probability ``p_...`` and decision."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            texts, extra = Texts(words, "mean"), base_columns(words)
            some = np.diff(words.starts) > 0
            out: list[pa.Array] = []
            for w, v, a, b, threshold in shared.value or [(None, None, 0, 0, 1)] * len(CATEGORIES):
                p = np.zeros(batch.num_rows)
                if w is not None:
                    z = a * ((texts.scores(w) if len(w) > 1 else 0) + extra @ v) + b
                    extra = np.concatenate([np.clip(z, -6, 6)[:, None], extra], axis=1)
                    p = np.where(some, sigmoid(z), 0.0)
                out += [pa.array(np.round(p, 6)), pa.array(some & (p >= threshold))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", *(x for c in CATEGORIES for x in (f"p_{c}", c))])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"p_{c} double, {c} boolean" for c in CATEGORIES))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), fitted(bounded_labels(spark, sf_dir, ("quality", "toxic"), SAMPLE), train))
