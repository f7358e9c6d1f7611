"""Quality rules: counted base rules, then a calibrated hashed n-gram model trained on labelled quality rows.

The model is fitted in one executor task on at most ``SAMPLE`` labelled documents (those least by a hash of their id), calibrated by
Platt's method on scores of ``FOLDS`` held-out folds, broadcast (a fixed ``linear.DIM`` weights) and applied in Arrow batches against
the fixed ``THRESHOLD``. Character n-grams are runs of UTF-8 bytes. Without labels of both kinds the verdict is the base rules' own.

Cases: a null text counts as empty, has no words and fails the base rules. Repeated rows give repeated rows, and a null ``doc_id``
stays null. A probability equal to ``THRESHOLD`` keeps. A text of any length is counted and scored whole; a batch holds a few of the
longest only. An empty table gives no rows. Other input columns are not read by ``quality_rows`` and pass through ``keep_quality``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import Words, bounded_labels, fitted, map_batches, table, whole, windows
from provena.llm.linear import Texts, fit, platt, sigmoid, sums

SAMPLE, FOLDS, THRESHOLD, WINDOW = 3_000, 2, 0.5, 8
#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEATED_PERCENT, SYMBOLS = 20, 30, "[#*$%&|<>]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _dup_lines(texts: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(texts, "\n")
    starts = lines.offsets.to_numpy().astype(np.int64)
    coded = lines.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    starts = starts - starts[0]
    worded = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(zero_copy_only=False) > 0
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    use = worded[index] if len(index) else np.zeros(0, bool)
    distinct = np.unique(owner[use] * max(1, len(worded)) + index[use]) // max(1, len(worded))
    return np.bincount(owner[use], minlength=len(texts)) - np.bincount(distinct, minlength=len(texts))


def _repeat_words(words: Words, codes: np.ndarray) -> np.ndarray:
    """Words that stand in a window of eight found twice or more in their text."""
    n = len(codes)
    runs = windows(codes, WINDOW)
    counts = np.diff(words.starts)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[: len(runs)] == owner[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = runs[at] ^ (owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n + WINDOW + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + WINDOW, -1)
    return sums((np.cumsum(cover)[:n] > 0).astype(np.int64), words.starts)


def counted(texts: pa.Array, words: Words | None = None) -> dict[str, np.ndarray]:
    """The base counts of each text of a batch."""
    texts = whole(texts)
    words = words or Words(texts)
    distinct = words.distinct.cast(pa.large_string())
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    symbols = pc.count_substring_regex(distinct, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64)
    pick = lambda values: sums(values[words.index] if len(words.index) else np.zeros(0, np.int64), words.starts)
    return dict(zip(COUNTS, (np.diff(words.starts), pick(chars), pick(symbols), _dup_lines(texts), _repeat_words(words, words.codes())), strict=True))


def failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * counts["n_words"])


def extra_columns(counts: dict[str, np.ndarray]) -> np.ndarray:
    n = np.maximum(counts["n_words"], 1)
    return np.stack([np.log1p(n) / 5, np.minimum(counts["n_symbols"] / n, 4), counts["n_repeat_words"] / n, np.minimum(counts["word_chars"] / n, 20) / 5, np.ones(len(n))], axis=1)


def train(rows: list[tuple[int, str, int]]) -> tuple | None:
    """``weights, extra weights, a, b`` from ``(doc_id, text, label)`` rows, or None without both labels."""
    labels = np.array([r[2] for r in rows], dtype=float)
    if len(set(labels.tolist())) < 2:
        return None
    batch = pa.array([r[1] for r in rows], pa.large_string())
    words = Words(batch)
    texts, extra = Texts(words, "mean"), extra_columns(counted(batch, words))
    fold, held = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    settings = {"l2": 1e-5, "rounds": 40, "rate": 0.05}
    for k in range(FOLDS):
        w, v = fit(texts, extra, labels, (fold != k).astype(float), **settings)
        held[fold == k] = (texts.scores(w) + extra @ v)[fold == k]
    a, b = platt(held, labels)
    w, v = fit(texts, extra, labels, np.ones(len(rows)), **settings)
    return w.astype(np.float32), v, a, b


def quality_rows(docs: DataFrame, model: tuple | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``kept`` and ``probability`` of good quality."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            counts = counted(batch.column(1), words)
            bad = failed(counts)
            if shared.value is None:
                p = np.where(bad, 0.0, 1.0)
            else:
                w, v, a, b = shared.value
                p = sigmoid(a * (Texts(words, "mean").scores(w) + extra_columns(counts) @ v) + b)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in counts.values()), pa.array(bad), pa.array(~bad & (p >= THRESHOLD)), pa.array(p)], names=["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, probability double")


def keep_quality(docs: DataFrame, model: tuple | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, with all their columns: a narrow pass."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(at))
            counts = counted(batch.column(at), words)
            keep = ~failed(counts)
            if shared.value is not None:
                w, v, a, b = shared.value
                keep &= sigmoid(a * (Texts(words, "mean").scores(w) + extra_columns(counts) @ v) + b) >= THRESHOLD
            yield batch.filter(pa.array(keep))

    return map_batches(docs, run, docs.schema)


def quality_model(spark: SparkSession, sf_dir: str) -> tuple | None:
    return fitted(bounded_labels(spark, sf_dir, ("quality",), SAMPLE), train)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rows(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
