"""Shared plumbing of the training-data operators: table access, the shared folder, word codes and model inputs.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the cluster sets, so that every executor can read
them again after another one is lost. Only a session whose driver and executors are one process may go without: it gets a folder of
its own. Tables that a later one replaces are removed with ``discard``.
"""

from __future__ import annotations

import contextlib
import ctypes
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Arrow batches handed to Python hold at most this many rows and bytes, whatever the length of the texts.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


#: Session options that the operators want, as option: wanted value. A session's own value stays.
OPTIONS = {
    # Arrow batches bounded by bytes as well as rows, so a batch of very long texts stays small
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    # a job's shuffle files go when it ends: what later jobs need is written to the shared folder
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Sets ``OPTIONS`` that the caller has not set."""
    for key in OPTIONS.keys() - spark.conf.getAll.keys():
        spark.conf.set(key, OPTIONS[key])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="provena-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of tables from ``materialize`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Gives free memory back to the system, so that a worker that lives on holds no more than it uses."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded size; a worker trims its memory at the end of each task."""
    tune(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, nulls as empty, without decoding."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def cut(column: pa.Array) -> list[bytes]:
    """The values of a large string or binary column without nulls; many times faster than ``to_pylist``."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1].tolist() if len(column) else [0]
    data = column.buffers()[2].to_pybytes() if len(column) and column.buffers()[2] else b""
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def whole(texts: pa.Array) -> pa.Array:
    """A string column as large strings without nulls, in buffers of its own: some kernels misread slices of others."""
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))
    return texts.cast(pa.large_string()).fill_null("")


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: ``index`` into the ``distinct`` ones, those of text i from
    ``starts[i]`` to ``starts[i + 1]``. Split and numbered by Arrow; Python only sees the distinct ones."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = whole(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        starts = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(starts[0], starts[-1] - starts[0]).cast(pa.large_binary()).dictionary_encode()
        starts = starts - starts[0]
        self.distinct: pa.Array = coded.dictionary
        self.index = coded.indices.to_numpy(zero_copy_only=False)
        empty = np.flatnonzero(pc.binary_length(self.distinct).to_numpy(zero_copy_only=False) == 0)
        if len(empty):  # white space at either end
            keep = self.index != empty[0]
            starts = np.concatenate([[0], np.cumsum(keep)])[starts]
            self.index = self.index[keep]
        self.starts = starts

    def codes(self) -> np.ndarray:
        """Stable 64-bit codes of all words in order, equal on every executor."""
        words = cut(self.distinct)
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        return own[self.index]


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Codes of all runs of ``size`` consecutive words (at most eight), in order."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = mix(codes[:n] * _ODD[0])
    for k in range(1, size):
        acc = acc * _ODD[1] + codes[k : k + n] * _ODD[k % 8] + np.uint64(k)
        if k % 2:
            acc ^= acc >> np.uint64(29)
    return mix(acc)


def bounded_labels(spark: SparkSession, sf_dir: str, columns: tuple[str, ...], bound: int) -> DataFrame:
    """``doc_id, text`` and the label ``columns`` of at most ``bound`` labelled documents for fitting a classifier: those least by a
    hash of their id, the same in any run. Of several labels of one id the greatest counts, of several texts the least."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(*[F.max(c).cast("long").alias(c) for c in columns])
    labels = labels.where(" and ".join(f"{c} is not null" for c in (*columns, "doc_id")))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    docs = docs.join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    return docs.groupBy("doc_id", *columns).agg(F.min("text").alias("text")).select("doc_id", "text", *columns)


def fitted(rows: DataFrame, train: Callable[[list[tuple]], object]) -> object:
    """What ``train`` makes of the rows (a bounded sample), in order of their first column. One executor task gathers and fits; the
    driver gets the fitted model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sorted(found)))], pa.binary())], names=["model"])

    done = map_batches(rows.repartition(1), run, "model binary").collect()
    return pickle.loads(done[0].model) if done else train([])  # a sample without rows has no task
