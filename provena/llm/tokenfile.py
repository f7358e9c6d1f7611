"""Token-id files in patched frame-of-reference blocks.

A segment holds the ids of a run of documents. Layout, all little-endian::

    magic "PFOR0001" | n_docs u32 | block u32 | n_values u64 | n_blocks u32 | n_null u32
    doc_id i64[n_docs] | n_tokens u64[n_docs] | block starts u64[n_blocks + 1]
    blocks: minimum u32 | width u8 | 0 u8 | n_exceptions u16 | packed (value - minimum), ``width`` low bits each
            | exception positions u16[] | exception values u32[] (value - minimum)

``width`` is the number of bits of a percentile of the block's offsets, so a few large ids don't widen a whole block; the others
go to the exception list. The last block is padded with its minimum. Any id can be read through the block starts. The first
``n_null`` documents have no id; 0 stands for it.

The segments are rows of a Parquet table in the folder that all executors share, because only Spark's committers publish files
to any store once and whole, whatever executor is lost. Rows are in ascending key order by ``shard`` and ``segment``.
``export_files`` puts each segment into a plain file of its own.

Cases: a null text has the end id alone. Rows without a key come first; rows of one key are ordered by their text's hash. A text of
any length is whole in one segment, which it then exceeds ``SEGMENT_IDS`` by. An empty table writes an empty one and reads as no rows.
Other input columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.llm.common import map_batches, materialize, shared_path, table
from provena.llm.tokens import encoder, tokenizer_path

MAGIC, BLOCK, PERCENTILE, END, SEGMENT_IDS = b"PFOR0001", 128, 95, 1, 1 << 18
_HEAD = struct.Struct("<8sIIQII")
_BLOCK_HEAD = np.dtype([("minimum", "<u4"), ("width", "u1"), ("zero", "u1"), ("n_exceptions", "<u2")])


def encode_segment(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE, n_null: int = 0) -> bytes:
    n = len(ids)
    n_blocks = -(-n // block)
    parts: list[bytes] = []
    sizes = np.zeros(n_blocks, np.int64)
    if n_blocks:
        padded = np.full(n_blocks * block, ids[-1], dtype=np.uint32)
        padded[:n] = ids
        rows = padded.reshape(n_blocks, block)
        if n % block:
            rows[-1, n % block :] = rows[-1, : n % block].min()
        low = rows.min(axis=1)
        deltas = rows - low[:, None]
        at = min(block - 1, -(-block * percentile // 100) - 1)
        typical = np.partition(deltas, at, axis=1)[:, at]
        widths = np.frexp(typical.astype(np.float64))[1].astype(np.int64)
        bodies: list[bytes] = [b""] * n_blocks
        for width in np.unique(widths).tolist():
            chosen = np.flatnonzero(widths == width)
            if width:
                bits = np.unpackbits(np.ascontiguousarray(deltas[chosen].astype("<u4")).view(np.uint8).reshape(len(chosen), block, 4), axis=2, bitorder="little")[:, :, :width]
                packed = np.packbits(bits.reshape(len(chosen), -1), axis=1, bitorder="little")
                for k, row in zip(chosen.tolist(), packed, strict=True):
                    bodies[k] = row.tobytes()
        over = (deltas.astype(np.uint64) >> widths[:, None].astype(np.uint64)) != 0
        n_over = over.sum(axis=1)
        where, column = np.nonzero(over)
        values, ends = deltas[where, column].astype("<u4"), np.cumsum(n_over)
        heads = np.zeros(n_blocks, _BLOCK_HEAD)
        heads["minimum"], heads["width"], heads["n_exceptions"] = low, widths, n_over
        column = column.astype("<u2")
        for k in range(n_blocks):
            a, b = ends[k] - n_over[k], ends[k]
            body = heads[k].tobytes() + bodies[k] + (column[a:b].tobytes() + values[a:b].tobytes() if a < b else b"")
            parts.append(body)
            sizes[k] = len(body)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    head = _HEAD.pack(MAGIC, len(doc_ids), block, n, n_blocks, n_null)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts.tobytes(), *parts])


def decode_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc_ids, counts, ids`` of a segment; see ``n_nulls`` for the documents without an id."""
    magic, n_docs, block, n, n_blocks, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id segment")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    counts = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at + 16 * n_docs).astype(np.int64)
    base = at + 16 * n_docs + 8 * (n_blocks + 1)
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros((n_blocks, block), np.uint32)
    if n_blocks:
        heads = raw[(base + starts[:-1])[:, None] + np.arange(8)].copy().view(_BLOCK_HEAD)[:, 0]
        widths = heads["width"].astype(np.int64)
        for width in np.unique(widths[widths > 0]).tolist():
            chosen = np.flatnonzero(widths == width)
            body = raw[(base + 8 + starts[chosen])[:, None] + np.arange(block * width // 8)]
            bits = np.zeros((len(chosen), block, 32), np.uint8)
            bits[:, :, :width] = np.unpackbits(body, axis=1, bitorder="little").reshape(len(chosen), block, width)
            out[chosen] = np.packbits(bits, axis=2, bitorder="little").reshape(len(chosen), -1).view("<u4")
        for k in np.flatnonzero(heads["n_exceptions"]).tolist():
            m, p = int(heads["n_exceptions"][k]), int(base + 8 + starts[k] + block * widths[k] // 8)
            out[k, np.frombuffer(data, "<u2", m, p)] = np.frombuffer(data, "<u4", m, p + 2 * m)
        out += heads["minimum"][:, None]
    return doc_ids, counts, out.reshape(-1)[:n]


def n_nulls(data: bytes) -> int:
    """How many of a segment's documents, its first ones, have no id."""
    return _HEAD.unpack_from(data)[5]


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = END) -> None:
    """Encodes ``docs`` and writes the segments in ascending key order. One shuffle, of the texts."""
    vocabulary = vocabulary or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, segment = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, held
            doc_ids, counts, ids, null = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            segment += 1
            values = (shard, segment - 1, None if null[0] else int(doc_ids[0]), len(doc_ids), len(ids), encode_segment(doc_ids, counts, ids, n_null=int(null.sum())))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "segment", "first_doc", "n_docs", "n_values", "payload"])

        for batch in batches:
            ids, starts = encoder(vocabulary).encode(batch.column(1))
            with_end = np.insert(ids, starts[1:], end).astype(np.uint32)
            starts = starts + np.arange(len(starts))
            null, a = batch.column(0).is_null().to_numpy(zero_copy_only=False), 0
            doc_ids = batch.column(0).fill_null(0).to_numpy()
            while a < batch.num_rows:
                room = SEGMENT_IDS - sum(len(x[2]) for x in held)
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + room, side="right")) - 1)
                held.append((doc_ids[a:b], np.diff(starts[a : b + 1]), with_end[starts[a] : starts[b]], null[a:b]))
                if sum(len(x[2]) for x in held) >= SEGMENT_IDS or b < batch.num_rows:
                    yield flush()
                a = b
        if held:
            yield flush()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    segments = map_batches(rows, run, "shard int, segment int, first_doc long, n_docs long, n_values long, payload binary")
    segments.write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids``. The starts come from two
    small prefix sums, over the shards and over the segments of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = payload.as_buffer().to_pybytes()
                doc_ids, counts, ids = decode_segment(raw)
                ends = np.cumsum(counts.astype(np.int64))
                data = memoryview(ids.astype("<u4").tobytes())
                own = [bytes(data[4 * (e - c) : 4 * e]) for c, e in zip(counts.astype(np.int64).tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=np.arange(len(doc_ids)) < n_nulls(raw)), pa.array(base + ends - counts.astype(np.int64)), pa.array(counts.astype(np.int64)), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own, pa.binary())] if with_ids else [])], names=["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    files = spark.read.schema("shard int, segment int, first_doc long, n_docs long, n_values long, payload binary").parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_values").alias("in_shard"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("in_shard").over(before), F.lit(0)).alias("shard_start"))
    inner = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_values").over(inner), F.lit(0)).alias("segment_start"))
    starts = segments.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("base"))
    rows = files.select("shard", "segment", "payload").join(starts, ["shard", "segment"]).select("base", "payload")
    return map_batches(rows, run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def export_files(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Writes each segment of ``path`` to ``folder`` (a URI that all executors reach) as the file ``shard-segment.pfor``: to a name of its
    own first, then renamed, so that a task that is run again replaces equal bytes. Returns ``file, n_docs, n_values`` in file order."""
    import uuid

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for batch in batches:
            names = []
            for shard, segment, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                names.append(f"{shard:06d}-{segment:06d}.pfor")
                own = f"{root}/.{names[-1]}-{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(payload.as_buffer())
                store.move(own, f"{root}/{names[-1]}")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(3), batch.column(4)], names=["file", "n_docs", "n_values"])

    rows = spark.read.parquet(path).select("shard", "segment", "payload", "n_docs", "n_values")
    return materialize(map_batches(rows, run, "file string, n_docs long, n_values long"), "exported").orderBy("file")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path, with_ids=False)
