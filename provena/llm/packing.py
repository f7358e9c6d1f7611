"""Best-fit packing of token pieces into training sequences.

Every partition packs its own pieces online with a bounded number of open bins: a bitset has bit ``f`` set while some open bin
has ``f`` free places, so the tightest bin that takes a piece is the lowest set bit at or above the piece's length. When all bins
are open, the fullest closes. The bins that a partition still has open at its end are packed once more, whole, with those of
other partitions, so the loss doesn't grow with the number of partitions.

Cases: a null text counts as empty; with the separator every document has at least one id. A null ``doc_id`` stays null. Repeated
rows are packed as often as they come. Of bins with equal free space the one put there last takes the piece; any is as good. Very long
texts become many pieces, one batch of texts of bounded bytes at a time. An empty table gives no rows. Further input columns pass
through ``pack`` unchanged, but for ``sequence_id`` and ``offset``, which it replaces, and names that begin with ``__pack_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import map_batches, materialize, table
from provena.llm.tokens import encoder, tokenizer_path

CAPACITY, OPEN_BINS, SEPARATOR = 2048, 96, 0
#: Partitions whose left-over bins one task packs again.
FAN_IN = 32


class OpenBins:
    """Bounded-space best fit. ``place`` gives the bin and the offset of a piece, and the bin that closed to make room, if any."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.mask = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _put(self, free: int, bin_: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.mask |= 1 << free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return bin_

    def place(self, length: int) -> tuple[int, int, int | None]:
        fits = self.mask >> length
        closed = None
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open == self.limit:  # the fullest closes: the lowest set bit of all
                closed = self._take((self.mask & -self.mask).bit_length() - 1)
                self.open -= 1
            bin_, free = self.made, self.capacity
            self.made += 1
            self.open += 1
        if free > length:
            self._put(free - length, bin_)
        else:
            self.open -= 1  # full: the caller sees that from its own count
        return bin_, self.capacity - free, closed


def _packer(length: str, capacity: int, limit: int, schema: T.StructType):
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        bins = OpenBins(capacity, limit)
        base = TaskContext.get().partitionId() << 33
        held: dict[int, list[tuple]] = {}  # rows of earlier batches in open bins
        left: dict[int, int] = {}
        kinds: list[pa.DataType] = []

        def rows(found: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([is_open] * len(found))], names=names)

        for batch in batches:
            kinds = [*batch.schema.types, pa.int64(), pa.int64()]
            bin_of, at = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            here: dict[int, list[int]] = {}
            closed_rows: list[int] = []
            old: list[tuple] = []
            for k, size in enumerate(batch.column(names.index(length)).to_pylist()):
                if size is None or not 0 < size <= capacity:
                    raise ValueError(f"a piece of {size} ids does not fit a sequence of {capacity}")
                bin_, offset, closed = bins.place(size)
                bin_of[k], at[k] = base + bin_, offset
                here.setdefault(bin_, []).append(k)
                left[bin_] = capacity - offset - size
                for done in {closed, bin_ if left[bin_] == 0 else None} - {None}:
                    closed_rows += here.pop(done, [])
                    old += held.pop(done, [])
                    del left[done]
            taken = batch.take(pa.array(closed_rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(bin_of[closed_rows]), pa.array(at[closed_rows]), pa.array([False] * len(closed_rows), pa.bool_())], names=names)
            if old:
                yield rows(old, False)
            kept = [k for own in here.values() for k in own]
            for k, row in zip(kept, zip(*(c.to_pylist() for c in batch.take(pa.array(kept, pa.int64())).columns), strict=True), strict=True):
                held.setdefault(int(bin_of[k]) - base, []).append((*row, int(bin_of[k]), int(at[k])))
        if held:
            yield rows([row for own in held.values() for row in own], True)

    return run


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of 1 to ``capacity`` ids; two narrow passes and one join of left-overs."""
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    added = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("__pack_open", T.BooleanType())]
    schema = T.StructType([*pieces.schema.fields, *added])
    first = materialize(map_batches(pieces, _packer(length, capacity, open_bins, schema), schema), "packed")
    left = first.where("__pack_open").groupBy("sequence_id").agg(F.sum(length).alias("length"))
    tasks = max(1, -(-pieces.rdd.getNumPartitions() // FAN_IN))
    again = left.withColumnRenamed("sequence_id", "__pack_old").repartition(tasks)
    schema = T.StructType([*again.schema.fields, *added])
    moved = map_batches(again, _packer("length", capacity, open_bins, schema), schema)
    # ids of the second round are negative: none is in use yet
    moved = materialize(moved.select("__pack_old", (-1 - F.col("sequence_id")).alias("__pack_new"), F.col("offset").alias("__pack_shift")), "merged")
    rest = first.where("__pack_open").join(moved, F.col("sequence_id") == F.col("__pack_old"))
    rest = rest.withColumn("sequence_id", F.col("__pack_new")).withColumn("offset", F.col("offset") + F.col("__pack_shift"))
    names = [*columns, "sequence_id", "offset"]
    return first.where("not __pack_open").select(names).unionByName(rest.select(names))


def token_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, separator: int = SEPARATOR, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids``; each document's ids and the separator, cut only if longer than
    ``capacity``. ``ids`` are little-endian unsigned 32-bit integers."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = encoder(path).encode(batch.column(1))
            out: list[list] = [[], [], [], [], []]
            for doc, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                data = ids[a:b].tobytes() + int(separator).to_bytes(4, "little")
                for piece, at in enumerate(range(0, b - a + 1, capacity)):
                    own = data[at * 4 : (at + capacity) * 4]
                    for column, value in zip(out, (doc, piece, at, len(own) // 4, own), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "piece", "start", "length", "ids"])

    return map_batches(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), run, "doc_id long, piece int, start long, length long, ids binary")


def crc(ids: str | Column = "ids") -> Column:
    return F.crc32(ids)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents")).withColumn("ids_crc32", crc()).drop("ids")
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
