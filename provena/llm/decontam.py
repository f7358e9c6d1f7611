"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased, and every run of characters that are neither letters nor digits becomes one space. An item may
differ from a passage by ``budget(item)`` edits (``ERRORS_PERCENT`` of its length). Cut into budget + 1 pieces, at least one piece
stands in such a passage unchanged; an Aho-Corasick automaton finds all pieces in a text in one pass, and around each hit Myers'
bit-parallel distance, with Python's integers as bit vectors of any length, finds where the whole item ends and begins. Stretches around
hits are merged first, so each place of a text is compared with an item once, however many of its pieces stand there.

The automaton is built on each executor from the benchmark, sent in blocks of at most ``BLOCK_CHARS`` characters; each block is one
pass over all texts. Items of fewer than ``MIN_CHARS`` characters are searched for without edits and on word boundaries only.

Cases: a null text or one without letters matches nothing. Null items are left out; equal items are searched for once and reported
under each id. Repeated rows give repeated rows, a null ``doc_id`` stays null; an empty benchmark or table gives clean rows or none.
Texts of any length are searched whole. Columns other than the named ones are not read by ``find_items`` and pass through
``drop_contaminated``, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import map_batches, table

ERRORS_PERCENT, MIN_CHARS, BLOCK_CHARS = 6, 40, 4_000_000
_GAP = re.compile(r"[\W_]+")


def normal(text: str) -> str:
    return _GAP.sub(" ", text.lower()).strip()


def normal_with_places(text: str) -> tuple[str, list[int]]:
    """The normal form and, for each of its characters, the place in ``text`` that it comes from."""
    out: list[str] = []
    places: list[int] = []
    for match in re.finditer(r"[^\W_]+", text):
        if out:
            out.append(" ")
            places.append(match.start())
        for at, char in enumerate(match.group()):
            low = char.lower()
            out.append(low)
            places += [match.start() + at] * len(low)
    return "".join(out), places


def budget(item: str) -> int:
    return max(1, len(item) * ERRORS_PERCENT // 100) if len(item) >= MIN_CHARS else 0


def pieces(item: str) -> list[tuple[int, str]]:
    """``budget + 1`` consecutive pieces and where they start."""
    n = budget(item) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_ends(pattern: str, text: str, limit: int) -> tuple[int, int]:
    """The least distance of ``pattern`` to any substring of ``text`` and the first place where such a one ends; (limit + 1, -1)
    if all are farther."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = full, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        x = masks.get(c, 0) | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & full
        hn = vp & d0
        hp = (vn | ~(vp | d0)) & full
        score += 1 if hp & top else -1 if hn & top else 0
        x = (hp << 1) & full
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & full
        if score < best:
            best, end = score, j + 1
    return best, end


def match(item: str, text: str, low: int, high: int) -> tuple[int, int, int] | None:
    """``distance, start, end`` of the best occurrence of ``item`` in ``text[low:high]`` within its budget."""
    limit = budget(item)
    distance, end = myers_ends(item, text[low:high], limit)
    if distance > limit:
        return None
    back = text[low : low + end][::-1]
    _, size = myers_ends(item[::-1], back, limit)
    return distance, low + end - size, low + end


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of stretches, as stretches that lie apart, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


class Finder:
    def __init__(self, items: list[str]):
        import ahocorasick

        self.items, self.found, self.limits = items, {}, [budget(x) for x in items]
        for k, item in enumerate(items):
            for at, piece in pieces(item):
                self.found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in self.found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if self.found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """``item, distance, start, end`` of all occurrences in a normal text. Of occurrences of one item that overlap, the one of
        least distance counts, and of such the one that ends first; what remains on both its sides is searched again."""
        if not self.found or not text:
            return []
        stretches: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.automaton.iter(text):
            for k, at in uses:
                start, limit = end + 1 - size - at, self.limits[k]
                own = stretches.setdefault(k, [])
                if limit:
                    own.append((max(0, start - limit), min(len(text), start + len(self.items[k]) + limit)))
                elif (not start or text[start - 1] == " ") and text[end + 1 : end + 2] in ("", " ") and not (own and start < own[-1][1]):
                    own.append((start, end + 1))
        out = []
        for k, own in stretches.items():
            if not self.limits[k]:
                out += [(k, 0, low, high) for low, high in own]
                continue
            todo = merged(own)
            while todo:
                low, high = todo.pop()
                if high - low >= len(self.items[k]) - self.limits[k] and (hit := match(self.items[k], text, low, high)):
                    out.append((k, *hit))
                    todo += [(low, hit[1]), (hit[2], high)]
        return out


#: The last automaton that this process has built.
_FINDERS: dict[str, Finder] = {}


def blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[str, list[int]]]]:
    """Blocks of distinct normal items with their ids; read to the driver one bounded block after the other."""
    block: dict[str, list[int]] = {}
    size = 0
    for row in items.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).orderBy("id").toLocalIterator():
        item = normal(row.text)
        if not item:
            continue
        if item not in block:
            if size and size + len(item) > BLOCK_CHARS:
                yield list(block.items())
                block, size = {}, 0
            block[item] = []
            size += len(item)
        block[item].append(row.id)
    yield list(block.items())


_HITS = "hits array<struct<item_id: long, distance: int, start: long, end: long>>"


def _search(docs: DataFrame, block: list[tuple[str, list[int]]], last: bool) -> DataFrame:
    """``docs`` (``doc_id, text`` and the ``hits`` of earlier blocks, if any) with this block's hits; without ``text`` after the last."""
    shared, token = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _FINDERS:
            _FINDERS.clear()
            _FINDERS[token] = Finder([item for item, _ in shared.value])
        finder, ids = _FINDERS[token], [x for _, x in shared.value]
        for batch in batches:
            out = []
            earlier = batch.column(2).to_pylist() if batch.num_columns > 2 else [[]] * batch.num_rows
            for text, known in zip(batch.column(1).to_pylist(), earlier, strict=True):
                hits = list(known)
                found = finder.search(normal(text)) if text else []
                if found:
                    whole, places = normal_with_places(text)
                    shift = 0 if whole == normal(text) else None  # odd case mappings: no places
                    for k, distance, a, b in found:
                        a, b = (places[a], places[b - 1] + 1) if shift == 0 else (-1, -1)
                        hits += [{"item_id": i, "distance": distance, "start": a, "end": b} for i in ids[k]]
                out.append(sorted(hits, key=lambda h: (h["item_id"], h["start"])))
            columns = [batch.column(0)] if last else [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, kind)], names=["doc_id", *([] if last else ["text"]), "hits"])

    return map_batches(docs, run, f"doc_id long, {_HITS}" if last else f"doc_id long, text string, {_HITS}")


def find_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, hits``, every occurrence of an item with its distance and its code points in the text. A
    narrow pass for each block of the benchmark."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    todo = blocks(items, item_key, item_text)
    block = next(todo)
    for following in todo:
        rows, block = _search(rows, block, False), following
    return _search(rows, block, True)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns; a narrow pass for each block of the benchmark."""
    at, schema = docs.columns.index(text), docs.schema
    for block in blocks(items, "item_id", "text"):
        shared, token = docs.sparkSession.sparkContext.broadcast([item for item, _ in block]), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            if token not in _FINDERS:
                _FINDERS.clear()
                _FINDERS[token] = Finder(shared.value)
            finder = _FINDERS[token]
            for batch in batches:
                yield batch.filter(pa.array([not (t and finder.search(normal(t))) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = map_batches(docs, run, schema)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.array_distinct(F.col("hits.item_id")))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"), ids.alias("item_ids"), F.to_json("hits").alias("hits"))
