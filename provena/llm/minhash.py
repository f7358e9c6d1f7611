"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide.

1. One narrow pass makes a row per document: the number of its distinct shingles, a digest of the set, the MinHash bands and the
   odd sketch (the MinHash samples folded into a parity bitmap; the population count of the XOR of two bitmaps estimates a high
   similarity precisely). Documents with equal sets are one class, the node of all that follows.
2. Every class is compared with two of the least classes of its buckets: the least of all, and the one that it shares most buckets
   with. Pairs whose sketches say that they may link are confirmed on their texts. A group of near copies of any size costs at most two
   pairs for each member.
3. Only classes in buckets that then still hold several components are compared further, by an exact set join and not by bucket:
   two sets that link have a shingle in common among the rarest few of each, and where it stands bounds their intersection (prefix
   and positional filter). ``TURNS`` times ``LEADERS`` sets of each rare shingle meet the others that hold it; what is then still apart meets in
   pairs, which the sketches thin out and the full sets decide. So no link that could join two components of a bucket is left out.

The bands find a pair of similarity 0.85 with probability 0.99999 (30 bands of 7 samples); at lower thresholds the same samples make
more bands of fewer rows, so that at 0.80 (35 bands of 6) a pair is missed with probability 2.4e-5. A sketch passes a pair whose
estimate is at least the slack below the threshold, more than four standard errors of 210 samples: ``SLACK`` at 0.85.

Cases: a null text, or one without words, has no shingles, links with nothing and is kept. A text of one to four words is one
shingle. Rows with one ``doc_id`` are one node: the links of all their texts count. Rows without an id link by their texts alone; a
component of none but such rows has a null id and keeps them, another keeps its least id. Repeated rows give repeated rows, texts of any
length are read whole, an empty table gives no rows. Other input columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm.common import Words, map_batches, materialize, mix, table, windows
from provena.llm.components import components

SHINGLE, BANDS, ROWS, SKETCH_BITS, SLACK, TURNS, LEADERS = 5, 30, 7, 1024, 0.11, 2, 32
_K = BANDS * ROWS
_FACTORS = (mix(np.arange(1, _K + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SALTS = mix(np.arange(1001, 1001 + _K, dtype=np.uint64))


def band_rows(percent: int) -> int:
    """Samples in a band, as many as miss a pair at the threshold with probability 3e-5 at most."""
    missed = lambda rows: (1 - (percent / 100) ** rows) ** (_K // rows)
    return next((rows for rows in range(ROWS, 1, -1) if missed(rows) <= 3e-5), 1)


def slack(percent: int) -> float:
    """``SLACK`` at 0.85, and as many standard errors elsewhere."""
    return SLACK * max(1.0, (percent * (100 - percent) / (85 * 15)) ** 0.5)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit codes of each text's shingles."""
    words = Words(texts, lower=True)
    codes = words.codes()
    runs = windows(codes, SHINGLE)
    for a, b in zip(words.starts[:-1].tolist(), words.starts[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(runs[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(np.array([xxhash.xxh3_64_intdigest(codes[a:b].tobytes())], dtype=np.uint64))
        else:
            yield np.empty(0, np.uint64)


def min_samples(codes: np.ndarray) -> np.ndarray:
    """The least value of a set under each of the permutations of 32 bits."""
    low = np.full(_K, 0xFFFFFFFF, np.uint32)
    x = (codes >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        np.minimum(low, (x[at : at + 4096, None] * _FACTORS).min(axis=0), out=low)
    return low


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Each sample flips the bit that it hashes to."""
    bits = (mix(samples.astype(np.uint64) ^ _SALTS) % np.uint64(SKETCH_BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=SKETCH_BITS) & 1).astype(np.uint8), bitorder="little").view("<i8")


def band_keys(samples: np.ndarray, size: int = ROWS) -> np.ndarray:
    bands = _K // size
    rows = samples[: bands * size].reshape(bands, size).astype(np.uint64)
    acc = mix(np.arange(bands, dtype=np.uint64) + np.uint64(77))
    for k in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return acc.view(np.int64)


def most_flips(similarity: float) -> int:
    """The greatest population count of two sketches' XOR at which the estimate still reaches ``similarity``: 2k(1 - J) samples
    differ, of which each flips one of n bits."""
    differing = 2 * _K * (1 - similarity)
    return int(SKETCH_BITS * (1 - (1 - 2 / SKETCH_BITS) ** differing) / 2) + 1


def sketches(docs: DataFrame, size: int = ROWS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, bits = [], [], [], []
            for codes in shingle_sets(batch.column(1)):
                sizes.append(len(codes))
                if len(codes):
                    samples = min_samples(codes)
                    digests.append(xxhash.xxh3_128_digest(codes.tobytes()))
                    bands.append(band_keys(samples, size))
                    bits.append(odd_sketch(samples))
                else:
                    digests.append(None)
                    bands.append(None)
                    bits.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["doc_id", "hash", "n_shingles", "digest", "bands", "sketch"])

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("hash")), run, "doc_id long, hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole shingle sets have 100 * intersection >= ``percent`` * union. Each node's set stands in
    the joins as its text (``texts``: ``node, text``); the set of ``a`` is kept from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            ids = batch.column(0).to_pylist()
            others = list(shingle_sets(batch.column(3)))
            for k, a in enumerate(ids):
                if a != last[0]:
                    last = (a, next(shingle_sets(batch.column(2).slice(k, 1))))
                same = len(np.intersect1d(last[1], others[k], assume_unique=True))
                keep.append(100 * same >= percent * (len(last[1]) + len(others[k]) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    rows = pairs.join(texts.toDF("b", "text_b").hint("merge"), "b").join(texts.toDF("a", "text_a").hint("merge"), "a")
    return map_batches(rows.select("a", "b", "text_a", "text_b"), run, "a long, b long")


def _flips(x: str, y: str):
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _codes(texts: DataFrame) -> DataFrame:
    """``node, n, codes``: the shingle set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [codes.view(np.int64) for codes in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "n", "codes"])

    return map_batches(texts, run, "node long, n long, codes array<long>")


def rare_shingles(texts: DataFrame, percent: int) -> DataFrame:
    """``node, n, code, pos``: of the shingles that several texts hold, those among the rarest ``n - ceil(percent * n / 100) + 1`` of
    each, with their place in its order by rarity. Any two sets of such a similarity share one of them."""
    held = materialize(_codes(texts).select("node", "n", F.explode("codes").alias("code")), "codes")
    often = held.groupBy("code").agg(F.count("*").alias("df")).where("df > 1")
    known = held.join(often.hint("merge"), "code").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "code"))).alias("known"))
    alone = F.col("n") - F.size("known")  # in no other text, so before all these
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    known = known.withColumn("alone", alone).select("node", "n", "alone", F.posexplode(F.slice("known", F.lit(1), F.greatest(F.lit(0), prefix - alone).cast("int"))).alias("k", "own"))
    return known.select("node", "n", F.col("own.code").alias("code"), (F.col("alone") + F.col("k")).alias("pos"))


def _may_link(percent: int) -> Column:
    """Of sets ``a`` and ``b`` that meet in a shingle at ``pa`` and ``pb``: whether sizes and places allow a link between components."""
    na, nb, both = F.col("na"), F.col("nb"), 100 + percent
    least = F.floor((percent * (na + nb) + both - 1) / both)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - F.col("pa"), nb - F.col("pb")) >= least) & (F.col("ca") != F.col("cb"))


def _side(rare: DataFrame, x: str) -> DataFrame:
    return rare.select("code", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), F.col("component").alias(f"c{x}"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``; ``percent`` is the similarity in hundredths."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    limit = most_flips(percent / 100 - slack(percent))
    rows = materialize(sketches(docs, band_rows(percent)), "sketches")
    worded = rows.where("digest is not null")
    # equal sets have equal bands and sketches; the numbers are fixed once the table is written
    nodes = worded.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "hash")).alias("own"), F.first(F.struct("bands", "sketch")).alias("made"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "own.doc_id", "own.hash", "made.bands", "made.sketch"), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    shared = materialize(members.join(leaders.hint("merge"), "bucket").select("node", "bucket", "a"), "members")
    bits = nodes.select("node", "sketch")
    # the texts of classes that share a bucket with another: the only shuffle of whole texts
    asked = nodes.join(shared.select("node").distinct().hint("merge"), "node", "left_semi").select("node", F.col("doc_id").alias("id"), F.col("hash").alias("own"))
    found = docs.withColumn("hash", F.xxhash64("text")).join(asked.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("own")))
    texts = materialize(found.select("node", "text").dropDuplicates(["node"]), "texts")
    thinned = lambda pairs: pairs.join(bits.toDF("a", "sketch_a").hint("merge"), "a").join(bits.toDF("b", "sketch_b").hint("merge"), "b").where(_flips("sketch_a", "sketch_b") <= limit).select("a", "b")
    often = shared.where("node <> a").groupBy("node", "a").agg(F.count("*").alias("n"))
    star = often.groupBy("node").agg(F.min("a").alias("x"), F.max_by("a", F.struct("n", -F.col("a"))).alias("y"))
    star = star.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), F.col("node").alias("b"))
    tried = materialize(thinned(star).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = materialize(confirmed(tried, texts, percent), "links")
    several = worded.groupBy("doc_id").agg(F.min(F.xxhash64("digest")).alias("x"), F.max(F.xxhash64("digest")).alias("y")).where("x <> y and doc_id is not null").select("doc_id")
    several = worded.select("doc_id", "digest").join(several.hint("merge"), "doc_id").join(nodes.select("digest", "node").hint("merge"), "digest")
    several = materialize(several.select("doc_id", "node"), "several")
    several = several.join(several.groupBy("doc_id").agg(F.min("node").alias("first")).hint("merge"), "doc_id").where("node <> first")
    labels = materialize(components(links.union(several.select("first", "node"))), "labels")
    merged = lambda more: materialize(components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "labels")
    known = shared.join(labels.hint("merge"), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    mixed = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket")
    apart = known.join(mixed.hint("merge"), "bucket").select("node").distinct()
    rare = materialize(rare_shingles(texts.join(apart.hint("merge"), "node", "left_semi"), percent), "rare")
    for turn in (*range(1, TURNS + 1), None):
        now = rare.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        b, smaller = _side(now, "b"), F.lit(True)
        if turn:  # a few sets of each shingle, others each turn, meet the rest: linear, and most that link are joined by it
            order = F.xxhash64("code", "node", F.lit(turn))
            a = now.groupBy("code", F.pmod(order, F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct(order.alias("order"), "node", "n", "pos", "component")).alias("own")).select("code", "own.*")
        else:  # the smaller set of a pair holds such a shingle even among fewer of its rarest
            a = now.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * 2 * percent / (100 + percent)))
            smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
        pairs = _side(a, "a").hint("merge").join(b, "code").where(_may_link(percent) & smaller).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(thinned(pairs.join(tried, ["a", "b"], "left_anti")), "pairs")
        tried = tried.union(pairs)
        labels = merged(materialize(confirmed(pairs, texts, percent), "links"))
    least = nodes.select("node", "digest", "least").join(labels.hint("merge"), "node", "left")
    linked, alone = least.where("component is not null"), least.where("component is null")  # apart: a null would be one key for most
    joined = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(joined.hint("merge"), "component").select("digest", "component_id")
    least = linked.union(alone.select("digest", "least")).withColumn("found", F.lit(True))
    out = rows.select("doc_id", "n_shingles", "digest").join(least.hint("merge"), "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same links in DuckDB, by a join of all shingles: for small tables.
OP2_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union select b, a from l),
r(node, other) as (select doc_id, doc_id from documents union select r.node, e.b from r join e on e.a = r.other),
c as (select node, min(other) as component_id from r group by node)
select node as doc_id, coalesce(n, 0) as n_shingles, component_id, node = component_id as kept from c left join n on n.doc_id = node
"""
