"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination and packing, each over whole tables.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``. All but the
last return the columns of ``documents``, others of the input as well, but for the names that an operator's docstring keeps for itself.

Cases: a null or empty text fails the quality rules and goes there; in the other stages it is a document without words or lines, which
stays. Rows without a ``doc_id`` are documents of their own in every stage. Of rows with equal id and text near-dedup keeps one; rows that
share an id with different texts are told apart. Very long texts are read whole. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import decontam, linededup, minhash, packing, quality
from provena.llm.common import materialize, table, tune

#: Documents with so many hundredths of their shingles in common are near copies.
NEAR_PERCENT = 80
#: In near-dedup, texts that share a document id have ids of their own from here on.
_OWN = 1 << 62


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the model reject go."""
    tune(spark)
    return quality.keep_quality(docs, quality.quality_model(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-equal long lines, and of equal ones of 20 characters and fewer words, the first occurrence stays. A document that loses all its text this way goes; the
    texts of the others shrink, and ``n_chars`` with them."""
    tune(spark)
    out = linededup.drop_repeated_lines(docs)
    out = out.where("drops is null or text <> ''")
    return out.withColumn("n_chars", F.when(F.col("drops").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near copies stays. Rows of one ``doc_id`` are one document if their texts are equal; if
    not, each text is a document of its own, behind those whose id is unique. Rows without a ``doc_id`` all stay."""
    tune(spark)
    code = F.xxhash64("doc_id", "text")
    named = docs.where("doc_id is not null").withColumn("__node", F.col("doc_id").cast("long"))
    several = named.groupBy("doc_id").agg(F.min(code).alias("x"), F.max(code).alias("y")).where("x <> y").select(F.col("doc_id").alias("__id"))
    several = materialize(several, "ids")
    if not several.isEmpty():
        named = named.join(several.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
        own = code.bitwiseAND(F.lit(_OWN - 1)).bitwiseOR(F.lit(_OWN))
        named = named.withColumn("__node", F.when(F.col("__id").isNull(), F.col("__node")).otherwise(own)).drop("__id")
    kept = minhash.near_duplicates(named, key="__node", percent=NEAR_PERCENT).where("kept").select(F.col("doc_id").alias("__node")).distinct()
    named = named.join(kept, "__node", "left_semi").dropDuplicates(["__node"])
    return named.select(docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and their places in training sequences."""
    tune(spark)
    return packing.pack(packing.token_pieces(docs).withColumn("ids_crc32", packing.crc()))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained model or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs.drop("ids")
