"""Installed images: file listings and their fingerprints, snapshots, and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar


def files(spark: SparkSession, path: str) -> DataFrame:
    """``package, path, bytes, digest`` of every file below ``path/<package>/``; contents are hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    clean = F.regexp_replace("path", "^[a-z]+:/*", "/")
    relative = F.regexp_extract(clean, r"/" + path.rstrip("/").rpartition("/")[2] + r"/(.+)$", 1)
    return found.select(F.split_part(relative, F.lit("/"), F.lit(1)).alias("package"), F.regexp_replace(relative, "^[^/]+/", "").alias("path"), F.col("length").alias("bytes"), scalar.digest(F.col("content")).alias("digest"))


def fingerprints(listing: DataFrame) -> DataFrame:
    """``package, fingerprint, files, bytes``: the framed digest of sorted paths and file digests."""
    rows = F.array_sort(F.collect_list(F.struct("path", "digest")))
    joined = F.aggregate(rows, F.lit(b""), lambda acc, x: F.concat(acc, scalar.framed(x["path"]), scalar.framed(x["digest"])))
    return listing.groupBy("package").agg(F.sha2(joined, 256).alias("fingerprint"), F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per file: unchanged, changed, missing or extra."""
    b = before.select("package", "path", F.col("digest").alias("old"))
    a = after.select("package", "path", F.col("digest").alias("new"))
    state = F.when(F.col("old").isNull(), "extra").when(F.col("new").isNull(), "missing").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return b.join(a, ["package", "path"], "full_outer").select("package", "path", state.alias("state"))


def resources(listing: DataFrame, excluded: list[str]) -> DataFrame:
    """Files of a source root that are copied: those whose first component is not excluded."""
    return listing.where(~F.split_part("path", F.lit("/"), F.lit(1)).isin(*excluded))


def present_in_both(source: DataFrame, installed: DataFrame) -> DataFrame:
    return source.join(installed.select("package", "path"), ["package", "path"], "left_semi")
