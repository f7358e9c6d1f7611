"""An immutable, verified cache of entries ``name, bytes, digest`` as a Parquet table of appended batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar

#: Entries lie in folders by a hash of their name, so a reader of few names opens few files.
SCHEMA, BUCKETS = "name string, length long, digest string, bytes binary, bucket int", 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("name"), F.lit(BUCKETS)).cast("int")


@dataclass
class Cache:
    """Publishing appends a batch below ``path``; removal writes what stays to a new path, so readers of the old one go on. Writers don't
    lock: of two batches that hold one name, every reader takes the entry of the least digest."""

    spark: SparkSession
    path: str

    def _stored(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/entries")
        except AnalysisException:
            return self.spark.createDataFrame([], SCHEMA)

    def names(self) -> DataFrame:
        """``name, length, digest`` of every entry as stored, without its bytes."""
        return self._stored().groupBy("name").agg(F.min(F.struct("digest", "length")).alias("e")).select("name", "e.length", "e.digest")

    def entries(self) -> DataFrame:
        """Every entry whose bytes still have their digest; others are misses."""
        sound = self._stored().where(scalar.digest(F.col("bytes")) == F.col("digest"))
        return sound.groupBy("name").agg(F.min(F.struct("digest", "bytes")).alias("e")).select("name", "e.bytes", "e.digest")

    def read(self, names: DataFrame) -> DataFrame:
        """``name, bytes`` for each asked name; null bytes are misses. Only what is asked for is read and verified."""
        asked = names.select("name").distinct().withColumn("bucket", _bucket())
        found = self._stored().join(asked, ["bucket", "name"], "left_semi").where(scalar.digest(F.col("bytes")) == F.col("digest"))
        found = found.groupBy("name").agg(F.min(F.struct("digest", "bytes")).alias("e")).select("name", "e.bytes")
        return asked.select("name").join(found, "name", "left")

    def publish(self, rows: DataFrame) -> int:
        """Insert or ignore: a name that is there and sound stays as it is; of new rows of one name the least digest is written."""
        new = rows.select("name", "bytes", scalar.digest(F.col("bytes")).alias("digest")).groupBy("name").agg(F.min(F.struct("digest", "bytes")).alias("b")).select("name", F.octet_length("b.bytes").cast("long").alias("length"), "b.digest", "b.bytes").withColumn("bucket", _bucket())
        there = self._stored().join(new.select("bucket", "name"), ["bucket", "name"], "left_semi").where(scalar.digest(F.col("bytes")) == F.col("digest")).select("name")
        new = new.join(there, "name", "left_anti").select("name", "length", "digest", "bytes", "bucket").persist()
        try:
            n = new.count()
            if n:
                new.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/entries")
            return n
        finally:
            new.unpersist()

    def listing(self) -> DataFrame:
        return self.names().select("name", "length").orderBy("name")

    def report(self) -> DataFrame:
        """Entries and bytes by kind and package."""
        parts = scalar.parse_cache_name(F.col("name"))
        return self.names().select(parts.alias("p"), "length").groupBy(F.col("p.package").alias("package"), F.col("p.kind").alias("kind")).agg(F.count("*").alias("entries"), F.sum("length").alias("bytes"))

    def without(self, remove: Column, to: str) -> tuple[Cache, int]:
        """A cache at a new path with the entries that don't match; returns it and how many went."""
        every = self.entries()
        kept = every.where(~F.coalesce(remove, F.lit(False)))
        other = Cache(self.spark, to)
        kept.select("name", F.octet_length("bytes").cast("long").alias("length"), "digest", "bytes").withColumn("bucket", _bucket()).write.mode("append").partitionBy("bucket").parquet(f"{to}/entries")
        return other, every.count() - other.names().count()
