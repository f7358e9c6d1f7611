"""Tables between the rounds of an iterative plan, in the folder named by ``spark.checkpoint.dir`` that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="provena-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "round") -> DataFrame:
    """Writes ``df`` and reads it back: short lineage, and nothing is lost with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "round") -> tuple[DataFrame, int]:
    """``cut``, and the number of rows that it wrote, observed while it did."""
    rows = Observation()
    return cut(df.observe(rows, F.count(F.lit(1)).alias("n")), name), rows.get["n"]
