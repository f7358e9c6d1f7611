"""Connected components of an edge table by alternating large-star and small-star steps, all in DataFrame operations.

Each round is written to the shared folder, so lineage stays short and a lost executor costs one round at most. Neighbour lists
are never gathered: a step needs only the least neighbour of each node, which partial aggregation finds, and a join that
adaptive execution can split where one node has very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.llm.common import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with an edge to another; ``component`` is the least node that it reaches. Loops,
    repeated and reversed edges and nulls change nothing; an empty table gives an empty one."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, state = materialize(pairs, "edges"), None
    while True:
        # large star: greater neighbours of a node move to the least node of its neighbourhood
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: a node and its lesser neighbours move to the least of these
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "m").where("v <> m").union(least.select("u", "m")).toDF("u", "v")
        before, pairs = pairs, materialize(small.distinct(), "edges")
        discard(before)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct())
        state = now
