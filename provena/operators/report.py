"""Aggregated explanations: coalesced edges, grouped diagnostics, evidence summaries, coverage and dispatch lattices, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.graph import first_by

#: Ranks of node kinds when a component with several is shown.
PRESENTATION_RANK = {"Binding": 0, "Closure": 0, "Dataset": 0, "Resource": 0, "NativeComponent": 0, "Package": 1, "Activation": 1, "Lifecycle": 1, "Environment": 2}


def coalesce_edges(edges: DataFrame, evidence: list[str], reason: str = "reason") -> DataFrame:
    """Parallel edges as one: ``src, dst, evidence`` (sorted structs), ``reasons`` (sorted, distinct), ``occurrences``."""
    return edges.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct(*evidence))).alias("evidence"), F.array_sort(F.collect_set(reason)).alias("reasons"), F.count("*").alias("occurrences"))


def first_diagnostics(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """The first diagnostic per key in an explicit order."""
    return first_by(rows, key, order)


def grouped_by_cause(rows: DataFrame, cause: str, primary: list[str], evidence: str) -> DataFrame:
    """One primary per cause (the least) and the distinct sorted evidence."""
    return rows.groupBy(cause).agg(F.min(F.struct(*primary)).alias("primary"), F.array_sort(F.collect_set(evidence)).alias("evidence"))


def evidence_text(sites: Column, shown: int = 4) -> Column:
    """The first sites, then how many more there are."""
    n = F.size(sites)
    return F.concat(F.array_join(F.slice(sites, 1, shown), ", "), F.when(n > shown, F.concat(F.lit(" and "), (n - shown).cast("string"), F.lit(" more"))).otherwise(""))


def diagnostics_in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("package", "code", F.col("binding").asc_nulls_first(), "message")


def by_code(blockers: DataFrame) -> DataFrame:
    """Distinct blockers grouped by code, each group's messages sorted."""
    return blockers.dropDuplicates().groupBy("code").agg(F.array_sort(F.collect_list("message")).alias("messages"), F.count("*").alias("n"))


def coverage(callables: DataFrame, calls: DataFrame, key: str) -> DataFrame:
    """Caller coverage: pending without calls, open with an unclassified one (null ``invocation``), else known with the sorted list."""
    seen = calls.groupBy(key).agg(F.bool_or(F.col("invocation").isNull()).alias("__open"), F.array_sort(F.collect_set("invocation")).alias("invocations"))
    out = callables.join(seen, key, "left")
    return out.select(*callables.columns, F.when(F.col("__open").isNull(), "pending").when(F.col("__open"), "open").otherwise("known").alias("state"), F.when(~F.col("__open"), F.col("invocations")).alias("invocations"))


def dispatch(domains: DataFrame, key: str, classes: str) -> DataFrame:
    """Dispatch classes: open if any domain is unknown (null), else the sorted distinct classes and the default."""
    every = F.array_sort(F.array_distinct(F.concat(F.flatten(F.collect_list(classes)), F.array(F.lit("default")))))
    return domains.groupBy(key).agg(F.bool_or(F.col(classes).isNull()).alias("open"), every.alias("classes")).withColumn("classes", F.when(~F.col("open"), F.col("classes")))


def domain_intersection(domains: Column) -> Column:
    """Intersection of an array of arrays, in the first one's order; null domains don't limit."""
    known = F.array_compact(domains)
    return F.aggregate(F.slice(known, 2, F.greatest(F.size(known) - 1, F.lit(0))), F.get(known, F.lit(0)), F.array_intersect)


def guard_verdicts(guards: DataFrame) -> DataFrame:
    """Ordered conjunctions: ``fact, pos, state`` with state active, absent or unselected; the first guard that is not active decides."""
    bad = F.when(F.col("state") != "active", F.struct("pos", "state"))
    return guards.groupBy("fact").agg(F.min(bad).alias("b")).select("fact", F.coalesce(F.when(F.col("b.state") == "unselected", "PrunedByUnselectedOptional").when(F.col("b").isNotNull(), "Pruned"), F.lit("Active")).alias("verdict"))


def presentation(members: DataFrame) -> DataFrame:
    """Kind shown for each ``component``: least rank, then first member."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRESENTATION_RANK.items() for x in kv])[F.col("kind")], F.lit(3))
    return members.groupBy("component").agg(F.min_by("kind", F.struct(rank, "member")).alias("kind"))


def package_summaries(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per package: retained members, entry members (targets of edges from other packages) and boundary edges in and out. ``nodes`` has
    ``node, package``; ``edges`` has ``src, dst``."""
    a, b = nodes.toDF("src", "src_package"), nodes.toDF("dst", "dst_package")
    across = edges.join(a, "src").join(b, "dst").where("src_package <> dst_package")
    into = across.groupBy(F.col("dst_package").alias("package")).agg(F.array_sort(F.collect_set("dst")).alias("entry_members"), F.count("*").alias("edges_in"))
    out = across.groupBy(F.col("src_package").alias("package")).agg(F.count("*").alias("edges_out"))
    kept = nodes.groupBy("package").agg(F.count_distinct("node").alias("retained"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept.join(into, "package", "left").join(out, "package", "left").select("package", "retained", F.coalesce("entry_members", F.array().cast(into.schema["entry_members"].dataType)).alias("entry_members"), zero("edges_in"), zero("edges_out"))


def compared(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison of two key sets: ``side`` is both, left or right."""
    x, y = a.select(*key).distinct().withColumn("__a", F.lit(1)), b.select(*key).distinct().withColumn("__b", F.lit(1))
    return x.join(y, key, "full_outer").select(*key, F.when(F.col("__b").isNull(), "left").when(F.col("__a").isNull(), "right").otherwise("both").alias("side"))


def identity_conflicts(rows: DataFrame, key: str, identity: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count_distinct(identity).alias("identities")).where("identities > 1")
