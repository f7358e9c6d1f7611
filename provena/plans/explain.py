"""The explanation document: the condensed graph of what is kept and why."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.functions import scalar
from provena.operators import graph, report
from provena.plans.analysis import Analysis
from provena.plans.storage import cut

SCHEMA_VERSION = 1


@dataclass
class Explanation:
    components: DataFrame
    edges: DataFrame
    roots: DataFrame
    summaries: DataFrame
    stats: DataFrame


def one_row(parts: dict[str, DataFrame]) -> DataFrame:
    """The values of one-row, one-column tables as the columns of one row."""
    rows = None
    for name, df in parts.items():
        own = df.toDF("value").select(F.lit(name).alias("name"), "value")
        rows = own if rows is None else rows.union(own)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in parts])


def explain(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> Explanation:
    """``nodes`` has ``node, package, kind``; ``edges`` ``src, dst, kind, reason, source, start, end``; ``roots`` ``node, reason``.
    A component's identity is the framed digest of its sorted members; ``cyclic`` ones have several members or a loop."""
    edges = cut(edges.distinct(), "raw")
    plain = edges.select("src", "dst")
    found = graph.components(plain)
    labels = cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    loops = plain.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("loop", F.lit(True))
    m = labels.join(nodes, "node").join(loops, "node", "left")
    members = m.groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"), F.array_sort(F.collect_set("package")).alias("packages"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    members = members.withColumn("id", scalar.component_id(F.col("members"))).withColumn("cyclic", (F.size("members") > 1) | F.col("loop"))
    shown = report.presentation(m.select("component", F.col("node").alias("member"), "kind"))
    a, b = labels.toDF("src", "from"), labels.toDF("dst", "to")
    raw = cut(edges.join(a, "src").join(b, "dst"), "joined")
    across = raw.where("from <> to").select(F.col("from").alias("src"), F.col("to").alias("dst"), F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "kind", "reason", "source", "start", "end").alias("at"), F.col("kind"))
    merged = cut(report.coalesce_edges(across, ["at"], "kind"), "merged")
    marks = graph.redundant(merged.select("src", "dst"))
    ids = members.select("component", "id")
    out = merged.join(marks, ["src", "dst"]).join(ids.toDF("src", "from_id"), "src").join(ids.toDF("dst", "to_id"), "dst")
    out = out.select("src", "dst", scalar.edge_id(F.col("from_id"), F.col("to_id")).alias("id"), F.transform("evidence", lambda x: x["at"]).alias("evidence"), "reasons", "occurrences", "redundant")
    starts = roots.join(labels, "node").select(F.col("component").alias("root"), "reason", F.col("node").alias("root_node"))
    causes = graph.attribution(merged.select("src", "dst"), starts.select(F.col("root").alias("node")).distinct()).join(starts, "root")
    causes = causes.groupBy(F.col("node").alias("component")).agg(F.array_sort(F.collect_set("root_node")).alias("root_causes"))
    components = members.join(shown, "component").join(causes, "component", "left").drop("loop")
    cyclic = F.coalesce(F.sum(F.col("cyclic").cast("long")), F.lit(0))
    stats = one_row({"raw_edges": edges.agg(F.count("*")), "raw_nodes": nodes.agg(F.count("*")), "components": components.agg(F.count("*")), "nontrivial_sccs": components.agg(cyclic), "edges": merged.agg(F.count("*"))})
    return Explanation(components, out, starts.distinct(), report.package_summaries(nodes.select("node", "package"), plain), stats)


def document(e: Explanation) -> DataFrame:
    """One JSON text of the whole, in a fixed order: for package-sized explanations."""
    pack = lambda df, *order: df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in order])))))
    parts = {"components": pack(e.components, "component"), "edges": pack(e.edges, "src", "dst"), "roots": pack(e.roots, "root", "reason"), "packages": pack(e.summaries, "package"), "stats": e.stats.select(F.to_json(F.struct(*e.stats.columns)))}
    fields = F.concat_ws(",", F.lit(f'"schema_version":{SCHEMA_VERSION}'), *[F.concat(F.lit(f'"{name}":'), F.col(name)) for name in parts])
    return one_row(parts).select(F.concat(F.lit("{"), fields, F.lit("}")).alias("json"))


def why(analysis: Analysis, target: str) -> DataFrame:
    """Shortest path from a root to what ``target`` selects: ``pkg``, ``pkg::name`` or ``pkg:::name``. Of several the shortest, then the
    least."""
    package, _, name = target.replace(":::", "::").partition("::")
    wanted = analysis.nodes.where(F.col("package") == package)
    wanted = wanted.where(F.col("name") == name) if name else wanted
    paths = graph.shortest_paths(analysis.plain, analysis.roots.select("node").distinct(), analysis.hubs)
    hit = paths.join(wanted.select("node"), "node", "left_semi")
    return hit.orderBy("distance", "node").limit(1).select("node", "distance", "path")


def entries(analysis: Analysis, target: str) -> DataFrame:
    """All edges from other packages into what ``target`` selects, each with a shortest path to where it starts."""
    package, _, name = target.replace(":::", "::").partition("::")
    wanted = analysis.nodes.where(F.col("package") == package)
    wanted = wanted.where(F.col("name") == name) if name else wanted
    into = analysis.edges.join(wanted.select(F.col("node").alias("dst")), "dst", "left_semi").join(analysis.nodes.select(F.col("node").alias("src"), F.col("package").alias("from_package")), "src").where(F.col("from_package") != package)
    paths = graph.shortest_paths(analysis.plain, analysis.roots.select("node").distinct(), analysis.hubs).select(F.col("node").alias("src"), "path")
    return into.join(paths, "src").select("src", "dst", "kind", "reason", "path").orderBy("src", "dst", "kind")
