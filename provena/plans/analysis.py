"""Demand-driven analysis of a package universe, from fact tables to retained nodes, edges and blockers.

What a reached node would demand is a table of possible edges, made by joins over the facts (references resolved by priority, qualified
accesses, namespace calls, imports, hooks, native components, resources, datasets). Demand is reach over it. Dispatch is the part that
depends on what has been reached, so it runs in later strata: registered methods of reached generics in activated packages, and, once all is
quiet, the open universe of dispatches whose classes are unknown. Whatever a later stratum enters returns to the first.

Every site of a generic can reach every method of it. Between them stands a hub for each generic and class: reach and paths go through hubs,
and an edge for each pair is only made by who reads ``edges``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.operators import graph, policy, report, resolve
from provena.plans.storage import counted, cut
from provena.schemas import with_all

#: Calls that load, attach or query a namespace named by a literal.
LOADS = ("requireNamespace", "loadNamespace", "asNamespace", "getNamespace", "packageVersion")
ATTACHES = ("library", "require", "attachNamespace")
HOOKS = (".onLoad",)


def node_id(kind: str, package: Column, name: Column | None = None) -> Column:
    """Semantic identity of a node; stable under any order of work."""
    if kind in ("package", "activation", "missing"):
        return F.concat(F.lit(f"{kind}:"), package)
    return F.concat(F.lit(f"{kind}:"), package, F.lit("/" if kind == "resource" else "::"), name)


@dataclass
class Options:
    root: str
    linked: list[str] = field(default_factory=list)
    external: list[str] = field(default_factory=list)


@dataclass
class Analysis:
    """``edges`` has all edges between ``nodes``; ``plain`` those that no dispatch makes, ``hubs`` the rest as (``node, hub``) and
    (``hub, dst``). ``edges`` and ``blockers`` are found when they are asked for."""

    nodes: DataFrame
    plain: DataFrame
    hubs: tuple[DataFrame, DataFrame]
    roots: DataFrame
    packages: DataFrame
    unreached_external: DataFrame
    find_edges: Callable[[], DataFrame]
    find_blockers: Callable[[], DataFrame]

    @cached_property
    def edges(self) -> DataFrame:
        return self.find_edges()

    @cached_property
    def blockers(self) -> DataFrame:
        return cut(self.find_blockers(), "blockers")


def _edge(src: Column, dst: Column, kind: str, reason: str, source: Column | None = None) -> list[Column]:
    span = [F.col("start"), F.col("end")] if source is not None else [F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")]
    return [src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), (source if source is not None else F.lit(None).cast("string")).alias("source"), *span]


def _blocker(code: str, message: Column, binding: Column, source: Column | None = None) -> list[Column]:
    span = [F.col("start"), F.col("end")] if source is not None else [F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")]
    return [F.col("package"), F.lit(code).alias("code"), binding.alias("binding"), message.alias("message"), (source if source is not None else F.lit(None).cast("string")).alias("source"), *span]


def analyze(spark: SparkSession, tables: dict[str, DataFrame], options: Options) -> Analysis:
    t = with_all(spark, tables)
    packages = cut(resolve.roles(t["packages"], options.root, options.external), "packages")
    role = packages.select(F.col("name").alias("target"), "role")
    # a guard prunes what needs a package that is absent, or optional and not selected
    declared = policy.declared(t["relations"], t["imports"])
    guards = policy.guard_states(declared, packages, [*options.linked, *options.external])

    def active(facts: DataFrame) -> DataFrame:
        pruned = guards.where("state <> 'active'").select("package", "guard")
        return facts.where("guard is null").unionByName(facts.where("guard is not null").join(pruned, ["package", "guard"], "left_anti").select(facts.columns))

    exports = cut(resolve.expand_exports(t["export_patterns"], t["bindings"].select("package", "name"), t["exports"]), "exports")
    names = t["bindings"].select("package", "name")
    own_id = lambda: node_id("binding", F.col("package"), F.col("source_key"))
    source = F.concat_ws("::", "package", "source_key")

    # references by priority: own namespace, imports from the last back, base
    refs = active(t["name_refs"]).withColumn("use", F.concat_ws("|", "package", "source_key", "name", "start", "end"))
    imported = cut(resolve.import_all(t["imports"], exports), "imported")
    looked = resolve.import_lookup(refs.select("package", "name").distinct(), imported)
    own = names.withColumn("own", F.lit(True)).distinct()
    r = refs.join(own, ["package", "name"], "left").join(looked, ["package", "name"], "left").join(t["base_bindings"].withColumn("base", F.lit(True)).distinct(), "name", "left")
    r = cut(r.withColumn("found", F.when(F.col("own"), "own").when(F.col("state") == "imported", "imported").when(F.col("state") == "unknown", "unknown").when(F.col("base"), "base").otherwise("none")), "resolved")
    remote = exports.select(F.col("package").alias("from_pkg"), F.col("export").alias("remote"), "binding")
    via = r.where("found = 'imported'").join(remote, ["from_pkg", "remote"], "left").withColumn("target", F.col("from_pkg")).join(role, "target", "left")
    target = F.when(F.col("role") == "External", node_id("external", F.col("from_pkg"), F.col("remote"))).when(F.col("role").isNull(), node_id("missing", F.col("from_pkg"))).otherwise(node_id("binding", F.col("from_pkg"), F.coalesce("binding", "remote")))
    possible = [
        r.where("found = 'own'").select(*_edge(own_id(), node_id("binding", F.col("package"), F.col("name")), "NameReference", "names a binding", source)),
        via.select(*_edge(own_id(), target, "ImportReference", "names an import", source)),
    ]
    # qualified access and namespace calls
    q = active(t["package_refs"]).join(role, "target", "left").join(exports.toDF("target", "name", "binding"), ["target", "name"], "left")
    q = q.join(t["data_sets"].select(F.col("package").alias("target"), F.explode("objects").alias("name")).distinct().withColumn("data", F.lit(True)), ["target", "name"], "left")
    q = cut(q.join(names.toDF("target", "name").distinct().withColumn("internal", F.lit(True)), ["target", "name"], "left"), "qualified")
    access = F.when(F.col("role").isNull(), node_id("missing", F.col("target"))).when(F.col("role") == "External", node_id("external", F.col("target"), F.col("name"))).when(F.col("binding").isNotNull() | F.col("internal"), node_id("binding", F.col("target"), F.coalesce("binding", "name"))).when(F.col("data"), node_id("dataset", F.col("target"), F.col("name")))
    possible.append(q.where(access.isNotNull()).select(*_edge(own_id(), access, "QualifiedReference", "qualified access", source)))
    loads = active(t["calls"]).where(F.col("callee").isin(*LOADS) & F.col("literal").isNotNull()).withColumn("target", F.col("literal")).join(role, "target", "left")
    # asking for a package that is absent and only suggested demands nothing
    suggested = declared.where("kind = 'suggested'").select("package", F.col("dep").alias("target"), F.lit(True).alias("may_lack"))
    loads = loads.join(suggested, ["package", "target"], "left").where("role is not null or may_lack is null").drop("may_lack")
    loaded = F.when(F.col("role").isNull(), node_id("missing", F.col("target"))).when(F.col("role") == "External", node_id("package", F.col("target"))).otherwise(node_id("activation", F.col("target")))
    possible.append(loads.select(*_edge(own_id(), loaded, "NamespaceCall", "loads a namespace", source)))
    files = t["files"].withColumnRenamed("path", "literal").withColumn("there", F.lit(True)).distinct()
    asked = active(t["calls"]).where("callee = 'system.file' and literal is not null").join(files, ["package", "literal"], "left")
    possible.append(asked.where("there").select(*_edge(own_id(), node_id("resource", F.col("package"), F.col("literal")), "ResourceAccess", "reads a resource", source)))
    # a binding activates its namespace; a namespace its imports, hooks and native components
    possible.append(names.distinct().select(*_edge(node_id("binding", F.col("package"), F.col("name")), node_id("activation", F.col("package")), "Activation", "activates its namespace")))
    possible.append(t["data_sets"].select("package", F.explode("objects").alias("name")).distinct().select(*_edge(node_id("dataset", F.col("package"), F.col("name")), node_id("activation", F.col("package")), "Activation", "activates its namespace")))
    imports = t["imports"].select("package", F.col("from_pkg").alias("target")).distinct().join(role, "target", "left")
    possible.append(imports.select(*_edge(node_id("activation", F.col("package")), loaded, "Import", "imports a namespace")))
    possible.append(names.where(F.col("name").isin(*HOOKS)).select(*_edge(node_id("activation", F.col("package")), node_id("binding", F.col("package"), F.col("name")), "Lifecycle", "runs a hook")))
    possible.append(t["natives"].select("package", "component").distinct().select(*_edge(node_id("activation", F.col("package")), node_id("native", F.col("package"), F.col("component")), "Native", "loads a component")))
    edges = possible[0]
    for more in possible[1:]:
        edges = edges.unionByName(more)
    edges = cut(edges.distinct(), "possible")

    exported = exports.where(F.col("package") == options.root)
    roots = exported.select(node_id("binding", F.col("package"), F.col("binding")).alias("node"), F.lit("ExportRoot").alias("reason")).distinct()
    roots = cut(roots.unionByName(spark.range(1).select(F.lit(f"package:{options.root}").alias("node"), F.lit("PackageRoot").alias("reason"))), "roots")
    start = roots.select("node").union(spark.range(1).select(F.lit(f"activation:{options.root}"))).distinct()
    edges = edges.unionByName(spark.range(1).select(*_edge(F.lit(f"package:{options.root}"), F.lit(f"activation:{options.root}"), "Activation", "root package")))

    # strata: reach; methods of reached generics; methods of dispatches with unknown classes
    observed = t["generics"].select(node_id("binding", F.col("package"), F.col("source_key")).alias("site"), "generic", "classes")
    methods = cut(t["s3"].select(node_id("activation", F.col("package")).alias("home"), node_id("binding", F.col("package"), F.col("method")).alias("dst"), "generic", "class"), "methods")
    base_generic = t["base_bindings"].select(F.col("name").alias("generic")).distinct()
    exactly, openly = F.concat_ws("\0", F.lit("="), "generic", "class").alias("hub"), F.concat_ws("\0", F.lit("*"), "generic").alias("hub")
    known = observed.where("classes is not null")
    known = known.select("site", "generic", F.explode("classes").alias("class")).union(known.select("site", "generic", F.lit("default")))
    into = cut(known.select(F.col("site").alias("node"), exactly, F.lit("Dispatch").alias("kind")).union(observed.where("classes is null").select("site", openly, F.lit("OpenDispatch"))).distinct(), "into")

    def dispatched(reached: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Hubs of reached sites, reached methods of hubs, and edges of registrations."""
        there = methods.join(reached, methods.home == reached.node, "left_semi")
        out = there.select(exactly, "dst").union(there.select(openly, "dst")).distinct()
        base = there.join(base_generic, "generic", "left_semi").select(*_edge(F.col("home"), F.col("dst"), "Registration", "registers a method of a base generic")).distinct()
        return into.join(reached, "node", "left_semi"), out, base

    reached = cut(graph.reach(edges, start), "reached")
    while True:
        sites, out, base = dispatched(reached)
        # only what methods lead to is new
        wanted = out.join(sites.select("hub").distinct(), "hub", "left_semi").select(F.col("dst").alias("node")).union(base.select("dst"))
        entered, n = counted(wanted.distinct().join(reached, "node", "left_anti"), "dispatch")
        if not n:
            break
        reached = cut(reached.union(graph.reach(edges, entered)).distinct(), "reached")
    sites, out = cut(sites, "sites"), cut(out.join(sites.select("hub").distinct(), "hub", "left_semi"), "methods")
    plain = cut(edges.join(reached, edges.src == reached.node, "left_semi").unionByName(base), "edges")

    def find_edges() -> DataFrame:
        """Plain edges, and an edge for each pair of reached site and method."""
        # sites of known and of unknown classes have hubs of their own
        made = [graph.pairs(sites.where(F.col("kind") == kind).select("node", "hub"), out.where(F.col("hub").startswith(mark))).select(*_edge(F.col("node"), F.col("dst"), kind, reason)) for kind, mark, reason in (("Dispatch", "=", "dispatches to a method"), ("OpenDispatch", "*", "classes are unknown"))]
        return plain.unionByName(made[0]).unionByName(made[1])

    parts = F.regexp_extract("node", "^[a-z]+:([^:/]+)", 1)
    nodes = reached.select("node", parts.alias("package"), F.initcap(F.split_part("node", F.lit(":"), F.lit(1))).alias("kind"), F.nullif(F.regexp_extract("node", "^[a-z]+:[^:/]+(?:::|/)(.*)$", 1), F.lit("")).alias("name"))

    def find_blockers() -> DataFrame:
        """Blockers of reached code."""
        live = reached.where("node like 'binding:%'")
        of = lambda facts: facts.join(live, own_id() == live.node, "left_semi")
        free = r.where("found in ('none', 'unknown')")
        created = resolve.matching_creator(of(free).select("use", F.col("package").alias("scope"), "name").distinct(), of(t["creators"]).select(F.concat_ws("::", "package", "source_key").alias("creator"), F.col("package").alias("scope"), "created"))
        unresolved = of(free).join(created.where("creator is not null").select("use"), "use", "left_anti")
        message = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
        found = [
            unresolved.select(*_blocker("UnresolvedName", message("cannot resolve ", F.col("name")), F.col("source_key"), source)),
            of(free).join(created.where("creator is not null"), ["use", "name"]).select(*_blocker("DynamicName", message("may be created by ", F.col("creator")), F.col("source_key"), source)),
            of(q).where(F.col("role").isNull()).select(*_blocker("MissingDependency", message("package ", F.col("target"), " is not installed"), F.col("source_key"), source)),
            of(q).where(F.col("role").isNotNull() & access.isNull()).select(*_blocker("MissingExport", message(F.col("target"), " does not export ", F.col("name")), F.col("source_key"), source)),
            of(loads).where(F.col("role").isNull()).select(*_blocker("MissingDependency", message("package ", F.col("target"), " is not installed"), F.col("source_key"), source)),
            of(active(t["calls"])).where(F.col("callee").isin(*LOADS) & F.col("literal").isNull()).select(*_blocker("DynamicNamespace", message(F.col("callee"), " of a computed name"), F.col("source_key"), source)),
            of(active(t["calls"])).where(F.col("callee").isin(*ATTACHES)).select(*_blocker("Attachment", message(F.col("callee"), " changes the search path"), F.col("source_key"), source)),
            of(asked).where(F.col("there").isNull()).select(*_blocker("MissingResource", message("no file ", F.col("literal")), F.col("source_key"), source)),
            of(t["issues"].withColumn("source_key", F.col("binding"))).select(F.col("package"), F.col("code"), F.col("binding"), F.col("message"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end")),
            t["natives"].where("safety not in ('safe', 'declared')").join(reached, node_id("native", F.col("package"), F.col("component")) == F.col("node"), "left_semi").select(*_blocker("UnsafeNative", message("component ", F.col("component"), " may call back"), F.lit(None).cast("string"))),
        ]
        blockers = found[0]
        for more in found[1:]:
            blockers = blockers.unionByName(more)
        return report.first_diagnostics(blockers, ["package", "binding", "code", "message"], ["source", "start", "end"])

    retained = nodes.select(F.col("package").alias("name")).distinct()
    unreached = spark.createDataFrame([(x,) for x in sorted(options.external)], "name string").join(retained, "name", "left_anti")
    return Analysis(nodes, plain, (sites.select("node", "hub"), out), roots, packages.join(retained, "name", "left_semi"), unreached, find_edges, find_blockers)
