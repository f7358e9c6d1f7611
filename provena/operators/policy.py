"""Decisions about packages, names and calls as joins of fact tables: what is declared, chosen, retained, removed, bound and when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions import scalar

#: Names that a rewritten root defines for itself; code that touches them would meet another value than before.
CHANGED_IN_ROOT = (".onLoad", ".provena_runtime", ".provena_root_on_load")
#: What a root folder holds besides resources that are copied. Fixed values.
NOT_COPIED = ("R", "src", "man", "data", "tests", "vignettes", "DESCRIPTION", "NAMESPACE", ".git", ".Rbuildignore", "build", "Meta")


def is_platform(priority: str | Column = "priority") -> Column:
    """Whether a package belongs to the platform itself."""
    return F.coalesce((F.col(priority) if isinstance(priority, str) else priority) == "base", F.lit(False))


def changed_in_root(name: str | Column) -> Column:
    return (F.col(name) if isinstance(name, str) else name).isin(*CHANGED_IN_ROOT)


def declared(relations: DataFrame, imports: DataFrame) -> DataFrame:
    """``package, dep, kind``: required (imported, or in Imports or Depends) or suggested (in Suggests and not required)."""
    required = relations.where("field in ('Imports', 'Depends')").select("package", "dep").union(imports.select("package", F.col("from_pkg").alias("dep"))).distinct()
    suggested = relations.where("field = 'Suggests'").select("package", "dep").distinct().join(required, ["package", "dep"], "left_anti")
    return required.withColumn("kind", F.lit("required")).unionByName(suggested.withColumn("kind", F.lit("suggested")))


def guard_states(dependencies: DataFrame, packages: DataFrame, chosen: list[str]) -> DataFrame:
    """``package, guard, state`` for guards on suggested packages (``declared``): absent, unselected or active."""
    there = packages.select(F.col("name").alias("guard"), F.lit(True).alias("there"))
    rows = dependencies.where("kind = 'suggested'").select("package", F.col("dep").alias("guard")).join(there, "guard", "left")
    return rows.select("package", "guard", F.when(F.col("there").isNull(), "absent").when(F.col("guard").isin(*chosen), "active").otherwise("unselected").alias("state"))


def established(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """``package, name``: namespaces that are loaded whenever a package's code runs, itself and what it imports."""
    return packages.select(F.col("name").alias("package"), "name").union(imports.select("package", "from_pkg")).distinct()


def discovered(calls: DataFrame, roles: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``calls`` (``call, package, target``) with ``state``: Computed (null target), Settled (the package itself or External), Linked,
    Optional (absent and only suggested) or Missing."""
    out = calls.join(roles.select(F.col("name").alias("target"), "role"), "target", "left").join(dependencies.select("package", F.col("dep").alias("target"), "kind"), ["package", "target"], "left")
    state = F.when(F.col("target").isNull(), "Computed").when(F.col("role").isNotNull(), F.when((F.col("target") == F.col("package")) | F.col("role").isin("External", "Root"), "Settled").otherwise("Linked")).when(F.col("kind") == "suggested", "Optional").otherwise("Missing")
    return out.select(*calls.columns, state.alias("state"))


def resource_accesses(calls: DataFrame, files: DataFrame) -> DataFrame:
    """``calls`` (``call, package, path, must_work``) with ``state``: deferred (computed path), invalid, present, fatal (absent and must
    work) or empty (absent: the empty string)."""
    out = calls.join(files.select("package", "path").distinct().withColumn("there", F.lit(True)), ["package", "path"], "left")
    state = F.when(F.col("path").isNull(), "deferred").when(~scalar.valid_resource_path(F.col("path")), "invalid").when(F.col("there"), "present").when(F.col("must_work"), "fatal").otherwise("empty")
    return out.select(*calls.columns, state.alias("state"))


def external_contracts(relations: DataFrame, roles: DataFrame) -> DataFrame:
    """``name, requirement, problem`` of each External package: the intersection of what packages that are not External ask of it, and
    whether that contradicts itself, is not met by its version, or was never declared. ``relations`` has ``package, dep, op, version``."""
    asked = relations.join(roles.where("role <> 'External'").select(F.col("name").alias("package")), "package", "left_semi")
    asked = asked.groupBy(F.col("dep").alias("name")).agg(*[c.alias(k) for k, c in scalar.bounds(F.col("op"), scalar.version(F.col("version"))).items()], F.count("*").alias("n"))
    lower, upper, exact, out = (F.col(c) for c in ("lower", "upper", "exact", "excluded"))
    rows = roles.where("role = 'External'").join(asked, "name", "left")
    v = scalar.version(F.col("version"))
    met = scalar.admits(v, lower, upper, out) & ((F.size(exact) == 0) | F.array_contains(exact, v))
    problem = F.when(F.col("n").isNull(), "undeclared").when(scalar.conflict(lower, upper, exact, out), "conflict").when(~met, "unsatisfied")
    return rows.select("name", F.coalesce(F.nullif(scalar.requirement_text(lower, upper, exact, out), F.lit("")), F.lit("any")).alias("requirement"), problem.alias("problem"))


def attached(slots: DataFrame, roles: DataFrame, retained: DataFrame) -> DataFrame:
    """Import slots (``package, local, from_pkg, remote``) with ``state``: Bound if the target is retained, Removed if its package is
    Linked; others are dropped."""
    kept = retained.select(F.col("package").alias("from_pkg"), F.col("name").alias("remote")).distinct().withColumn("kept", F.lit(True))
    out = slots.join(kept, ["from_pkg", "remote"], "left").join(roles.select(F.col("name").alias("from_pkg"), "role"), "from_pkg", "left")
    return out.withColumn("state", F.when(F.col("kept"), "Bound").when(F.col("role") == "Linked", "Removed")).where("state is not null").select(*slots.columns, "state")


def load_stages(imports: DataFrame, roles: DataFrame) -> DataFrame:
    """Imports (``local, from_pkg``) of the root with ``stage``: those of Linked packages can only be bound after their activation."""
    out = imports.join(roles.select(F.col("name").alias("from_pkg"), "role"), "from_pkg", "left")
    return out.select(*imports.columns, F.when(F.col("role") == "Linked", "after").otherwise("before").alias("stage"))


def retained_names(nodes: DataFrame) -> DataFrame:
    """``package, names``: the sorted names of each package that are demanded."""
    return nodes.groupBy("package").agg(F.array_sort(F.collect_set("name")).alias("names"))


def removed_names(indexed: DataFrame, retained: DataFrame) -> DataFrame:
    """``package, name`` of indexed names that nothing retains."""
    return indexed.select("package", "name").distinct().join(retained.select("package", "name"), ["package", "name"], "left_anti")


def retention_edges(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Distinct ``src, dst`` between packages: ``owner`` has ``node, package``."""
    a, b = owner.toDF("src", "a"), owner.toDF("dst", "b")
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def shadow_set(*names: DataFrame) -> DataFrame:
    """Distinct ``package, name`` that a package's code finds before base: indexed, created and native ones."""
    union = names[0].select("package", "name")
    for more in names[1:]:
        union = union.union(more.select("package", "name"))
    return union.distinct()


def visible(uses: DataFrame, chain: DataFrame, domains: DataFrame) -> DataFrame:
    """``use, domain``: declarations of the used binding (``scope, name, domain``) in the use's scope or an ancestor of it. ``chain`` has
    ``scope, ancestor``."""
    own = uses.join(chain.select("scope", "ancestor"), "scope")
    return own.join(domains.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"]).select("use", "domain").distinct()


def selected_methods(own: DataFrame, imported: DataFrame, wanted: Column) -> DataFrame:
    """Distinct ``package, home, binding``: own and imported names (``name``) that pass a predicate."""
    mine = own.where(wanted).select("package", F.col("package").alias("home"), F.col("name").alias("binding"))
    return mine.union(imported.where(wanted).select("package", F.col("from_pkg"), F.col("remote"))).distinct()


def bound_early(uses: DataFrame, closures: DataFrame, imports: DataFrame, roles: DataFrame) -> DataFrame:
    """``uses`` (``use, name``) with ``early``: the root has the name before it is set up, as a closure of its own, as an import from a
    package that is not Linked, or because nothing in it defines the name."""
    own = closures.select("name").distinct().withColumn("own", F.lit(True))
    slot = imports.join(roles.select(F.col("name").alias("from_pkg"), "role"), "from_pkg", "left").groupBy(F.col("local").alias("name")).agg(F.max(F.col("role") == "Linked").alias("linked"), F.count("*").alias("n"))
    out = uses.join(own, "name", "left").join(slot, "name", "left")
    return out.select(*uses.columns, (F.coalesce("own", F.lit(False)) | F.col("n").isNull() | ~F.coalesce("linked", F.lit(False))).alias("early"))


def native_summaries(selectors: DataFrame, summaries: DataFrame, aliases: DataFrame) -> DataFrame:
    """``use, summary``: the summary of a selector's routine, by its own name or by the binding that stands for it. Two equi joins."""
    direct = selectors.join(summaries, ["component", "selector"]).select("use", "summary")
    named = selectors.withColumnRenamed("selector", "binding").join(aliases, ["component", "binding"]).join(summaries, ["component", "selector"]).select("use", "summary")
    return direct.union(named).distinct()


def produced_and_used(uses: DataFrame, calls: DataFrame) -> DataFrame:
    """``uses`` (``producer, consumer, index``) with the callees of the call that makes a namespace and of the one it goes to."""
    a, b = calls.select(F.col("call").alias("producer"), F.col("callee").alias("made_by")), calls.select(F.col("call").alias("consumer"), F.col("callee").alias("goes_to"))
    return uses.join(a, "producer").join(b, "consumer", "left")


def unregistered(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """``calls`` (``call, package, binding``) that delegate to the next method from code that is no registered method."""
    return calls.join(methods.select("package", F.col("method").alias("binding")), ["package", "binding"], "left_anti")


def openings(registrations: DataFrame, generics: DataFrame) -> DataFrame:
    """Distinct ``generic, package``: generics (``generic, owner, classes``) that a method of an External package can answer: one of the
    same name, of the same owner if it names one, and of a class that reaches it (null classes: any)."""
    r = registrations.select("package", "generic", F.col("generic_pkg").alias("home"), "class")
    found = generics.join(r, "generic").where((F.col("home").isNull() | (F.col("home") == F.col("owner"))) & (F.col("classes").isNull() | F.array_contains("classes", F.col("class"))))
    return found.select("generic", "package").distinct()


def exported_blockers(blockers: DataFrame) -> DataFrame:
    """Blockers as they are shown, in order: missing dependencies are left out, the owner is the binding or else the package."""
    rows = blockers.where("code <> 'MissingDependency'").select(F.coalesce(F.concat_ws("::", "package", F.nullif("binding", F.lit(""))), "package").alias("owner"), "code", "message")
    return rows.orderBy("owner", "code", "message")


def batches(requests: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """Distinct requests of each group dealt to numbered batches of at most ``size``, in order of their keys."""
    once = requests.select(group, key).distinct()
    w = Window.partitionBy(group).orderBy(key)
    return once.select(group, key, F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("batch"))


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct ``package, name``: indexed names that a text of the package mentions, to be asked for ahead. ``texts`` has
    ``package, text``."""
    words = texts.select("package", F.explode(F.array_distinct(scalar.identifiers(F.col("text")))).alias("name")).distinct()
    return words.join(names.select("package", "name").distinct(), ["package", "name"])


def object_problems(objects: DataFrame) -> DataFrame:
    """``object, problem`` of an object table ``object, parent, kind``: parents that are not there, loops of one, objects that come twice."""
    own = objects.select(F.col("object").alias("parent"), F.lit(True).alias("there")).distinct()
    lost = objects.where("parent is not null and parent <> object").join(own, "parent", "left").where("there is null").select("object", F.lit("no such parent").alias("problem"))
    loop = objects.where("parent = object").select("object", F.lit("its own parent").alias("problem"))
    twice = objects.groupBy("object").count().where("count > 1").select("object", F.lit("comes twice").alias("problem"))
    return lost.unionByName(loop).unionByName(twice).distinct()
