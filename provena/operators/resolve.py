"""Name resolution as joins with an explicit priority: the first source that has a name wins, and no row order is relied on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.graph import first_by
from provena.plans.fixpoint import fixpoint
from provena.plans.storage import cut

#: Names that import-all never brings in.
NOT_IMPORTED = (".__NAMESPACE__.", ".__S3MethodsTable__.", ".packageName", ".First.lib", ".Last.lib", ".onLoad", ".onAttach", ".onDetach", ".conflicts.OK", ".noGenerics")


def cascade(uses: DataFrame, sources: list[tuple[str, DataFrame]], keys: list[str], carry: list[str] = ("target",)) -> DataFrame:
    """Each use with the ``carry`` columns of the first source that matches its ``keys``, and ``found_in``, that source's name (null:
    unresolved). One union and one equi join, however many sources."""
    union = None
    for rank, (name, rows) in enumerate(sources):
        own = rows.select(*keys, *carry, F.lit(rank).alias("__rank"), F.lit(name).alias("found_in"))
        union = own if union is None else union.unionByName(own)
    best = union.groupBy(*keys).agg(F.min(F.struct("__rank", *carry, "found_in")).alias("__best"))
    return uses.join(best, keys, "left").select(*uses.columns, *[F.col(f"__best.{c}").alias(c) for c in carry], F.col("__best.found_in").alias("found_in"))


def ancestors(parents: DataFrame) -> DataFrame:
    """``scope, ancestor, depth`` of a ``scope, parent`` table, each scope at depth 0; cycles end, as an ancestor comes once."""
    p = cut(parents.where("parent is not null").select("scope", "parent").distinct(), "parents")
    seed = parents.select("scope", F.col("scope").alias("ancestor"), F.lit(0).alias("depth")).union(p.select("parent", "parent", F.lit(0))).distinct()
    right = p.select(F.col("scope").alias("s"), F.col("parent").alias("up"))
    step = lambda delta, done: delta.join(right, F.col("ancestor") == F.col("s")).select("scope", F.col("up").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(seed, [step], ["scope", "ancestor"], first=["depth"])


def nearest(uses: DataFrame, chain: DataFrame, names: DataFrame) -> DataFrame:
    """Lexical lookup: of a use's scope and its ancestors the nearest that has the name. ``uses`` has ``use, scope, name``; ``names`` has
    ``scope, name, target``."""
    own = uses.join(chain, "scope").join(names.withColumnRenamed("scope", "ancestor"), ["ancestor", "name"])
    best = own.groupBy("use").agg(F.min(F.struct("depth", "target", "ancestor")).alias("b"))
    return uses.join(best, "use", "left").select(*uses.columns, F.col("b.target").alias("target"), F.col("b.ancestor").alias("found_in"), F.col("b.depth").alias("depth"))


def last_wins(rows: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """A later binding of a name replaces an earlier one."""
    return first_by(rows, key, order, last=True)


def import_all(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Rows ``package, pos, name_pos, local, from_pkg, remote, known`` of all directives. Those that name their bindings have them in
    ``names``; import-all takes the exports of the package less ``except`` and the names that never come in. An import-all from a
    package whose exports are unknown is a row with null ``local``."""
    named = imports.where("kind = 'from'").select("package", "pos", "from_pkg", F.posexplode("names").alias("name_pos", "n")).select("package", "pos", "name_pos", F.col("n.local").alias("local"), "from_pkg", F.col("n.remote").alias("remote"), F.lit(True).alias("known"))
    every = imports.where("kind = 'all'").select("package", "pos", "from_pkg", F.coalesce("except", F.array().cast("array<string>")).alias("except"))
    some = every.join(exports.select(F.col("package").alias("from_pkg"), F.col("export").alias("remote")), "from_pkg", "left")
    some = some.where(F.col("remote").isNull() | ~(F.array_contains("except", F.col("remote")) | F.col("remote").isin(*NOT_IMPORTED)))
    return named.unionByName(some.select("package", "pos", F.lit(0).alias("name_pos"), F.col("remote").alias("local"), "from_pkg", "remote", F.col("remote").isNotNull().alias("known")))


def import_lookup(uses: DataFrame, imported: DataFrame) -> DataFrame:
    """Imports are searched from the last to the first; an import-all of unknown names ends the search as ``unknown``. ``uses`` has
    ``package, name`` and any columns. The last import of each name is found before uses are joined: a row of theirs stays one row."""
    direct = imported.where("local is not null").groupBy("package", F.col("local").alias("name")).agg(F.max(F.struct("pos", "name_pos", "from_pkg", "remote")).alias("hit"))
    wild = imported.where("not known").groupBy("package").agg(F.max("pos").alias("wild_pos"))
    out = uses.join(direct, ["package", "name"], "left").join(wild, "package", "left")
    stopped = F.col("wild_pos").isNotNull() & (F.col("hit").isNull() | (F.col("wild_pos") > F.col("hit.pos")))
    return out.select(*uses.columns, F.when(~stopped, F.col("hit.from_pkg")).alias("from_pkg"), F.when(~stopped, F.col("hit.remote")).alias("remote"), F.when(stopped, "unknown").when(F.col("hit").isNotNull(), "imported").otherwise("absent").alias("state"))


def expand_exports(patterns: DataFrame, names: DataFrame, listed: DataFrame) -> DataFrame:
    """``package, export, binding``: listed exports, and the names that match a package's export patterns."""
    found = names.join(patterns, "package").where(F.regexp_like("name", F.col("pattern"))).select("package", F.col("name").alias("export"), F.col("name").alias("binding"))
    return listed.select("package", "export", "binding").union(found).distinct()


def definitions(aliases: DataFrame) -> DataFrame:
    """Follows re-exports ``package, name -> to_package, to_name`` to where no alias leads on: ``package, name, def_package, def_name,
    hops``; names whose aliases only go in a circle have null definitions."""
    a = cut(aliases.select("package", "name", "to_package", "to_name").distinct(), "aliases")
    seed = a.select("package", "name", F.col("to_package").alias("def_package"), F.col("to_name").alias("def_name"), F.lit(1).alias("hops"))
    right = a.toDF("p", "n", "tp", "tn")
    step = lambda delta, done: delta.join(right, (F.col("def_package") == F.col("p")) & (F.col("def_name") == F.col("n"))).select("package", "name", F.col("tp").alias("def_package"), F.col("tn").alias("def_name"), (F.col("hops") + 1).alias("hops"))
    every = fixpoint(seed, [step], ["package", "name", "def_package", "def_name"], first=["hops"])
    ends = every.join(right, (F.col("def_package") == F.col("p")) & (F.col("def_name") == F.col("n")), "left_anti")
    best = ends.groupBy("package", "name").agg(F.min(F.struct("hops", "def_package", "def_name")).alias("b"))
    return a.select("package", "name").distinct().join(best, ["package", "name"], "left").select("package", "name", F.col("b.def_package").alias("def_package"), F.col("b.def_name").alias("def_name"), F.col("b.hops").alias("hops"))


def sole_owner(symbols: DataFrame) -> DataFrame:
    """``package, name, component``; null where several components have the name."""
    return symbols.groupBy("package", "name").agg(F.when(F.count_distinct("component") == 1, F.min("component")).alias("component"))


def matching_creator(names: DataFrame, creators: DataFrame) -> DataFrame:
    """Each free name with the least creator that can bind it: one of that name, or one that binds any name (null ``created``).
    ``names`` has ``use, scope, name``; ``creators`` has ``creator, scope, created``. The theta join is two equi joins."""
    least = creators.where("created is not null").groupBy("scope", F.col("created").alias("name")).agg(F.min("creator").alias("creator"))
    named = names.join(least, ["scope", "name"]).select("use", "creator")
    any_ = creators.where("created is null").groupBy("scope").agg(F.min("creator").alias("creator"))
    both = named.union(names.join(any_, "scope").select("use", "creator"))
    return names.join(both.groupBy("use").agg(F.min("creator").alias("creator")), "use", "left")


def roles(packages: DataFrame, root: str, external: list[str]) -> DataFrame:
    """``role``: Root, External (named or of base priority) or Linked."""
    return packages.withColumn("role", F.when(F.col("name") == root, "Root").when(F.col("name").isin(*external) | (F.col("priority") == "base"), "External").otherwise("Linked"))


def locate(libraries: DataFrame) -> DataFrame:
    """The first library that has a package wins: ``libraries`` has ``name, rank`` and any columns."""
    return first_by(libraries.where(F.col("version").isNotNull()), ["name"], ["rank"])


def frozen(requests: DataFrame, located: DataFrame) -> DataFrame:
    """Availability of every name ever asked for, misses included (null version): written once, read for the rest of the run."""
    return cut(requests.select("name").distinct().join(located, "name", "left"), "availability")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, with ``side``; none if nothing moved."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))
