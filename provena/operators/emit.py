"""Ordered text outputs: sections of lines joined in an explicit order, description rewriting, build reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import scalar

#: Fields of a description that a build writes itself and a source must not bring along.
BUILT_FIELDS = ("Collate", "Collate.unix", "Collate.windows", "Packaged", "Repository", "Date/Publication", "MD5sum", "Built")


def text(lines: DataFrame, key: list[str]) -> DataFrame:
    """``lines`` has ``key``, ``section``, ``ord``, ``line``; one text per key, in order of section, then place, then line."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "ord", "line")))
    return lines.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def namespace_lines(exports: DataFrame, imports: DataFrame, natives: DataFrame, s3: DataFrame) -> DataFrame:
    """Lines of a namespace declaration: exports, imports in their order, libraries, method registrations."""
    line = lambda df, section, order, made: df.select("package", F.lit(section).alias("section"), order.cast("long").alias("ord"), made.alias("line"))
    q = scalar.quoted
    zero = F.lit(0)
    named = F.transform("names", lambda n: F.when(n["local"] == n["remote"], q(n["remote"])).otherwise(F.concat(q(n["local"]), F.lit(" = "), q(n["remote"]))))
    every = F.when(F.col("kind") == "all", F.concat(F.lit("import("), q(F.col("from_pkg")), F.lit(")"))).otherwise(F.concat(F.lit("importFrom("), F.concat_ws(", ", q(F.col("from_pkg")), F.array_join(named, ", ")), F.lit(")")))
    return (
        line(exports.select("package", "export").distinct(), 1, zero, F.concat(F.lit("export("), q(F.col("export")), F.lit(")")))
        .unionByName(line(imports, 2, F.col("pos"), every))
        .unionByName(line(natives.select("package", "component").distinct(), 3, zero, F.concat(F.lit("useDynLib("), q(F.col("component")), F.lit(")"))))
        .unionByName(line(s3, 4, zero, F.concat(F.lit("S3method("), F.concat_ws(", ", q(F.col("generic")), q(F.col("class")), q(F.col("method"))), F.lit(")"))))
    )


def s3_matrix(s3: DataFrame) -> DataFrame:
    """Column-major cells of each package's registrations, in order of generic, class and method."""
    rows = F.array_sort(F.collect_list(F.struct("generic", "class", "method", F.coalesce("generic_pkg", F.lit("")).alias("home"))))
    columns = [F.col("r")[c] for c in ("generic", "class", "method", "home")]
    return s3.groupBy("package").agg(rows.alias("r")).select("package", F.size("r").alias("rows"), F.concat(*columns).alias("cells"))


def description(fields: DataFrame, roles: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rewritten ``package, field, value`` rows and the problems. A Linked package in Depends or LinkingTo is a problem, as is one of
    those fields that does not parse; in Suggests it goes. Imports are set anew (``package, text``); fields that an installation writes,
    and lists of files that the output no longer has, are left out."""
    deps = fields.where("field in ('Depends', 'LinkingTo', 'Suggests')").select("package", "field", F.posexplode(F.split("value", r"\s*,\s*")).alias("pos", "text")).withColumn("r", scalar.relation(F.col("text")))
    deps = deps.join(roles.where("role = 'Linked'").select(F.col("name").alias("dep"), F.lit(True).alias("linked")), F.col("r.package") == F.col("dep"), "left")
    problems = deps.where("(r is null and trim(text) <> '') or (linked and field <> 'Suggests')").select("package", "field", F.when(F.col("linked"), F.concat(F.lit("names the linked package "), "dep")).otherwise(F.concat(F.lit("cannot be read: "), "text")).alias("problem"))
    kept = deps.where("field = 'Suggests' and r is not null and linked is null")
    suggests = kept.groupBy("package", "field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), ", ").alias("value"))
    own = imports.groupBy("package").agg(F.array_join(F.array_sort(F.collect_set("text")), ", ").alias("value")).select("package", F.lit("Imports").alias("field"), "value")
    rest = fields.where(~F.col("field").isin(*BUILT_FIELDS, "Imports", "Suggests"))
    return rest.unionByName(suggests).unionByName(own), problems


def binding_reference(package: Column, name: Column, exported_external: Column) -> Column:
    """Text that reads a binding where it lives: an exported one of an External package as such, others from their namespace."""
    q = scalar.quoted
    inner = F.concat(F.lit("base::get("), q(name), F.lit(", envir = base::asNamespace("), q(package), F.lit("), inherits = FALSE)"))
    return F.when(exported_external, F.concat(F.lit("base::getExportedValue("), q(package), F.lit(", "), q(name), F.lit(")"))).otherwise(inner)


def imports_info(records: DataFrame) -> DataFrame:
    """``package, text``: the import table of a namespace as text, base first, then each directive (``pos, from_pkg, names``) in order."""
    q = scalar.quoted
    part = lambda field: F.array_join(F.transform("names", lambda n: q(n[field])), ", ")
    entry = F.concat(q(F.col("from_pkg")), F.lit(" = structure(as.character(c("), part("remote"), F.lit(")), names = as.character(c("), part("local"), F.lit(")))"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("pos", entry.alias("entry")))), lambda x: x["entry"])
    return records.groupBy("package").agg(F.concat(F.lit("list("), F.array_join(F.concat(F.array(F.lit("base = TRUE")), rows), ", "), F.lit(")")).alias("text"))


def activation_lines(activations: DataFrame, natives: DataFrame, slots: DataFrame, closures: DataFrame) -> DataFrame:
    """Lines ``package, section, ord, line`` that bring up each namespace, in the order that it needs: the namespace itself, its native
    components, its import slots (``state`` Bound or Removed), its closures, and the switch that seals it. ``activations`` has
    ``package, version, hook``."""
    q = scalar.quoted
    line = lambda df, section, made: df.select("package", F.lit(section).alias("section"), F.lit(0).cast("long").alias("ord"), made.alias("line"))
    bound = F.concat(F.lit("  assign("), q(F.col("local")), F.lit(", "), binding_reference(F.col("from_pkg"), F.col("remote"), F.col("external")), F.lit(", envir = imports)"))
    gone = F.concat(F.lit("  removed(imports, "), q(F.col("local")), F.lit(", "), q(F.concat_ws("::", "from_pkg", "remote")), F.lit(")"))
    return (
        line(activations, 1, F.concat(F.lit("ns <- new_namespace("), q(F.col("package")), F.lit(", "), q(F.col("version")), F.lit(")")))
        .unionByName(line(natives.select("package", "component").distinct(), 2, F.concat(F.lit("  load_native(ns, "), q(F.col("component")), F.lit(")"))))
        .unionByName(line(slots, 3, F.when(F.col("state") == "Bound", bound).otherwise(gone)))
        .unionByName(line(closures, 4, F.concat(F.lit("  eval(parse(text = "), q(F.col("source")), F.lit("), envir = ns)"))))
        .unionByName(line(activations, 5, F.concat(F.lit("activate(ns, "), F.when(F.col("hook"), "TRUE").otherwise("FALSE"), F.lit(")"))))
    )


def bootstrap(activations: DataFrame, order: DataFrame) -> DataFrame:
    """One ``text``: namespaces are made first, then activated (``package, text``), both in activation order (``package, position``)."""
    rows = activations.join(order, "package").agg(F.array_sort(F.collect_list(F.struct("position", "package", "text"))).alias("rows"))
    made = F.transform("rows", lambda x: F.concat(F.lit("  namespaces[["), scalar.quoted(x["package"]), F.lit("]] <- empty()")))
    inner = F.transform("rows", lambda x: F.concat(F.lit("  local({\n"), x["text"], F.lit("\n  })")))
    return rows.select(F.array_join(F.concat(F.array(F.lit("bootstrap <- function(root) {")), made, inner, F.array(F.lit("}"))), "\n").alias("text"))


def build_report(blockers: DataFrame) -> DataFrame:
    """``code, n, text``: distinct blockers grouped by code, their messages sorted."""
    return blockers.select("code", "package", "binding", "message").distinct().groupBy("code").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.concat_ws("::", "package", "binding"), "message"))), "\n").alias("text")).orderBy("code")
