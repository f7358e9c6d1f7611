"""Planned rewrites of code spans: replacement texts by kind of target, admission of spans, and the rewritten sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import scalar
from provena.operators import spans

#: Kinds that read the installation of a package which a build removes.
REMOVED = ("resource_access", "package_version", "description_argument")


def _namespace(package: Column) -> Column:
    return F.concat(F.lit("base::asNamespace("), scalar.quoted(package), F.lit(")"))


def _carried(folder: str, root: str, *parts: Column) -> Column:
    inner = F.concat_ws(", ", scalar.quoted(F.lit(folder)), *[scalar.quoted(p) for p in parts])
    return F.concat(F.lit("base::system.file("), inner, F.lit(", package = "), scalar.quoted(F.lit(root)), F.lit(")"))


def replacement(root: str) -> Column:
    """Text for a row with ``kind``, ``package``, ``name``, ``component``, ``table`` and ``flag``; what a kind does not use is null."""
    package, name, component = F.col("package"), F.col("name"), F.col("component")
    library = F.concat(F.lit("base::getLoadedDLLs()[["), scalar.quoted(component), F.lit("]]"))
    exported = F.concat(F.lit("base::getExportedValue("), _namespace(package), F.lit(", "), scalar.quoted(name), F.lit(")"))
    texts = {
        "binding": exported,
        "dataset": exported,
        "internal_binding": F.concat(F.lit("base::get("), scalar.quoted(name), F.lit(", envir = "), _namespace(package), F.lit(", inherits = FALSE)")),
        "require_namespace": F.when(F.col("flag"), "base::invisible(TRUE)").otherwise("base::invisible(FALSE)"),
        "namespace": _namespace(package),
        "namespace_argument": _namespace(package),
        "loaded_query": F.lit("TRUE"),
        "installed_query": F.when(F.col("flag"), "base::invisible(NULL)").otherwise("TRUE"),
        "native_symbol": F.concat(F.lit("base::getDLLRegisteredRoutines("), library, F.lit(")[["), scalar.quoted(F.col("table")), F.lit("]][["), scalar.quoted(name), F.lit("]]")),
        "native_library": library,
        "description_argument": F.concat(scalar.quoted(package), F.lit(", lib.loc = "), _carried("resources", root)),
        "data_argument": F.concat(scalar.quoted(package), F.lit(", lib.loc = "), _carried("datalib", root)),
        "package_version": F.concat(F.lit("base::package_version("), scalar.quoted(name), F.lit(")")),
        "absent_resource": F.lit('""'),
        "resource": _carried("resources", root, package, name),
    }
    out = F.lit(None).cast("string")
    for kind, text in texts.items():
        out = F.when(F.col("kind") == kind, text).otherwise(out)
    return out


def rejected(plans: DataFrame, sources: DataFrame, carried: DataFrame) -> DataFrame:
    """``source, start, end, problem``: spans outside their source, overlapping ones, datasets that are not carried."""
    size = sources.select("source", F.octet_length("text").alias("size"))
    outside = plans.join(size, "source", "left").where("size is null or end > size or start > end").select("source", "start", "end", F.lit("outside its code").alias("problem"))
    overlap = spans.misplaced(plans.select("source", "start", "end")).select("source", "start", "end", F.lit("overlaps another").alias("problem"))
    missing = plans.where("kind = 'dataset'").join(carried.select("package", "name"), ["package", "name"], "left_anti").select("source", "start", "end", F.lit("names a dataset that is not carried").alias("problem"))
    return outside.unionByName(overlap).unionByName(missing)


def rewritten(plans: DataFrame, sources: DataFrame, root: str) -> DataFrame:
    """``source, text`` after all replacements; null where spans are not admissible."""
    edits = plans.withColumn("new", replacement(root)).groupBy("source").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("new").alias("text"))).alias("edits"))
    rows = sources.join(edits, "source", "left")
    return rows.select("source", scalar.splice("text", F.coalesce("edits", F.array().cast("array<struct<start:int,end:int,text:string>>"))).alias("text"))


def needed(plans: DataFrame, roles: DataFrame) -> DataFrame:
    """Rewrites that must happen: those that read a removed installation, or name a linked package."""
    linked = roles.where("role = 'Linked'").select(F.col("name").alias("package"), F.lit(True).alias("linked"))
    return plans.join(linked, "package", "left").where(F.col("kind").isin(*REMOVED) | F.col("linked")).drop("linked")
