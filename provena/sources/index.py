"""Decoding package indexes from JSON rows into the fact tables, and their integrity checks as violation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar

SCHEMA = "name string, version string, fingerprint string, priority string, exports map<string,string>, export_patterns array<string>, imports array<struct<package:string,except:array<string>,names:array<struct<local:string,remote:string>>>>, s3 array<struct<generic_pkg:string,generic:string,class:string,method:string>>, natives array<struct<component:string,alias:string,prefix:string,suffix:string,safety:string,symbols:array<string>,routines:array<struct<table:string,name:string,arity:int>>>>, data_sets map<string,array<string>>, bindings array<string>"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def decode(index: DataFrame) -> dict[str, DataFrame]:
    """Child tables of indexes. Order within imports is significant and kept as ``pos``."""
    p = F.col("name").alias("package")
    imports = index.select(p, F.posexplode("imports").alias("pos", "i"))
    kind = F.when(F.col("i.names").isNull(), "all").otherwise("from")
    names = F.transform("i.names", lambda n: F.struct(scalar.labelled(n["local"], n["remote"]).alias("local"), n["remote"].alias("remote")))
    natives = index.select(p, F.explode("natives").alias("n"))
    symbols = natives.select("package", F.col("n.component").alias("component"), F.explode("n.symbols").alias("symbol"), F.col("n.safety").alias("safety"))
    routines = natives.select("package", F.col("n.component").alias("component"), F.explode("n.routines").alias("r"), F.col("n.prefix").alias("prefix"), F.col("n.suffix").alias("suffix"), F.col("n.safety").alias("safety"))
    named = routines.select("package", "component", F.concat(F.coalesce("prefix", F.lit("")), "r.name", F.coalesce("suffix", F.lit(""))).alias("symbol"), "safety")
    return {
        "packages": index.select("name", "version", F.col("fingerprint").alias("fp"), "priority", F.lit(False).alias("root_flag")),
        "exports": index.select(p, F.explode("exports").alias("label", "binding")).select("package", scalar.labelled(F.col("label"), F.col("binding")).alias("export"), "binding"),
        "export_patterns": index.select(p, F.explode("export_patterns").alias("pattern")),
        "imports": imports.select("package", "pos", kind.alias("kind"), F.col("i.package").alias("from_pkg"), F.col("i.except").alias("except"), names.alias("names")),
        "s3": index.select(p, F.explode("s3").alias("s")).select("package", "s.generic_pkg", "s.generic", "s.class", "s.method"),
        "natives": symbols.unionByName(named).distinct(),
        "routines": routines.select("package", "component", F.col("r.table").alias("table"), F.col("r.name").alias("name"), F.col("r.arity").alias("arity")),
        "data_sets": index.select(p, F.explode("data_sets").alias("set", "objects")),
    }


def members(objects: DataFrame) -> DataFrame:
    """Member table ``object, member, parent, depth`` below each root object by levels; a member comes once."""
    from provena.plans.fixpoint import fixpoint

    tops = objects.where("parent is null").select("object", F.col("object").alias("member"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    right = objects.where("parent is not null").select(F.col("object").alias("child"), F.col("parent").alias("up"))
    step = lambda delta, done: delta.join(right, F.col("member") == F.col("up")).select("object", F.col("child").alias("member"), F.col("up").alias("parent"), (F.col("depth") + 1).alias("depth"))
    return fixpoint(tops, [step], ["object", "member"], first=["depth"])


def not_passive(found: DataFrame, kinds: DataFrame, passive: list[str]) -> DataFrame:
    """Members of data objects that are no plain data."""
    return found.join(kinds.select(F.col("object").alias("member"), "kind"), "member").where(~F.col("kind").isin(*passive))


def violations(index: DataFrame, expected: DataFrame) -> DataFrame:
    """Indexes whose identity differs from what was located, or that come twice."""
    e = expected.select("name", F.col("version").alias("v"), F.col("fingerprint").alias("f"))
    wrong = index.join(e, "name", "left").where("v is null or v <> version or f <> fingerprint").select("name", F.lit("identity differs").alias("problem"))
    twice = index.groupBy("name").count().where("count > 1").select("name", F.lit("indexed twice").alias("problem"))
    return wrong.unionByName(twice)


MANIFEST = "schema int, packages array<struct<name:string,version:string,fingerprint:string,components:array<struct<component:string,safety:string,routines:array<struct<selector:string,callback_arguments:array<int>>>>>>>"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``name, version, fingerprint, component, safety, selector, callbacks`` of a native summary manifest of schema 1."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).json(path).where("schema = 1").select(F.explode("packages").alias("p"))
    rows = rows.select("p.name", "p.version", "p.fingerprint", F.explode("p.components").alias("c"))
    return rows.select("name", "version", "fingerprint", "c.component", "c.safety", F.explode_outer("c.routines").alias("r")).select("name", "version", "fingerprint", "component", "safety", F.col("r.selector").alias("selector"), F.col("r.callback_arguments").alias("callbacks"))


def manifest_violations(rows: DataFrame) -> DataFrame:
    """Selectors that come twice, and callback positions below one."""
    twice = rows.where("selector is not null").groupBy("name", "version", "fingerprint", "component", "selector").count().where("count > 1").select("name", "component", F.lit("selector comes twice").alias("problem"))
    zero = rows.where(F.exists("callbacks", lambda x: x < 1)).select("name", "component", F.lit("callback positions count from one").alias("problem"))
    return twice.unionByName(zero)


def apply_manifest(natives: DataFrame, packages: DataFrame, rows: DataFrame) -> DataFrame:
    """An exact identity overrides a component's safety."""
    said = rows.select("name", "version", F.col("fingerprint").alias("fp"), "component", F.col("safety").alias("said")).distinct()
    exact = packages.join(said, ["name", "version", "fp"]).select(F.col("name").alias("package"), "component", "said")
    return natives.join(exact, ["package", "component"], "left").withColumn("safety", F.coalesce("said", "safety")).drop("said")
