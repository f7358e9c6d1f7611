"""Fixed schemas of the fact tables; readers never infer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = {
    "packages": "name string, version string, fp string, priority string, root_flag boolean",
    "relations": "package string, field string, dep string, op string, version string, pos int",
    "bindings": "package string, name string, kind string, source string, env string, has_attributes boolean",
    "exports": "package string, export string, binding string",
    "export_patterns": "package string, pattern string",
    "imports": "package string, pos int, kind string, from_pkg string, except array<string>, names array<struct<local:string,remote:string>>",
    "s3": "package string, generic_pkg string, generic string, class string, method string",
    "natives": "package string, component string, symbol string, safety string",
    "private_env": "package string, env string, parent string",
    "private_bindings": "package string, env string, name string, source string",
    "data_sets": "package string, set string, objects array<string>",
    "files": "package string, path string",
    "base_bindings": "name string",
    "issues": "package string, binding string, code string, message string",
    "name_refs": "package string, source_key string, name string, guard string, start long, end long",
    "package_refs": "package string, source_key string, target string, name string, guard string, start long, end long",
    "calls": "package string, source_key string, callee string, literal string, guard string, start long, end long",
    "creators": "package string, source_key string, created string",
    "generics": "package string, source_key string, generic string, classes array<string>",
}
NODES = "node string, package string, kind string, name string"
EDGES = "src string, dst string, kind string, reason string, source string, start long, end long"
BLOCKERS = "package string, code string, binding string, message string, source string, start long, end long"


def read_facts(spark: SparkSession, path: str, form: str = "parquet") -> dict[str, DataFrame]:
    """All fact tables under ``path``, one folder or file each, with their fixed schemas."""
    return {name: spark.read.schema(schema).format(form).load(f"{path}/{name}.{form}") for name, schema in TABLES.items()}


def with_all(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with an empty table for each that is absent."""
    return {name: tables[name] if name in tables else spark.createDataFrame([], schema) for name, schema in TABLES.items()}
