"""Calls classified by rule tables: which argument of a call names a binding, an environment, a created name.

``calls`` has ``call`` (id), ``callee``, ``names`` (argument names, empty if none) and ``statics`` (a string per argument, null unless it is a
literal string). A call joins its callee's rule (a fixed small table, broadcast), and its arguments are matched once against the rule's formals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import scalar

#: Formals of base functions.
FORMALS = {
    "as.list": ("x",),
    "assign": ("x", "value", "pos", "envir", "inherits", "immediate"),
    "delayedAssign": ("x", "value", "eval.env", "assign.env"),
    "do.call": ("what", "args", "quote", "envir"),
    "eapply": ("env", "FUN", "...", "all.names", "USE.NAMES"),
    "exists": ("x", "where", "envir", "frame", "mode", "inherits"),
    "get": ("x", "pos", "envir", "mode", "inherits"),
    "get0": ("x", "envir", "mode", "inherits", "ifnotfound"),
    "list2env": ("x", "envir", "parent", "hash", "size"),
    "lockBinding": ("sym", "env"),
    "ls": ("name", "pos", "envir", "all.names", "pattern", "sorted"),
    "makeActiveBinding": ("sym", "fun", "env"),
    "match.fun": ("FUN", "descend"),
    "mget": ("x", "envir", "mode", "ifnotfound", "inherits"),
    "objects": ("name", "pos", "envir", "all.names", "pattern", "sorted"),
    "registerS3method": ("genname", "class", "method", "envir"),
    "unlockBinding": ("sym", "env"),
}
#: The formal that names what is looked up, what is created, and those that take an environment.
LOOKED_UP = {"get": "x", "get0": "x", "exists": "x", "match.fun": "FUN", "do.call": "what"}
CREATED = {"assign": "x", "delayedAssign": "x", "makeActiveBinding": "sym"}
ENVIRONMENT = {"as.list": ("x",), "assign": ("envir", "pos"), "eapply": ("env",), "exists": ("envir", "where"), "get": ("envir", "pos"), "get0": ("envir",), "lockBinding": ("env",), "ls": ("envir", "name", "pos"), "makeActiveBinding": ("env",), "mget": ("envir",), "objects": ("envir", "name", "pos"), "registerS3method": ("envir",), "unlockBinding": ("env",)}
#: What a function does with the environment that it is given.
ACTIONS = {"as.list": "enumerate", "assign": "write", "eapply": "enumerate", "exists": "exists", "get": "read", "get0": "read", "lockBinding": "supported", "ls": "names", "makeActiveBinding": "write", "mget": "enumerate", "objects": "names", "registerS3method": "supported", "unlockBinding": "write"}
QUERIES = ("getNamespaceName", "getNamespaceVersion", "getNamespaceInfo", "getNamespaceImports", "getNamespaceExports", "isNamespace", "environmentName")


def _table(values: dict[str, str | tuple[str, ...]]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v))])


def with_match(calls: DataFrame) -> DataFrame:
    """``calls`` with ``formals`` and ``match``, null for callees without a rule."""
    formals = _table(FORMALS)[F.col("callee")]
    known = calls.withColumn("formals", formals)
    return known.withColumn("match", F.when(F.col("formals").isNotNull(), scalar.matched(F.coalesce("formals", F.array().cast("array<string>")), F.when(F.col("formals").isNotNull(), F.col("names")).otherwise(F.array().cast("array<string>")))))


def _taken(formal: Column) -> Column:
    """The argument (from 0) that a named formal takes."""
    at = F.array_position("formals", formal)
    return F.when(F.col("match.error").isNull() & (at > 0), F.get(F.col("match.assigned"), (at - 1).cast("int")))


def static_argument(rule: dict[str, str]) -> Column:
    """The literal string of the formal that ``rule`` gives for the callee."""
    return F.get(F.col("statics"), _taken(_table(rule)[F.col("callee")]))


def created_names(calls: DataFrame) -> DataFrame:
    """``call, created``: the name that a call creates, null if it may be any."""
    rows = with_match(calls.where(F.col("callee").isin(*CREATED, "list2env")))
    return rows.select("call", F.when(F.col("callee") != "list2env", static_argument(CREATED)).alias("created"))


def looked_up_names(calls: DataFrame) -> DataFrame:
    """``call, name``: the literal name that a reflective lookup resolves, null if computed."""
    return with_match(calls.where(F.col("callee").isin(*LOOKED_UP))).select("call", static_argument(LOOKED_UP).alias("name"))


def namespace_actions(uses: DataFrame) -> DataFrame:
    """What becomes of a namespace passed as argument ``index`` (from 0): ``action`` and, for reads, writes and tests, ``name``.
    Anything that no rule covers lets it escape."""
    rows = with_match(uses)
    takes = F.exists(_table(ENVIRONMENT)[F.col("callee")], lambda f: _taken(f) == F.col("index"))
    first = F.get(F.col("statics"), F.when(F.col("match.error").isNull(), F.get(F.col("match.assigned"), F.lit(0))))
    action = F.when(F.col("callee").isin(*QUERIES), F.when(F.col("index") == 0, "supported").otherwise("escape")).when(F.coalesce(takes, F.lit(False)), _table(ACTIONS)[F.col("callee")]).otherwise("escape")
    blind = action.isin("read", "exists") & first.isNull()
    return rows.select("call", "index", F.when(blind, "escape").otherwise(action).alias("action"), F.when(action.isin("read", "exists", "write"), first).alias("name"))


def native_argument(calls: DataFrame) -> DataFrame:
    """``call, position, index``: the index of a native call's n-th own argument (from 1), counting neither the selector nor PACKAGE."""
    own = F.filter(F.sequence(F.lit(1), F.greatest(F.size("names") - 1, F.lit(1))), lambda k: (k < F.size("names")) & (F.coalesce(F.get(F.col("names"), k.cast("int")), F.lit("")) != "PACKAGE"))
    return calls.select("call", "position", F.get(own, (F.col("position") - 1).cast("int")).cast("int").alias("index"))
