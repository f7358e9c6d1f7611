"""Scalar functions as column expressions: digests and framed fingerprints, identifiers, versions and their intervals, text spans.

Argument matching is an order-sensitive walk over short arrays; it is an Arrow-batched pandas UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The prefix of keys made from a list of strings, and the ending of cache entries' names.
KEY_PREFIX, ENTRY_SUFFIX = "provena-key-v1\0", "entry"


def digest(x: Column | str) -> Column:
    """Lower-case hex SHA-256 of a string or binary."""
    return F.sha2((F.col(x) if isinstance(x, str) else x).cast("binary"), 256)


def little_endian(n: Column) -> Column:
    """Eight bytes, least first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n.cast("long"), 8 * k).bitwiseAND(F.lit(255).cast("long"))), 2, "0")) for k in range(8)])


def framed(x: Column) -> Column:
    """A field of a fingerprint: its length in eight bytes, then its bytes."""
    raw = x.cast("binary")
    return F.concat(little_endian(F.octet_length(raw)), raw)


def framed_list(items: Column) -> Column:
    """The number of items, then each item framed."""
    joined = F.aggregate(items, F.lit(b""), lambda acc, v: F.concat(acc, framed(v)))
    return F.concat(little_endian(F.size(items)), joined)


def fingerprint(*fields: Column) -> Column:
    return F.sha2(F.concat(*[framed(f) for f in fields]), 256)


def string_key(values: Column) -> Column:
    """Digest of a list of strings, each ended by a zero byte, after a prefix."""
    joined = F.aggregate(values, F.lit(""), lambda acc, v: F.concat(acc, v, F.lit("\0")))
    return digest(F.concat(F.lit(KEY_PREFIX), joined))


def component_id(members: Column) -> Column:
    """Identity of a set of members: framed in sorted order, hashed."""
    return F.sha2(F.aggregate(F.array_sort(members), F.lit(b""), lambda acc, v: F.concat(acc, framed(v))), 256)


def edge_id(src: Column, dst: Column) -> Column:
    return F.sha2(F.concat(src.cast("binary"), F.lit(b"\0"), dst.cast("binary")), 256)


def cache_key(*fields: Column) -> Column:
    return fingerprint(*fields)


def cache_name(package: Column, key: Column, member: Column, kind: Column) -> Column:
    return F.concat(package, F.lit("-"), key, F.when(member.isNull(), "").otherwise(F.concat(F.lit("-"), member)), F.lit("."), kind, F.lit(f".{ENTRY_SUFFIX}"))


def parse_cache_name(name: Column) -> Column:
    """``package, key, member, kind``; null for any other name."""
    pattern = r"^(.+?)-([0-9a-f]{16,64})(?:-([^.]+))?\.([a-z]+)\." + ENTRY_SUFFIX + "$"
    part = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.when(name.rlike(pattern), F.struct(part(1).alias("package"), part(2).alias("key"), part(3).alias("member"), part(4).alias("kind")))


def size_text(n: Column) -> Column:
    """Bytes for people: B below 1024, then KiB, MiB, GiB with one decimal."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(n >= 1024**power, F.concat(F.format_number(n / 1024**power, 1), F.lit(f" {unit}"))).otherwise(out)
    return out


def quoted(x: Column) -> Column:
    """A double-quoted literal: backslash, quote, line feed and carriage return escaped."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        x = F.replace(x, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), x, F.lit('"'))


def identifiers(text: Column) -> Column:
    """Runs of letters, digits, dots and underscores."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._]+"), F.lit(0))


def labelled(label: Column, value: Column) -> Column:
    return F.coalesce(F.nullif(label, F.lit("")), value)


def qualified(package: Column, name: Column) -> Column:
    return F.concat_ws("::", package, name)


def private_key(root: Column, linked: Column) -> Column:
    return F.concat_ws(":", root, linked)


def valid_resource_path(path: Column) -> Column:
    """Relative, of normal or ``.`` components, without a zero byte."""
    return path.isNotNull() & (path != "") & ~path.rlike(r"(^/|(^|/)\.\.(/|$)|\x00)")


def valid_package_name(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z][A-Za-z0-9.]*$") & ~name.rlike(r"\.$")


def environment_label(label: Column) -> Column:
    """``kind, name`` of ``namespace:x``, ``base:base``, ``base:empty``, ``private:k`` or ``unsupported:d``; null for others."""
    kind = F.split_part(label, F.lit(":"), F.lit(1))
    rest = F.substr(label, F.char_length(kind) + 2)
    known = kind.isin("namespace", "private", "unsupported") | label.isin("base:base", "base:empty")
    return F.when(known & label.contains(":"), F.struct(kind.alias("kind"), rest.alias("name")))


def member_path(steps: Column) -> Column:
    """``$[[1]].body`` from an array of ``kind, pos, name`` steps."""

    def one(s: Column) -> Column:
        return F.when(s["kind"] == "element", F.concat(F.lit("[["), s["pos"].cast("string"), F.lit("]]"))).when(s["kind"] == "attribute", F.concat(F.lit(".attr[["), s["pos"].cast("string"), F.lit(', "'), s["name"], F.lit('"]]'))).otherwise(F.concat(F.lit("."), s["kind"]))

    return F.concat(F.lit("$"), F.array_join(F.transform(steps, one), ""))


def method_class(binding: Column, generic: Column) -> Column:
    """``print.foo`` of generic ``print`` is class ``foo``; null for others."""
    return F.when(F.startswith(binding, F.concat(generic, F.lit("."))) & (F.char_length(binding) > F.char_length(generic) + 1), F.substr(binding, F.char_length(generic) + 2))


#: The interfaces' entry points and the routine tables that they use.
NATIVE_TABLES = {".C": "c", ".Call": "call", ".External": "external", ".External2": "external", ".Fortran": "fortran"}
#: Apply-family functions with the formal that takes the function and their own formals, before the rest.
APPLY_FAMILY = {
    "apply": ("FUN", ("X", "MARGIN", "FUN", "...", "simplify")),
    "lapply": ("FUN", ("X", "FUN", "...")),
    "sapply": ("FUN", ("X", "FUN", "...", "simplify", "USE.NAMES")),
    "vapply": ("FUN", ("X", "FUN", "FUN.VALUE", "...", "USE.NAMES")),
    "Map": ("f", ("f", "...")),
    "mapply": ("FUN", ("FUN", "...", "MoreArgs", "SIMPLIFY", "USE.NAMES")),
}


def native_table(callee: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in NATIVE_TABLES.items() for x in kv])[callee]


# versions


def version(text: Column) -> Column:
    """``1.10.2`` as an array of integers, which Spark orders element by element; null if malformed."""
    return F.when(text.rlike(r"^[0-9]+([.-][0-9]+)*$"), F.transform(F.split(text, "[.-]"), lambda x: x.cast("int")))


def version_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ".")


def relation(text: Column) -> Column:
    """``package, op, version`` of ``pkg (>= 1.0)``; ``op`` is null without a requirement, the whole null if malformed."""
    pattern = r"^\s*([A-Za-z][A-Za-z0-9.]*)\s*(?:\(\s*(>=|<=|==|!=|>|<|=)?\s*([0-9][0-9.-]*)\s*\))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.when(text.rlike(pattern), F.struct(part(1).alias("package"), F.when(part(2) == "=", "==").otherwise(part(2)).alias("op"), part(3).alias("version")))


def bounds(op: Column, v: Column) -> dict[str, Column]:
    """Aggregates of requirement rows: the stricter bound wins, and at one version the exclusive one."""
    return {
        "lower": F.max(F.when(op.isin(">=", ">"), F.struct(v.alias("version"), (op == ">").alias("exclusive")))),
        "upper": F.min(F.when(op.isin("<=", "<"), F.struct(v.alias("version"), (op == "<=").alias("inclusive")))),
        "exact": F.collect_set(F.when(op == "==", v)),
        "excluded": F.collect_set(F.when(op == "!=", v)),
    }


def admits(v: Column, lower: Column, upper: Column, excluded: Column) -> Column:
    above = lower.isNull() | (v > lower["version"]) | ((v == lower["version"]) & ~lower["exclusive"])
    below = upper.isNull() | (v < upper["version"]) | ((v == upper["version"]) & upper["inclusive"])
    return above & below & ~F.array_contains(excluded, v)


def conflict(lower: Column, upper: Column, exact: Column, excluded: Column) -> Column:
    """No version can satisfy all: two exact ones, an exact one not admitted, crossed bounds, or a single point that is excluded."""
    crossed = lower.isNotNull() & upper.isNotNull() & ((lower["version"] > upper["version"]) | ((lower["version"] == upper["version"]) & (lower["exclusive"] | ~upper["inclusive"] | F.array_contains(excluded, lower["version"]))))
    return F.coalesce((F.size(exact) > 1) | ((F.size(exact) == 1) & ~admits(F.get(exact, F.lit(0)), lower, upper, excluded)) | crossed, F.lit(False))


def requirement_text(lower: Column, upper: Column, exact: Column, excluded: Column) -> Column:
    """The remaining requirements in order: an exact one alone, else lower bound, upper bound and the exclusions between them."""
    inside = F.array_sort(F.filter(excluded, lambda v: admits(v, lower, upper, F.array().cast("array<array<int>>"))))
    bound = F.array_compact(F.array(F.when(lower.isNotNull(), F.concat(F.when(lower["exclusive"], ">").otherwise(">="), version_text(lower["version"]))), F.when(upper.isNotNull(), F.concat(F.when(upper["inclusive"], "<=").otherwise("<"), version_text(upper["version"])))))
    rest = F.concat(bound, F.transform(inside, lambda v: F.concat(F.lit("!="), version_text(v))))
    return F.array_join(F.when(F.size(exact) == 1, F.array(F.concat(F.lit("=="), version_text(F.get(exact, F.lit(0)))))).otherwise(rest), ", ")


# spans


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """``text`` between byte offsets."""
    return F.substring(text.cast("binary"), start + 1, end - start).cast("string") if isinstance(start, int) else F.substr(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def location(text: Column, offset: Column) -> Column:
    """``line, column`` (from 1; the column in characters) of a byte offset."""
    before = F.substr(text.cast("binary"), F.lit(1), offset.cast("int")).cast("string")
    line = F.char_length(before) - F.char_length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), (F.char_length(F.substring_index(before, "\n", -1)) + 1).alias("column"))


def splice(text: Column | str, edits: Column) -> Column:
    """Replaces byte ranges (``start, end, text`` each); null if two overlap or one is outside."""
    raw = (F.col(text) if isinstance(text, str) else text).cast("binary")
    part = lambda a, b: F.substr(raw, (a + 1).cast("int"), (b - a).cast("int"))
    first = F.struct(F.lit(b"").alias("out"), F.lit(0).alias("at"), F.lit(False).alias("bad"))

    def step(s: Column, e: Column) -> Column:
        wrong = s["bad"] | (e["start"] < s["at"]) | (e["start"] > e["end"]) | (e["end"] > F.octet_length(raw))
        return F.struct(F.when(wrong, s["out"]).otherwise(F.concat(s["out"], part(s["at"], e["start"]), F.coalesce(e["text"], F.lit("")).cast("binary"))).alias("out"), e["end"].cast("int").alias("at"), F.coalesce(wrong, F.lit(True)).alias("bad"))

    whole = lambda s: F.when(~s["bad"], F.concat(s["out"], part(s["at"], F.octet_length(raw)))).cast("string")
    return F.when(raw.isNotNull(), F.aggregate(F.array_sort(F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,text:string>>"))), first, step, whole))


def match_arguments(formals: list[str], names: list[str | None]) -> tuple[list[int | None], str | None]:
    """Which argument (from 0) each formal takes: exact names first, then unique prefixes of formals before the dots, then places.
    The second value is the error, if any."""
    dots = formals.index("...") if "..." in formals else None
    taken: dict[int, int] = {}
    used: set[int] = set()
    for f, formal in enumerate(formals):
        if formal == "...":
            continue
        own = [k for k, n in enumerate(names) if n == formal]
        if len(own) > 1:
            return [None] * len(formals), f"formal '{formal}' matched by multiple arguments"
        if own:
            taken[f] = own[0]
            used.add(own[0])
    partial: dict[int, list[int]] = {}
    for k, n in enumerate(names):
        if not n or k in used:
            continue
        hits = [f for f, formal in enumerate(formals) if f not in taken and formal != "..." and (dots is None or f < dots) and formal.startswith(n)]
        if len(hits) > 1:
            return [None] * len(formals), f"argument '{n}' matches multiple formals"
        if hits:
            partial.setdefault(hits[0], []).append(k)
    for f, own in partial.items():
        if len(own) > 1:
            return [None] * len(formals), f"formal '{formals[f]}' matched by multiple arguments"
        taken[f] = own[0]
        used.add(own[0])
    places = [k for k, n in enumerate(names) if not n and k not in used]
    for f in range(len(formals)):
        if formals[f] == "...":
            break
        if f not in taken and places:
            taken[f] = places.pop(0)
            used.add(taken[f])
    rest = [k for k in range(len(names)) if k not in used]
    if rest and dots is None:
        return [None] * len(formals), "unused argument"
    return [taken.get(f) for f in range(len(formals))], None


@F.pandas_udf(T.StructType([T.StructField("assigned", T.ArrayType(T.IntegerType())), T.StructField("error", T.StringType())]))
def matched(formals: pd.Series, names: pd.Series) -> pd.DataFrame:
    rows = [match_arguments(list(f), [n or None for n in a]) for f, a in zip(formals, names, strict=True)]
    return pd.DataFrame({"assigned": [r[0] for r in rows], "error": [r[1] for r in rows]})


def argument_index(match: Column, formals: Column, target: str) -> Column:
    """The argument (from 0) that a formal takes, from a result of ``matched``."""
    return F.when(match["error"].isNull(), F.get(match["assigned"], (F.array_position(formals, target) - 1).cast("int")))
