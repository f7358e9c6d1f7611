"""Facts of R sources: what each piece of code names, calls, binds, changes and guards, from its syntax tree.

One pass over a tree follows the order in which code runs, with the names that are bound for certain (so far, on every path) and those
that may be. A use is ``bound`` (certain), ``conditional`` (some paths), ``lexical`` (an enclosing function has it, whose code has run by
then) or ``external``. Facts inside a declaration are inert. Places are byte offsets.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.frontend.syntax import Node, SyntaxProblem, parse

#: Functions that evaluate further arguments with their first one's columns in scope, that never return, that make an
#: environment, and that test for a package or load it.
DATA_MASKS = ("with", "within", "subset", "transform")
NEVER_RETURN = ("stop", "quit", "q", "return", "abort")
ENVIRONMENTS = ("environment", "topenv", "parent.frame", "globalenv", "emptyenv", "baseenv", "new.env", "asNamespace", "getNamespace", "parent.env")
PACKAGE_TESTS = ("requireNamespace", "isNamespaceLoaded")
#: The marker in ``declare`` whose contracts this engine reads.
MARKER = "provena"
DOMAINS = ("s3", "strings", "callables")
SCHEMA = "package string, source_key string, kind string, name string, target string, guard string, start long, end long, detail string"


@dataclass
class Scope:
    """A function (or the file): what it binds anywhere, what is bound now, and its parameters."""

    node: Node
    up: Scope | None
    defined: set[str] = field(default_factory=set)
    certain: set[str] = field(default_factory=set)
    parameters: set[str] = field(default_factory=set)
    read: set[str] = field(default_factory=set)


def static(node: Node) -> dict | None:
    """A literal argument: a string, number, constant, symbol, vector of strings or function."""
    if node.kind in ("string", "number", "constant"):
        return {node.kind: node.value}
    if node.kind == "name":
        return {"symbol": node.value}
    if node.kind == "function":
        return {"function": node.start}
    if node.kind == "paren":
        return static(node.parts[0])
    if node.kind == "call" and node.parts[0].value == "c" and all(p.kind == "string" for p in node.parts[1:]):
        return {"strings": [p.value for p in node.parts[1:]]}
    return None


def callee(node: Node) -> tuple[str | None, str | None]:
    """``package, name`` of a call's function, where its text tells."""
    f = node.parts[0]
    if f.kind in ("name", "string"):
        return None, f.value
    if f.kind == "access":
        return f.parts[0].value, f.parts[1].value
    return None, None


def required(condition: Node) -> Iterator[Node]:
    """The calls that must be true for a condition to hold: through ``&&`` and parentheses only."""
    if condition.kind == "paren":
        yield from required(condition.parts[0])
    elif condition.kind == "binary" and condition.value == "&&":
        for part in condition.parts:
            yield from required(part)
    elif condition.kind == "call":
        yield condition


def exits(node: Node) -> bool:
    """Whether no path leaves a node at its end."""
    if node.kind == "jump":
        return True
    if node.kind == "call":
        return callee(node)[1] in NEVER_RETURN
    if node.kind in ("block", "paren"):
        return any(exits(p) for p in node.parts)
    if node.kind == "if":
        return exits(node.parts[0]) or len(node.parts) == 3 and exits(node.parts[1]) and exits(node.parts[2])
    return node.kind == "repeat" and not any(p.kind == "jump" and p.value == "break" for p in walk(node))


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        one = todo.pop()
        yield one
        todo += reversed(one.parts)


def own_definitions(node: Node) -> set[str]:
    """Names that a function's own code binds, not that of functions inside it."""
    out: set[str] = set()
    todo = [node]
    while todo:
        one = todo.pop()
        if one.kind == "assign" and one.value != "<<-":
            target = one.parts[0]
            while target.kind in ("index", "member", "call", "paren"):
                target = target.parts[1 if target.kind == "call" and len(target.parts) > 1 else 0]
            if target.kind in ("name", "string"):
                out.add(target.value or "")
        elif one.kind == "for":
            out.add(one.value or "")
        todo += [p for p in one.parts if p.kind != "function"]
    return out


class Facts:
    def __init__(self, text: str):
        self.rows: list[dict] = []
        self.text = text
        self.bytes: list[int] | None = None
        if not text.isascii():
            self.bytes, at = [0], 0
            for c in text:
                at += len(c.encode())
                self.bytes.append(at)
        self.regions: list[tuple[int, int, str]] = []
        self.inert: list[tuple[int, int]] = []
        self.aliases: dict[str, list[str]] = {}
        self.masked = 0

    def place(self, at: int) -> int:
        return at if self.bytes is None else self.bytes[at]

    def add(self, kind: str, node: Node, name: str | None = None, target: str | None = None, **detail) -> None:
        self.rows.append({"kind": kind, "name": name, "target": target, "start": self.place(node.start), "end": self.place(node.end), "detail": {k: v for k, v in detail.items() if v is not None}})

    def run(self) -> list[dict]:
        tree = parse(self.text)
        top = Scope(tree, None, own_definitions(tree))
        self.visit(tree, top)
        for name, values in self.aliases.items():
            if len(values) == 1:
                self.rows.append({"kind": "environment_alias", "name": name, "target": values[0], "start": None, "end": None, "detail": {}})
        regions = [(self.place(a), self.place(b), g) for a, b, g in self.regions]
        inert = [(self.place(a), self.place(b)) for a, b in self.inert]
        out = []
        for row in self.rows:
            inside = lambda a, b, row=row: row["start"] is not None and a <= row["start"] and row["end"] <= b
            if row["kind"] not in ("declaration", "issue") and any(inside(a, b) for a, b in inert):
                continue
            row["guard"] = ",".join(sorted({g for a, b, g in regions if inside(a, b)})) or None
            out.append(row)
        # a value symbol that an effect already stands for is no reference of its own
        effects = {(r["detail"]["value"], r["detail"]["value_start"]) for r in out if r["kind"] == "super_assignment" and "value" in r["detail"]}
        return [r for r in out if r["kind"] != "reference" or (r["name"], r["start"]) not in effects]

    # uses

    def use(self, node: Node, scope: Scope, called: bool = False) -> None:
        name = node.value or ""
        if scope.up is not None and name in scope.parameters:
            scope.read.add(name)
        state, at = "external", scope
        if name in scope.certain:
            state = "bound"
        elif name in scope.defined:
            state = "conditional"
        else:
            while at.up is not None:
                at = at.up
                if name in at.defined or name in at.parameters:
                    state = "lexical"
                    if name in at.parameters:
                        at.read.add(name)
                    break
        self.add("use", node, name, state, called=called or None)
        if state in ("external", "conditional"):
            kind = "callee" if called else "maybe_local" if self.masked or state == "conditional" else "free"
            self.add("reference", node, name, kind)

    def bind(self, name: str | None, scope: Scope) -> None:
        scope.defined.add(name or "")
        scope.certain.add(name or "")

    # the walk, in order of execution

    def visit(self, node: Node, scope: Scope) -> None:
        handler = getattr(self, f"_{node.kind}", None)
        if handler is not None:
            handler(node, scope)
        else:
            for part in node.parts:
                self.visit(part, scope)

    def _name(self, node: Node, scope: Scope) -> None:
        if node.value != "...":
            self.use(node, scope)

    def _access(self, node: Node, scope: Scope) -> None:
        self.add("access", node, node.parts[1].value, node.parts[0].value, internal=node.value == ":::")

    def _member(self, node: Node, scope: Scope) -> None:
        left, right = node.parts
        if node.value == "$" and left.kind in ("name", "member", "index"):
            receiver = left.value if left.kind == "name" else next((p.value for p in reversed(left.parts) if p.kind in ("name", "string")), None)
            if receiver == ".__NAMESPACE__.":
                self.add("namespace_info", node, right.value)
        self.add("dispatch_syntax", node, node.value, None)
        self.visit(left, scope)
        if right.kind not in ("name", "string"):
            self.visit(right, scope)

    def _index(self, node: Node, scope: Scope) -> None:
        self.add("dispatch_syntax", node, node.value, None, arguments=len(node.parts) - 1)
        for part in node.parts:
            self.visit(part, scope)

    def _unary(self, node: Node, scope: Scope) -> None:
        if node.value == "~":  # a formula's names are not looked up here
            return
        self.add("dispatch_syntax", node, node.value, None, arguments=1)
        self.visit(node.parts[0], scope)

    def _binary(self, node: Node, scope: Scope) -> None:
        if node.value == "~":
            return
        self.add("operator", node, node.value, None, left=static(node.parts[0]), right=static(node.parts[1]))
        if (node.value or "").startswith("%"):
            self.add("reference", node, node.value, "callee")
        self.visit(node.parts[0], scope)
        if node.value in ("&&", "||"):
            before = set(scope.certain)
            self.visit(node.parts[1], scope)
            scope.certain = before
        else:
            self.visit(node.parts[1], scope)

    def _assign(self, node: Node, scope: Scope) -> None:
        target, value = node.parts
        if node.value == "<<-":
            return self._super(node, scope)
        self.visit(value, scope)
        if target.kind in ("name", "string"):
            self.bind(target.value, scope)
            self.add("definition", node, target.value, None, function=value.kind == "function" or None)
            if value.kind == "call":
                package, name = callee(value)
                if name in ENVIRONMENTS:
                    literal = next((p.value for p in value.parts[1:] if p.kind == "string"), None)
                    self.aliases.setdefault(target.value or "", []).append(f"{name}({literal or ''})")
                    return
            if target.value in self.aliases:
                self.aliases[target.value].append("")
        else:
            self._replacement(target, scope)

    def _replacement(self, target: Node, scope: Scope) -> None:
        """``f(x)[i] <- v`` calls ``[<-`` and ``f<-``, and binds ``x``."""
        while target.kind in ("call", "index", "member", "paren"):
            if target.kind == "call":
                package, name = callee(target)
                self.add("replacement", target, f"{name}<-" if name else None, package)
                if name and package is None:
                    self.add("reference", target.parts[0], f"{name}<-", "callee")
                for part in target.parts[2:]:
                    self.visit(part, scope)
                if len(target.parts) < 2:
                    return
                target = target.parts[1]
            else:
                if target.kind != "paren":
                    self.add("replacement", target, f"{target.value}<-", None)
                for part in target.parts[1:]:
                    if target.kind == "index" or part.kind not in ("name", "string"):
                        self.visit(part, scope)
                target = target.parts[0]
        if target.kind == "name":
            self.use(target, scope)
            scope.defined.add(target.value or "")

    def _super(self, node: Node, scope: Scope) -> None:
        target, value = node.parts
        self.visit(value, scope)
        base = target
        while base.kind in ("index", "member", "paren"):
            base = base.parts[0]
        captured, at = False, scope.up
        while at is not None and at.up is not None:
            captured = captured or base.value in at.defined or base.value in at.parameters
            at = at.up
        symbol = value.value if value.kind == "name" else None
        self.add("super_assignment", node, base.value, None, captured=captured, value=symbol, value_start=self.place(value.start) if symbol else None, whole=base is target)
        for part in target.parts[1:]:
            self.visit(part, scope)

    def _if(self, node: Node, scope: Scope) -> None:
        condition, then = node.parts[0], node.parts[1]
        self.add("if", node)
        self.visit(condition, scope)
        for call in required(condition):
            _, name = callee(call)
            if name in PACKAGE_TESTS and len(call.parts) > 1 and call.parts[1].kind == "string":
                self.regions.append((then.start, then.end, call.parts[1].value or ""))
                self.add("guard", then, call.parts[1].value, name)
        before = set(scope.certain)
        ends = []
        for branch in node.parts[1:]:
            scope.certain = set(before)
            self.visit(branch, scope)
            if not exits(branch):
                ends.append(scope.certain)
        if len(node.parts) == 2:
            ends.append(before)
        scope.certain = set.intersection(*ends) if ends else before

    def _for(self, node: Node, scope: Scope) -> None:
        self.add("for", node, node.value)
        self.visit(node.parts[0], scope)
        before = set(scope.certain)
        self.bind(node.value, scope)
        self.visit(node.parts[1], scope)
        scope.certain = before  # the sequence may be empty

    def _while(self, node: Node, scope: Scope) -> None:
        self.visit(node.parts[0], scope)
        before = set(scope.certain)
        self.visit(node.parts[1], scope)
        scope.certain = before

    def _function(self, node: Node, scope: Scope) -> None:
        body = node.parts[-1]
        parameters = {x for x in node.names if x and x != "..."}
        inner = Scope(node, scope, own_definitions(body) | parameters, set(parameters), parameters)
        self.add("function", node, None, None, parameters=[x for x in node.names if x])
        for name, default in zip(node.names, node.parts[:-1], strict=True):
            if default.kind == "missing":
                continue
            literal = static(default)
            if literal and "symbol" not in literal and name not in own_definitions(body) and not any(p.kind == "assign" and p.value == "<<-" and p.parts[0].value == name for p in walk(body)):
                self.add("pinned_default", default, name, json.dumps(literal, sort_keys=True))
            self.visit(default, inner)
        was, self.masked = self.masked, 0
        self.visit(body, inner)
        self.masked = was
        if scope.up is None and inner.read:
            self.add("used_parameters", node, None, ",".join(sorted(inner.read)))

    def _call(self, node: Node, scope: Scope) -> None:
        package, name = callee(node)
        if name == "declare" and package is None:
            return self._declare(node, scope)
        if node.parts[0].kind == "name":
            self.use(node.parts[0], scope, called=True)
        elif node.parts[0].kind != "string":
            self.visit(node.parts[0], scope)
        arguments = [{"name": n, "static": static(p), "start": self.place(p.start), "end": self.place(p.end)} for n, p in zip(node.names, node.parts[1:], strict=True)]
        self.add("call", node, name, package, arguments=arguments)
        self._special(node, name, arguments)
        for k, part in enumerate(node.parts[1:]):
            if name in ("quote", "bquote", "substitute", "expression"):
                break
            masked = name in DATA_MASKS and k > 0
            self.masked += masked
            self.visit(part, scope)
            self.masked -= masked

    def _special(self, node: Node, name: str | None, arguments: list[dict]) -> None:
        strings = [(a["static"] or {}).get("string") for a in arguments]
        if name == "system.file":
            path = [s for a, s in zip(arguments, strings, strict=True) if a["name"] is None]
            package = next((s for a, s in zip(arguments, strings, strict=True) if a["name"] == "package"), None)
            work = next((a["static"] for a in arguments if a["name"] == "mustWork"), None)
            self.add("resource", node, "/".join(x or "" for x in path) if all(path) and path else None, package, must_work=(work or {}).get("constant") == "TRUE")
        elif name == "makeActiveBinding" and arguments:
            function = next((a["static"]["function"] for a in arguments[1:2] if a["static"] and "function" in a["static"]), None)
            self.add("active_binding", node, strings[0], None, function=function)
        elif name in ("UseMethod", "NextMethod"):
            self.add("dispatch", node, strings[0] if strings else None, name)
        elif name in ("assign", "delayedAssign", "list2env"):
            self.add("creator", node, strings[0] if strings and name != "list2env" else None, name)
        elif name == "setHook" and len(node.parts) > 2 and node.parts[1].kind == "call" and callee(node.parts[1])[1] == "packageEvent":
            event = node.parts[1].parts[1:]
            if event and event[0].kind == "string" and (len(event) < 2 or event[1].value == "onLoad"):
                hook = node.parts[2]
                self.regions.append((hook.start, hook.end, event[0].value or ""))
                self.add("guard", hook, event[0].value, "packageEvent")
        if name in DATA_MASKS:
            for a, p in zip(arguments[1:], node.parts[2:], strict=True):
                self.add("data_mask", p, name, a["name"])
        if name in NEVER_RETURN:
            self.add("no_return", node, name)

    def _declare(self, node: Node, scope: Scope) -> None:
        """Contracts like ``declare(provena(s3(x = c("a", "b"))))``: what a name of this scope may be. One name has one kind of domain."""
        self.inert.append((node.start, node.end))
        for contract in node.parts[1:]:
            if contract.kind != "call" or callee(contract)[1] != MARKER:
                continue
            seen: dict[str, str] = {}
            for domain in contract.parts[1:]:
                kind = callee(domain)[1] if domain.kind == "call" else None
                if kind not in DOMAINS:
                    self.add("issue", domain, None, "no such domain")
                    continue
                for name, value in zip(domain.names, domain.parts[1:], strict=True):
                    values = static(value) or {}
                    found = values.get("strings") or ([values["string"]] if "string" in values else None)
                    if name is None or found is None:
                        self.add("issue", value, name, "a domain is a vector of strings")
                    elif seen.setdefault(name, kind) != kind:
                        self.add("issue", value, name, "two kinds of domain")
                    else:
                        self.add("declaration", value, name, kind, values=found)


def facts_of(text: str | None) -> list[dict]:
    """All facts of one source; a text that is no program has one ``issue``."""
    try:
        return Facts(text or "").run()
    except (SyntaxProblem, RecursionError) as e:
        at = e.args[1] if len(e.args) > 1 else 0
        return [{"kind": "issue", "name": None, "target": f"expected {e.args[0]}", "guard": None, "start": len((text or "")[:at].encode()), "end": len((text or "")[:at].encode()), "detail": {}}]


def extract(sources: DataFrame) -> DataFrame:
    """Facts of ``package, source_key, text`` in one Arrow pass: a row for each fact, its further values as JSON in ``detail``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for package, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(package, key, f["kind"], f["name"], f["target"], f["guard"], f["start"], f["end"], json.dumps(f["detail"], sort_keys=True)) for f in facts_of(text)]
            columns = list(zip(*out, strict=True)) or [()] * 9
            kinds = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["package", "source_key", "kind", "name", "target", "guard", "start", "end", "detail"])

    return sources.select("package", "source_key", F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def analysis_tables(facts: DataFrame) -> dict[str, DataFrame]:
    """The fact tables that ``plans.analysis`` reads, from a (written) table of facts. A fact under several guards stands under the first."""
    guard = F.split_part("guard", F.lit(","), F.lit(1)).alias("guard")
    of = lambda *kinds: facts.where(F.col("kind").isin(*kinds))
    literal = F.get_json_object("detail", "$.arguments[0].static.string")
    classes = of("declaration").where("target = 's3'").select("package", "source_key", F.from_json(F.get_json_object("detail", "$.values"), "array<string>").alias("classes"))
    classes = classes.groupBy("package", "source_key").agg(F.array_distinct(F.flatten(F.collect_list("classes"))).alias("classes"))
    return {
        "name_refs": of("reference").select("package", "source_key", "name", guard, "start", "end"),
        "package_refs": of("access").select("package", "source_key", "target", "name", guard, "start", "end"),
        "calls": of("call").where("name <> 'system.file'").select("package", "source_key", F.col("name").alias("callee"), literal.alias("literal"), guard, "start", "end").unionByName(of("resource").select("package", "source_key", F.lit("system.file").alias("callee"), F.col("name").alias("literal"), guard, "start", "end")),
        "creators": of("creator").select("package", "source_key", F.col("name").alias("created")),
        "generics": of("dispatch").where("target = 'UseMethod' and name is not null").select("package", "source_key", F.col("name").alias("generic")).distinct().join(classes, ["package", "source_key"], "left"),
        "issues": of("issue").select("package", F.col("source_key").alias("binding"), F.lit("ParserIssue").alias("code"), F.col("target").alias("message")),
    }
