"""Scenarios of the demand analysis on small in-memory universes."""

import json
import re

import pytest

from provena.plans import analysis, explain
from provena.schemas import TABLES


class Universe:
    """Builds fact tables from short descriptions of functions: bare names are references, ``p::x`` qualified ones."""

    def __init__(self):
        self.rows = {name: [] for name in TABLES}
        self.rows["base_bindings"] = [("print",), ("c",), ("paste",)]

    def package(self, name, exports=(), base=False, **functions):
        self.rows["packages"].append((name, "1.0.0", f"fp-{name}", "base" if base else None, name == "root"))
        for export in exports:
            self.rows["exports"].append((name, export, export))
        for binding, source in functions.items():
            binding = binding.replace("_dot_", ".").replace("hook_", ".")
            self.rows["bindings"].append((name, binding, "Closure", source, f"namespace:{name}", False))
            for m in re.finditer(r"(?:(\w+)::)?(\w+(?:\.\w+)*)", source):
                if m[1]:
                    self.rows["package_refs"].append((name, binding, m[1], m[2], None, m.start(), m.end()))
                else:
                    self.rows["name_refs"].append((name, binding, m[2], None, m.start(), m.end()))
        return self

    def add(self, table, *row):
        self.rows[table].append(row)
        return self

    def run(self, spark, **options):
        tables = {n: spark.createDataFrame(r, TABLES[n]) for n, r in self.rows.items() if r}
        return analysis.analyze(spark, tables, analysis.Options("root", **options))


def nodes(result):
    return {r.node for r in result.nodes.collect()}


def codes(result):
    return sorted((r.package, r.code) for r in result.blockers.collect())


def test_chain_with_cycle(spark):
    u = Universe().package("root", ["f"], f="dep::g").package("dep", ["g"], g="leaf::h").package("leaf", ["h"], h="a", a="b", b="a")
    got = u.run(spark)
    assert {"binding:root::f", "binding:dep::g", "binding:leaf::h", "binding:leaf::a", "binding:leaf::b", "activation:leaf"} <= nodes(got)
    assert codes(got) == []
    e = explain.explain(got.nodes, got.edges, got.roots)
    cyclic = [r for r in e.components.collect() if r.cyclic]
    assert [sorted(r.members) for r in cyclic] == [["binding:leaf::a", "binding:leaf::b"]]
    why = explain.why(got, "leaf::h").first()
    assert why.path == ["binding:root::f", "binding:dep::g", "binding:leaf::h"]
    doc = json.loads(explain.document(e).first().json)
    assert doc["schema_version"] == 1 and len(doc["components"]) == e.components.count()


def test_two_uses_are_one_edge_with_two_occurrences(spark):
    got = Universe().package("root", ["f"], f="foo::bar foo::bar").package("foo", ["bar"], bar="print").run(spark)
    e = explain.explain(got.nodes, got.edges, got.roots)
    edge = e.edges.where("src = 'binding:root::f' and dst = 'binding:foo::bar'").first()
    assert edge.occurrences == 2 and len(edge.evidence) == 2
    summary = {r.package: r for r in e.summaries.collect()}
    assert summary["foo"].entry_members == ["binding:foo::bar"]


def test_diamond_and_unused_bindings(spark):
    u = Universe().package("root", ["f"], f="p::x q::y").package("p", ["x"], x="shared::z", idle="nothing").package("q", ["y"], y="shared::z").package("shared", ["z"], z="w", w="print")
    got = u.run(spark)
    assert "binding:shared::w" in nodes(got) and "binding:p::idle" not in nodes(got)
    assert codes(got) == []


def test_imports_last_wins_and_unknown_stops(spark):
    u = Universe().package("root", ["f"], f="h").package("a", ["h"], h="print").package("b", ["k"], k="print")
    u.add("imports", "root", 1, "from", "a", None, [("h", "h")]).add("imports", "root", 2, "from", "b", None, [("h", "k")])
    got = u.run(spark)
    assert "binding:b::k" in nodes(got) and "binding:a::h" not in nodes(got)
    u.add("imports", "root", 3, "all", "ghost", None, None)
    assert ("root", "UnresolvedName") in codes(u.run(spark))


def test_import_all_excludes(spark):
    u = Universe().package("root", ["f"], f="x y").package("a", ["x", "y"], x="print", y="print")
    u.add("imports", "root", 1, "all", "a", ["y"], None)
    got = u.run(spark)
    assert "binding:a::x" in nodes(got) and codes(got) == [("root", "UnresolvedName")]


def test_external_is_terminal_and_unreached_is_listed(spark):
    u = Universe().package("root", ["f"], f="ext::go").package("ext", ["go"], go="deep").package("spare", ["s"], s="print")
    got = u.run(spark, external=["ext", "spare"])
    assert "external:ext::go" in nodes(got) and "binding:ext::go" not in nodes(got)
    assert [r.name for r in got.unreached_external.collect()] == ["spare"]


def test_hooks_and_natives_are_kept_on_activation(spark):
    u = Universe().package("root", ["f"], f="foo::bar").package("foo", ["bar"], bar="print", hook_onLoad="setup", setup="print")
    u.add("natives", "foo", "lib", "C_go", "unknown")
    got = u.run(spark)
    assert {"binding:foo::.onLoad", "binding:foo::setup", "native:foo::lib"} <= nodes(got)
    assert codes(got) == [("foo", "UnsafeNative")]


def test_dispatch_by_class_and_open(spark):
    u = Universe().package("root", ["f"], f="foo::gen").package("foo", ["gen"], gen="print", gen_dot_a="one", gen_dot_b="two", one="c", two="c")
    u.add("s3", "foo", None, "gen", "a", "gen.a").add("s3", "foo", None, "gen", "b", "gen.b").add("generics", "foo", "gen", "gen", ["a"])
    got = u.run(spark)
    assert "binding:foo::one" in nodes(got) and "binding:foo::two" not in nodes(got)
    u.rows["generics"] = [("foo", "gen", "gen", None)]
    assert "binding:foo::two" in nodes(u.run(spark))


def test_method_of_a_base_generic_needs_only_activation(spark):
    u = Universe().package("root", ["f"], f="foo::bar").package("foo", ["bar"], bar="c", print_dot_foo="show", show="c")
    got = u.add("s3", "foo", None, "print", "foo", "print.foo").run(spark)
    assert "binding:foo::show" in nodes(got)


def test_creators_explain_free_names(spark):
    u = Universe().package("root", ["f", "g"], f="made", g="other")
    u.add("creators", "root", "f", "made")
    assert codes(u.run(spark)) == [("root", "DynamicName"), ("root", "UnresolvedName")]
    u.add("creators", "root", "g", None)
    assert codes(u.run(spark)) == [("root", "DynamicName"), ("root", "DynamicName")]


def test_guards_prune_unselected_optional_packages(spark):
    u = Universe().package("root", ["f"], f="helper", helper="print").package("foo", ["bar"], bar="print")
    u.add("relations", "root", "Suggests", "foo", None, None, 1).add("package_refs", "root", "f", "foo", "bar", "foo", 50, 58)
    assert "binding:foo::bar" not in nodes(u.run(spark))
    assert "binding:foo::bar" in nodes(u.run(spark, linked=["foo"]))


def test_resources_blockers_and_missing_packages(spark):
    u = Universe().package("root", ["f"], f="ghost::x")
    u.add("files", "root", "x.json").add("files", "root", "y.json")
    for at, (callee, literal) in enumerate([("system.file", "x.json"), ("system.file", "z.json"), ("library", "foo"), ("requireNamespace", None), ("loadNamespace", "gone")]):
        u.add("calls", "root", "f", callee, literal, None, 100 + at, 101 + at)
    got = u.run(spark)
    assert {"resource:root/x.json", "missing:ghost", "missing:gone"} <= nodes(got) and "resource:root/y.json" not in nodes(got)
    assert codes(got) == [("root", c) for c in ("Attachment", "DynamicNamespace", "MissingDependency", "MissingDependency", "MissingResource")]


def test_missing_export_and_dataset(spark):
    u = Universe().package("root", ["f"], f="foo::nope foo::iris").package("foo", ["bar"], bar="print")
    got = u.add("data_sets", "foo", "all", ["iris"]).run(spark)
    assert "dataset:foo::iris" in nodes(got) and codes(got) == [("root", "MissingExport")]


def test_entries_and_independence_of_order_and_partitions(spark):
    u = Universe().package("root", ["f", "g"], f="foo::bar", g="foo::bar").package("foo", ["bar"], bar="print")
    got = u.run(spark)
    assert [(r.src, r.dst) for r in explain.entries(got, "foo").where("kind = 'QualifiedReference'").collect()] == [("binding:root::f", "binding:foo::bar"), ("binding:root::g", "binding:foo::bar")]
    first = (sorted(nodes(got)), codes(got), sorted(map(str, got.edges.collect())))
    for rows in u.rows.values():
        rows.reverse()
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        again = u.run(spark)
        assert (sorted(nodes(again)), codes(again), sorted(map(str, again.edges.collect()))) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_root_causes_and_redundant_edges(spark):
    got = Universe().package("root", ["f", "g"], f="a c", g="c", a="b", b="c", c="print").run(spark)
    # c is the base function's name too: the own binding comes first
    e = explain.explain(got.nodes, got.edges, got.roots)
    c = e.components.where("component = 'binding:root::c'").first()
    assert {"binding:root::f", "binding:root::g"} <= set(c.root_causes)
    marks = {(r.src, r.dst): r.redundant for r in e.edges.collect()}
    assert marks["binding:root::f", "binding:root::c"] and not marks["binding:root::g", "binding:root::c"]


@pytest.mark.parametrize("table", sorted(TABLES))
def test_schemas_parse(spark, table):
    assert spark.createDataFrame([], TABLES[table]).columns
