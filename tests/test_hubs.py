"""Dispatch through hubs: the same nodes, paths and edges as with an edge for each pair, without making the pairs."""

import random

from provena.operators import graph
from provena.plans import explain
from tests.test_analysis import Universe, nodes


def test_paths_through_hubs_equal_those_over_pairs(spark):
    chance = random.Random(5)
    edges = [(f"n{a:02}", f"n{chance.randrange(a, min(a + 6, 60)):02}") for a in range(60) if a % 3]
    into = [(f"n{chance.randrange(60):02}", f"h{chance.randrange(4)}") for _ in range(12)] + [("n00", "h0")]
    out = [(f"h{chance.randrange(4)}", f"n{chance.randrange(60):02}") for _ in range(20)]
    pairs = [(a, b) for a, h in into for g, b in out if g == h]
    roots = spark.createDataFrame([("n00",), ("n07",)], "node string")
    hubs = spark.createDataFrame(into, "node string, hub string"), spark.createDataFrame(out, "hub string, dst string")
    got = graph.shortest_paths(spark.createDataFrame(edges, "src string, dst string"), roots, hubs)
    want = graph.shortest_paths(spark.createDataFrame(edges + pairs, "src string, dst string"), roots)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_pair_of_site_and_method_is_only_an_edge_for_who_reads_edges(spark):
    u = Universe().package("root", ["f"], f="foo::start").package("foo", ["start"], start=" ".join(f"s{k}" for k in range(20)))
    for k in range(20):
        u.rows["bindings"].extend([("foo", f"s{k}", "Closure", "", "", False), ("foo", f"m{k}", "Closure", "", "", False)])
        u.add("generics", "foo", f"s{k}", "gen", None if k % 2 else ["a", "b"]).add("s3", "foo", None, "gen", "abc"[k % 3], f"m{k}")
    got = u.run(spark)
    assert {f"binding:foo::m{k}" for k in range(20)} <= nodes(got)
    made = got.edges.where("kind in ('Dispatch', 'OpenDispatch')").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in made} == {"Dispatch": 10 * 14, "OpenDispatch": 10 * 20}
    assert got.plain.where("kind in ('Dispatch', 'OpenDispatch')").isEmpty() and got.hubs[0].count() == 40 and got.hubs[1].count() == 34
    assert explain.why(got, "foo::m2").first().path == ["binding:root::f", "binding:foo::start", "binding:foo::s1", "binding:foo::m2"]


def test_pairs_of_several_hubs_come_once(spark):
    chance = random.Random(7)
    into = [(f"n{chance.randrange(30):02}", f"h{chance.randrange(5)}", k % 2) for k in range(120)] + [("n00", "alone", 0)]
    out = [(f"h{chance.randrange(6)}", f"m{chance.randrange(40):02}") for _ in range(150)]
    found = graph.pairs(spark.createDataFrame(into, "node string, hub string, mark int"), spark.createDataFrame(out, "hub string, dst string"), 3)
    want = {(a, m, b) for a, h, m in into for g, b in out if g == h}
    assert found.columns == ["node", "mark", "dst"] and sorted(map(tuple, found.collect())) == sorted(want)


def test_edges_of_pairs_are_not_collected_to_be_told_apart(spark):
    u = Universe().package("root", ["f"], f="s")
    u.rows["bindings"].extend([("root", "s", "Closure", "", "", False), ("root", "m", "Closure", "", "", False)])
    for kind in ("a", "b", "default"):
        u.add("s3", "root", None, "gen", kind, "m")
    u.add("generics", "root", "s", "gen", ["a", "b"]).add("generics", "root", "s", "gen", None)
    got = u.run(spark).edges
    assert sorted(r.kind for r in got.where("dst = 'binding:root::m'").collect()) == ["Dispatch", "OpenDispatch"]

    def under(plan):
        return [plan.nodeName(), *(n for k in range(plan.children().length()) for n in under(plan.children().apply(k)))]

    def aggregates(plan):
        return ([under(plan)] if plan.nodeName() == "Aggregate" else []) + [a for k in range(plan.children().length()) for a in aggregates(plan.children().apply(k))]

    assert not any("Join" in below for below in aggregates(got._jdf.queryExecution().optimizedPlan()))
