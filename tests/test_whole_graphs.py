"""The graph queries over whole tables against brute force."""

import collections

import duckdb
import pytest

from provena import catalog

ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"


def lines(orders):
    """Lineitem rows; quantities are far below those of the thin queries."""
    return [(o, k, p, 1, k, 1.0, 1) for o, parts in enumerate(orders) for k, p in enumerate(parts)]


@pytest.fixture(scope="module", params=["small", "fixture"])
def data(request, spark, sf, tmp_path_factory):
    """``folder, edges, parts`` with the sizes of the parts."""
    if request.param == "small":
        return sf, *facts(sf)
    path = str(tmp_path_factory.mktemp("graph"))
    # a cycle 1-2-3 before a transparent chain of 5 inner nodes, a shortcut, a second cycle, a far root and a lone part
    orders = [(1, 2, 3, 1), (3, 5, 7, 9, 11, 13, 8), (4, 6, 8, 6), (3, 4), (2, 6), (20, 4), (20, 1)]
    spark.createDataFrame(lines(orders), "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate int, l_extendedprice double, l_quantity int").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(p, 2 if p in (2, 4, 6, 8, 20) else 1) for p in (*range(1, 14), 20, 30)], "p_partkey long, p_size int").write.parquet(f"{path}/part.parquet")
    return path, *facts(path, "/*.parquet")


def facts(path, inner=""):
    rows = duckdb.sql(f"select l_orderkey, l_partkey from '{path}/lineitem.parquet{inner}' order by l_orderkey, {ORDER}").fetchall()
    edges = {(a[1], b[1]) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and a[1] != b[1]}
    return edges, dict(duckdb.sql(f"select p_partkey, p_size from '{path}/part.parquet{inner}'").fetchall())


def successors(edges):
    out = collections.defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    return out


def distances(out, start, through=lambda n: True):
    """Of the nodes that a path of one edge or more reaches; inner nodes are those that ``through`` lets pass."""
    found, now, n = {}, {start}, 0
    while now:
        n += 1
        now = {b for a in now for b in out[a]} - set(found)
        found |= dict.fromkeys(now, n)
        now = {x for x in now if through(x)}
    return found


def run(spark, data, name):
    return {tuple(r) for r in catalog.queries()[name](spark, data[0]).collect()}


def strong(edges):
    out = successors(edges)
    reach = {n: set(distances(out, n)) | {n} for e in edges for n in e}
    return {n: min(x for x in r if n in reach[x]) for n, r in reach.items()}


def condensed(edges):
    names = strong(edges)
    return collections.Counter((names[a], names[b]) for a, b in edges if names[a] != names[b])


def test_components_and_condensation(spark, data):
    assert run(spark, data, "whole_scc_components") == set(strong(data[1]).items())
    assert run(spark, data, "whole_condensation_edges") == {(*e, n) for e, n in condensed(data[1]).items()}


def test_redundant_edges(spark, data):
    c = condensed(data[1])
    out = successors(c)
    want = {(a, b, any(b in distances(out, x) for x in out[a] if x != b)) for a, b in c}
    assert run(spark, data, "whole_redundant_edges") == want


def test_all_roots_are_attributed(spark, data):
    out, found = successors(data[1]), collections.defaultdict(set)
    for root in data[2]:
        for n in {root, *distances(out, root)}:
            found[n].add(root)
    assert run(spark, data, "whole_multi_root_attribution") == {(n, len(r), min(r)) for n, r in found.items()}


def test_projection_has_paths_of_any_length(spark, data):
    out, opaque = successors(data[1]), {p for p, size in data[2].items() if size % 2 == 0}
    want = {(a, b, n) for a in opaque for b, n in distances(out, a, lambda x: x not in opaque).items() if b in opaque and a != b}
    assert run(spark, data, "whole_transparent_projection") == want
    assert len(data[2]) > 50 or max(n for _, _, n in want) > 3


def test_spanning_tree(spark, data):
    root = min(data[2])
    out = successors(data[1])
    depth = {**distances(out, root), root: 0}
    want = {(n, min((a for a in depth if n in out[a] and depth[a] == d - 1), default=None), d) for n, d in depth.items()}
    assert run(spark, data, "whole_spanning_tree_depths") == want
