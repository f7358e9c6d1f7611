"""Graph operators over edge tables ``src, dst``: reachability, shortest paths, components, orders, projections.

Reach, levels, attribution, projection and trees run as semi-naive loops on distributed tables. Strong components of at most
``KERNEL_EDGES`` edges go through one grouped pandas kernel, larger ones through distributed colouring, with the same result.
Projections over at most ``SPREAD_EDGES`` edges between whole numbers send the edges to all tasks, which share the starts. The
depth-first and the stable topological order are sequential by definition: they are for graphs of packages, which fit one task;
``topological_levels`` is the distributed order.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.plans.fixpoint import fixpoint
from provena.plans.storage import cut

KERNEL_EDGES = 200_000
#: A 32-bit place of each is broadcast, 160 MB, and at most 28 bytes of each node.
SPREAD_EDGES = 40_000_000
#: Nodes, and ends, of a hub that meet in one task; and the most tasks that pairs are dealt to.
HUB_BLOCK, HUB_TASKS = 4_000, 10_000


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct edges."""
    return edges.select("src", "dst").distinct()


def incoming(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node)


def stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges, and the greatest in- and out-degree."""
    e = adjacency(edges)
    degrees = e.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    degrees = degrees.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return degrees.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("o"), F.lit(0)).cast("long").alias("edges"), F.max("o").cast("long").alias("max_out"), F.max("i").cast("long").alias("max_in"))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, distance`` from the nearest root (``roots`` has ``node``), level by level; each level joins only its frontier."""
    e = cut(adjacency(edges).select(F.col("src").alias("node"), "dst"), "edges")
    step = lambda delta, done: delta.join(e, "node").select(F.col("dst").alias("node"), (F.col("distance") + 1).alias("distance"))
    return fixpoint(roots.select("node", F.lit(0).cast("long").alias("distance")), [step], ["node"])


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return levels(edges, roots).select("node")


def shortest_paths(edges: DataFrame, roots: DataFrame, hubs: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """``node, distance, parent, path``: breadth first; of equally near predecessors the least one is kept. ``hubs`` stands for an edge
    from every node (``node, hub``) of a hub to each of its ends (``hub, dst``), in a row for each instead of one for each pair."""
    e = cut(adjacency(edges).select(F.col("src").alias("node"), "dst"), "edges")
    seed = roots.select("node", F.lit(0).cast("long").alias("distance"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.array("node").alias("path"))
    went = [F.col("dst").alias("node"), (F.col("distance") + 1).alias("distance"), F.col("node").alias("parent"), F.concat("path", F.array("dst")).alias("path")]
    rules = [lambda delta, done: delta.join(e, "node").select(*went)]
    if hubs is not None:
        into, out = (cut(h.distinct(), "hubs") for h in hubs)
        # a round's nodes are equally near: the least of a hub speaks for all of them
        rules.append(lambda delta, done: first_by(delta.join(into, "node"), ["hub"], ["node"]).join(out, "hub").select(*went))
    return fixpoint(seed, rules, ["node"], first=["parent"])


def pairs(into: DataFrame, out: DataFrame, block: int = HUB_BLOCK) -> DataFrame:
    """``node, dst`` and the other columns of ``into`` (``node, hub``, any columns) for every node of a hub with each of its ends (``out``:
    ``hub, dst``); no row comes twice. A hub's nodes and ends are dealt to blocks, and a task joins two blocks, so rows are copied once for
    each block of the other side and pairs are never shuffled. A pair that several hubs make comes from the least of them."""
    own = [c for c in into.columns if c != "hub"]
    sides = []
    for side, key, n in ((into.distinct(), own, "n_into"), (out.select("hub", "dst").distinct(), ["dst"], "n_out")):
        hubs = side.groupBy(*key).agg(F.array_sort(F.collect_list("hub")).alias("hubs"))
        sides.append((hubs, side.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("int").alias(n))))
    (a, na), (b, nb) = sides
    size = cut(na.join(nb, "hub"), "blocks")
    tasks = min(HUB_TASKS, size.agg(F.sum(F.col("n_into").cast("long") * F.col("n_out"))).first()[0] or 1)
    keys = ["hub", "i", "j"]
    deal = lambda key, n: F.pmod(F.xxhash64(*key), F.col(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.withColumn("hub", F.explode("hubs")).join(size, "hub").select("*", deal(own, "n_into").alias("i"), copies("n_out").alias("j")).drop("n_into", "n_out")
    b = b.select("dst", F.col("hubs"), F.explode("hubs").alias("hub")).join(size, "hub")
    b = b.select("dst", "hub", F.filter("hubs", lambda h: h < F.col("hub")).alias("before"), deal(["dst"], "n_out").alias("j"), copies("n_into").alias("i"))
    met = b.repartition(tasks, *keys).join(a.repartition(tasks, *keys).hint("shuffle_hash"), keys)
    return met.where((F.size("before") == 0) | ~F.arrays_overlap("before", "hubs")).select(*own, "dst")


def attribution(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``root, node`` for every root and each node that it reaches."""
    e = cut(adjacency(edges).select(F.col("src").alias("node"), "dst"), "edges")
    step = lambda delta, done: delta.join(e, "node").select("root", F.col("dst").alias("node"))
    return fixpoint(roots.select(F.col("node").alias("root"), "node"), [step], ["root", "node"])


def closure(edges: DataFrame) -> DataFrame:
    """``src, dst`` over paths of one edge or more. Meant for condensed graphs: the result may be quadratic."""
    e = cut(adjacency(edges), "edges")
    right = e.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    step = lambda delta, done: delta.join(right, F.col("dst") == F.col("mid")).select("src", F.col("to").alias("dst"))
    return fixpoint(e, [step], ["src", "dst"])


def _tarjan(frame: pd.DataFrame) -> pd.DataFrame:
    out: dict = {}
    for a, b in zip(frame["src"].tolist(), frame["dst"].tolist(), strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    stack: list = []
    on: set = set()
    rows: list = []
    for root in sorted(out):
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, nexts = work[-1]
            for other in nexts:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(out[other])))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        members.append(x)
                        if x == node:
                            break
                    least = min(members)
                    rows += [(x, least) for x in members]
    return pd.DataFrame(rows, columns=["node", "component"])


def in_one_group(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs an order-exact kernel over a whole small table."""
    return df.groupBy(F.lit(0).alias("one")).applyInPandas(lambda frame: kernel(frame.drop(columns=["one"], errors="ignore")), schema)


def components(edges: DataFrame, kernel_edges: int = KERNEL_EDGES) -> DataFrame:
    """Strong components: ``node, component`` with the least member as the component's name."""
    e = cut(adjacency(edges), "edges")
    kind = e.schema["src"].dataType.simpleString()
    if e.count() <= kernel_edges:
        return in_one_group(e, _tarjan, f"node {kind}, component {kind}")
    return _coloured(e)


def _coloured(e: DataFrame) -> DataFrame:
    """Forward colouring by least ancestor, then backward reach inside a colour from the node that gave it; repeated on the rest."""
    nodes = cut(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    found = None
    while not nodes.isEmpty():
        colour = cut(nodes.select("node", F.col("node").alias("colour")), "colour")
        while True:
            got = e.join(colour, e.src == colour.node).select(F.col("dst").alias("node"), "colour")
            new = cut(colour.union(got).groupBy("node").agg(F.min("colour").alias("colour")), "colour")
            changed = not new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if not changed:
                break
        c = colour.withColumnsRenamed({"node": "n", "colour": "k"})
        inside = e.join(colour, e.src == colour.node).select("src", "dst", "colour").join(c, (F.col("dst") == c.n) & (F.col("colour") == c.k)).select("src", "dst")
        own = reach(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("node = colour").select("node"))
        own = cut(own.join(colour, "node").select("node", F.col("colour").alias("component")), "component")
        found = own if found is None else cut(found.unionByName(own), "components")
        nodes = cut(nodes.join(own, "node", "left_anti"), "nodes")
        left = nodes.withColumnRenamed("node", "n")
        e = cut(e.join(left, e.src == left.n, "left_semi").join(left, e.dst == left.n, "left_semi"), "edges")
    return found


def condensation(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between components with their number of raw edges: ``src, dst, occurrences``; inner edges are left out."""
    a, b = labels.toDF("a_node", "a"), labels.toDF("b_node", "b")
    e = edges.join(a, edges.src == F.col("a_node")).join(b, edges.dst == F.col("b_node")).where("a <> b")
    return e.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("occurrences"))


def redundant(edges: DataFrame) -> DataFrame:
    """``src, dst, redundant`` of an acyclic graph: another successor of ``src`` reaches ``dst``. Only nodes with several successors
    ask, and only from those successors."""
    e = cut(adjacency(edges), "edges")
    several = e.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select(F.col("src").alias("s"))
    asked = cut(e.join(several, e.src == F.col("s"), "left_semi").select(F.col("src").alias("s"), F.col("dst").alias("via")), "asked")
    right = e.select(F.col("src").alias("mid"), F.col("dst").alias("to"))
    seed = asked.select("via").distinct().join(right, F.col("via") == F.col("mid")).select("via", "to")
    step = lambda delta, done: delta.withColumnRenamed("to", "at").join(right, F.col("at") == F.col("mid")).select("via", "to")
    paths = fixpoint(seed, [step], ["via", "to"])
    hit = asked.join(paths, "via").select(F.col("s").alias("src"), F.col("to").alias("dst")).distinct().withColumn("hit", F.lit(True))
    return e.join(hit, ["src", "dst"], "left").select("src", "dst", F.coalesce("hit", F.lit(False)).alias("redundant"))


def projected(edges: DataFrame, opaque: DataFrame, limit: int | None = None, spread_edges: int = SPREAD_EDGES) -> DataFrame:
    """``src, dst, hops`` between opaque nodes (``opaque`` has ``node``) over paths whose inner nodes are all transparent; the fewest
    hops. A transparent node is entered once for each start. ``limit``: only paths of so many hops, if given."""
    e = cut(adjacency(edges), "edges")
    ends = cut(opaque.select(F.col("node").alias("o")).distinct(), "opaque")
    if e.schema["src"].dataType.simpleString() == e.schema["dst"].dataType.simpleString() == "bigint" and e.where("src is null or dst is null").isEmpty() and e.count() <= spread_edges:
        return _projected_bits(e, ends, limit)
    seed = e.join(ends, e.src == ends.o, "left_semi").select("src", "dst", F.lit(1).cast("long").alias("hops"))
    right = e.select(F.col("src").alias("mid"), F.col("dst").alias("to"))

    def step(delta: DataFrame, done: DataFrame) -> DataFrame:
        inner = delta.join(ends, delta.dst == ends.o, "left_anti")
        inner = inner if limit is None else inner.where(F.col("hops") < limit)
        return inner.join(right, inner.dst == right.mid).select("src", F.col("to").alias("dst"), (F.col("hops") + 1).alias("hops"))

    found = fixpoint(seed, [step], ["src", "dst"], first=["hops"])
    return found.join(ends, found.dst == ends.o, "left_semi").where("src <> dst")


#: Starts that walk together, 64 a word; starts of a task; edges of a pass that are gathered at once; hops that are held for a batch.
WORDS, TASK_STARTS, PASS_EDGES, HELD = 4, 512, 1 << 18, 1 << 25


def _weak(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least place of each place's weak component."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def _projected_bits(e: DataFrame, ends: DataFrame, limit: int | None) -> DataFrame:
    """The same with a bit for each start: a round of a batch of starts is one pass over the edges of their weak components, in order of
    their ends. Nodes are numbered by component, so the nodes and edges of a batch are a slice of all."""
    spark = e.sparkSession
    table = e.toArrow()
    src, dst = (table.column(c).to_numpy() for c in ("src", "dst"))
    del table
    nodes = np.unique(np.concatenate([src, dst]))
    src, dst = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    label = _weak(len(nodes), src, dst)
    order = np.argsort(label, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    at = np.sort(place[dst] << 32 | place[src])
    src, first = (at & 0xFFFFFFFF).astype(np.int32), np.searchsorted(at >> 32, np.arange(len(nodes) + 1))
    # the places of each place's component: from, to
    low = np.searchsorted(label[order], label[order], "left").astype(np.int32)
    high = np.searchsorted(label[order], label[order], "right").astype(np.int32)
    own = e.select(F.col("src").alias("n")).union(e.select("dst")).distinct()
    held = ends.join(own, ends.o == own.n, "left_semi").toArrow().column("o").to_numpy()
    closed = np.sort(place[np.searchsorted(nodes, held)])
    shared = spark.sparkContext.broadcast((nodes[order], src, first, low[closed], high[closed], closed))

    def batch(lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Starts, ends and hops from the starts with these numbers."""
        nodes, src, first, low, high, closed = shared.value
        begin, end = low[lo], high[hi - 1]
        a, b = np.searchsorted(closed, (begin, end))
        stop, size = closed[a:b] - begin, hi - lo
        to = np.flatnonzero(np.diff(first[begin : end + 1]))
        edge = np.append(first[begin + to], first[end])
        parts = [0]
        while parts[-1] < len(to):
            parts.append(max(parts[-1] + 1, int(np.searchsorted(edge, edge[parts[-1]] + PASS_EDGES, "right")) - 1))
        front = np.zeros((end - begin, (size + 63) // 64), np.uint64)
        bit = np.arange(size)
        front[stop[lo - a : hi - a], bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
        seen, hops, far = np.zeros_like(front), 0, np.zeros((b - a, size), np.uint8)
        while front.any() and (limit is None or hops < limit):
            hops += 1
            if hops > np.iinfo(far.dtype).max:
                far = far.astype(np.uint16 if hops <= 0xFFFF else np.int64)
            got = np.zeros_like(front)
            for j, k in zip(parts, parts[1:]):
                got[to[j:k]] = np.bitwise_or.reduceat(front[src[edge[j] : edge[k]] - begin], edge[j:k] - edge[j], axis=0)
            front = got & ~seen
            seen |= front
            there = np.flatnonzero(front[stop].any(axis=1))
            bits = np.unpackbits(front[stop[there]].astype("<u8").view(np.uint8), axis=1, count=size, bitorder="little")
            far[there] += bits.astype(far.dtype) * far.dtype.type(hops)
            front[stop] = 0
        far[np.arange(lo - a, hi - a), bit] = 0
        ids = nodes[begin:end][stop]
        for k, row in enumerate(np.ascontiguousarray(far.T)):
            hit = np.flatnonzero(row)
            yield np.full(len(hit), ids[lo - a + k]), ids[hit], row[hit].astype(np.int64)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, low, high, closed = shared.value
        rows: list = []
        n = 0
        for lo in (at for b in batches for at in b.column(0).to_pylist()):
            last = min(lo + TASK_STARTS, len(closed))
            while lo < last:
                hi = min(lo + 64 * WORDS, last)
                while hi - lo > 1 and int(np.diff(np.searchsorted(closed, (low[lo], high[hi - 1])))[0]) * (hi - lo) > HELD:
                    hi = lo + (hi - lo) // 2
                for found in batch(lo, hi):
                    rows.append(found)
                    n += len(found[0])
                    if n >= 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["src", "dst", "hops"])
                        rows, n = [], 0
                lo = hi
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["src", "dst", "hops"])

    tasks = -(-len(closed) // TASK_STARTS)
    return spark.range(0, tasks * TASK_STARTS, TASK_STARTS, max(tasks, 1)).mapInArrow(walk, "src long, dst long, hops long")


def crossing(edges: DataFrame, owner: DataFrame, roots: DataFrame) -> DataFrame:
    """Reach inside each root's own package up to the first foreign node: distinct ``package, foreign``. ``owner`` has
    ``node, package``."""
    a, b = owner.toDF("a", "pa"), owner.toDF("b", "pb")
    e = cut(edges.join(a, edges.src == a.a).join(b, edges.dst == b.b).select("src", "dst", "pa", "pb"), "owned")
    inside = reach(e.where("pa = pb").select("src", "dst"), roots)
    return e.where("pa <> pb").join(inside, e.src == inside.node, "left_semi").select(F.col("pa").alias("package"), F.col("pb").alias("foreign")).distinct()


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, level`` by the longest path from a node without predecessors; raises on a cycle."""
    e = cut(adjacency(edges), "edges")
    left, out, level = cut(nodes.select("node").distinct(), "nodes"), None, 0
    while not left.isEmpty():
        inner = e.join(left.toDF("n"), e.src == F.col("n"), "left_semi")
        ready = cut(left.join(inner, left.node == inner.dst, "left_anti").select("node", F.lit(level).cast("long").alias("level")), "ready")
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        out = ready if out is None else out.unionByName(ready)
        left, level = cut(left.join(ready, "node", "left_anti"), "nodes"), level + 1
    return out


def _stable(frame: pd.DataFrame) -> pd.DataFrame:
    """Repeatedly the first ready node in preferred order; if none is, the first left, marked."""
    order = frame.drop_duplicates("node").sort_values("preferred")["node"].tolist()
    place = {n: k for k, n in enumerate(order)}
    needs: list[set] = [set() for _ in order]
    wanted: list[list[int]] = [[] for _ in order]
    for n, d in zip(frame["node"], frame["needs"], strict=True):
        if d is not None and not pd.isna(d) and d in place and d != n and place[d] not in needs[place[n]]:
            needs[place[n]].add(place[d])
            wanted[place[d]].append(place[n])
    ready = [k for k in range(len(order)) if not needs[k]]
    done, rows, first = [False] * len(order), [], 0
    while len(rows) < len(order):
        broke = not ready
        if broke:
            while done[first]:
                first += 1
        k = first if broke else heapq.heappop(ready)
        done[k] = True
        rows.append((order[k], len(rows), broke))
        for other in wanted[k]:
            needs[other].discard(k)
            if not needs[other] and not done[other]:
                heapq.heappush(ready, other)
    return pd.DataFrame(rows, columns=["node", "position", "broke_cycle"])


def activation_order(nodes: DataFrame, needs: DataFrame) -> DataFrame:
    """Stable topological order: ``node, position, broke_cycle``. ``nodes`` has ``node, preferred``; ``needs`` has ``node, needs``."""
    kind = nodes.schema["node"].dataType.simpleString()
    return in_one_group(nodes.join(needs, "node", "left").select("node", "preferred", "needs"), _stable, f"node {kind}, position long, broke_cycle boolean")


def _post_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Depth-first post-order from the first row's node; children by position, first visit wins."""
    children: dict = {}
    for r in frame.sort_values("pos").itertuples(index=False):
        if r.dst is not None and not pd.isna(r.dst):
            children.setdefault(r.src, []).append(r.dst)
    rows: list = []
    seen: set = set()
    for root in frame.loc[frame["root"], "src"].drop_duplicates().sort_values().tolist():
        work = [(root, iter(children.get(root, [])))] if root not in seen else []
        seen.add(root)
        while work:
            node, nexts = work[-1]
            other = next((x for x in nexts if x not in seen), None)
            if other is None:
                work.pop()
                rows.append((node, len(rows)))
            else:
                seen.add(other)
                work.append((other, iter(children.get(other, []))))
    return pd.DataFrame(rows, columns=["node", "position"])


def load_order(edges: DataFrame) -> DataFrame:
    """Import load order: ``edges`` has ``src, dst, pos, root``; the result ``node, position``."""
    kind = edges.schema["src"].dataType.simpleString()
    return in_one_group(edges.select("src", "dst", "pos", "root"), _post_order, f"node {kind}, position long")


def owners(edges: DataFrame, nodes: DataFrame, root) -> DataFrame:
    """``node, owner``: the root for what it reaches, else the least node that reaches it (or itself). Labels move along edges, a round
    for each step of the longest way that one takes."""
    e = cut(adjacency(edges), "edges")
    first = cut(reach(e, nodes.where(F.col("node") == root).select("node").distinct()), "first")
    left = nodes.select("node").distinct().join(first, "node", "left_anti")
    label = cut(left.select("node", F.col("node").alias("owner")), "owner")
    inner = cut(e.join(label.select(F.col("node").alias("n")), F.col("dst") == F.col("n"), "left_semi"), "inner")
    moved = label
    while not moved.isEmpty():
        got = inner.join(moved, inner.src == moved.node).groupBy(F.col("dst").alias("node")).agg(F.min("owner").alias("got"))
        both = cut(label.join(got, "node", "left"), "both")
        label = both.select("node", F.least("owner", "got").alias("owner"))
        moved = both.where("got < owner").select("node", F.col("got").alias("owner"))
    return first.select("node", F.lit(root).cast(label.schema["owner"].dataType).alias("owner")).unionByName(label)


def spanning_tree(edges: DataFrame, nodes: DataFrame, root) -> DataFrame:
    """``node, parent, depth``: breadth-first tree with the least parent; nodes that the root does not reach start trees of their own,
    the least of those left first. All trees grow at once, each over the nodes that it owns."""
    own = cut(owners(edges, nodes, root), "owners")
    a, b = own.toDF("src", "a"), own.toDF("dst", "b")
    inside = edges.join(a, "src").join(b, "dst").where("a = b").select("src", "dst")
    found = shortest_paths(inside, own.where("node = owner").select("node"))
    return found.select("node", "parent", F.col("distance").alias("depth"))


def first_by(df: DataFrame, key: list[str], order: list[str | Column], last: bool = False) -> DataFrame:
    """The first row of each key in an explicit order (or the ``last`` one): combined before the shuffle."""
    best = (F.max_by if last else F.min_by)(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*[F.col(c).alias(f"__key{k}") for k, c in enumerate(key)]).agg(best.alias("__best")).select("__best.*")
