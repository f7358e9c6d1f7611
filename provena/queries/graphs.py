"""Registered queries of the graph operators, on the graph of parts that follow each other in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provena.operators import graph

ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity"
EDGES_SQL = """edges as (select distinct src, dst from (select l_partkey as src, lead(l_partkey) over (partition by l_orderkey order by {order}) as dst
  from lineitem where l_quantity >= {least}) x where dst is not null and dst <> src)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """Whole seconds since the epoch as the SQL's cast has them: the nearest, of two the even one."""
    return F.rint(F.unix_micros(F.col(column).cast("timestamp")) / 1e6).cast("long")


def part_edges(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*[c.strip() for c in ORDER.split(",")])
    lines = read(spark, sf_dir, "lineitem").where(F.col("l_quantity") >= least)
    return lines.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")).where("dst is not null and dst <> src").distinct()


def _edges_sql(least: int = 0) -> str:
    return EDGES_SQL.format(order=ORDER, least=least)


def least_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").agg(F.min("p_partkey").alias("node"))


def reach_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(part_edges(spark, sf_dir), least_part(spark, sf_dir))


REACH = f"""with recursive {_edges_sql()},
r(node, distance) as (select min(p_partkey), 0::bigint from part union select e.dst, distance + 1 from r join edges e on e.src = r.node where distance < 7)
select node, min(distance) as distance from r group by node"""


def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = graph.shortest_paths(part_edges(spark, sf_dir), least_part(spark, sf_dir))
    return paths.groupBy((F.size("path") - 1).cast("long").alias("length")).agg(F.count("*").alias("n"))


PATHS = f"""with recursive {_edges_sql()},
r(node, distance) as (select min(p_partkey), 0::bigint from part union select e.dst, distance + 1 from r join edges e on e.src = r.node where distance < 7),
b as (select node, min(distance) as length from r group by node) select length, count(*) as n from b group by length"""


def multi_root_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = read(spark, sf_dir, "part").orderBy("p_partkey").limit(5).select(F.col("p_partkey").alias("node"))
    return graph.attribution(part_edges(spark, sf_dir, 48), roots).groupBy("node").agg(F.count("*").alias("roots"), F.min("root").alias("least_root"))


ATTRIBUTION = f"""with recursive {_edges_sql(48)}, roots as (select p_partkey as root from part order by 1 limit 5),
r(root, node) as (select root, root from roots union select r.root, e.dst from r join edges e on e.src = r.node)
select node, count(*) as roots, min(root) as least_root from r group by node"""

_SCC = f"""{_edges_sql(48)},
r(a, b) as (select src, dst from edges union select r.a, e.dst from r join edges e on e.src = r.b),
nodes as (select src as node from edges union select dst from edges),
scc as (select n.node, coalesce(min(x.b), n.node) as c0 from nodes n left join (select r.a, r.b from r join r q on r.a = q.b and r.b = q.a) x on x.a = n.node group by n.node),
labels as (select node, least(node, c0) as component from scc)"""


def scc_components(spark: SparkSession, sf_dir: str, least: int = 48) -> DataFrame:
    return graph.components(part_edges(spark, sf_dir, least))


SCC = f"with recursive {_SCC} select node, component from labels"


def condensation_edges(spark: SparkSession, sf_dir: str, least: int = 48) -> DataFrame:
    e = graph.cut(part_edges(spark, sf_dir, least), "edges")
    return graph.condensation(e, graph.components(e))


CONDENSATION = f"""with recursive {_SCC} select a.component as src, b.component as dst, count(*) as occurrences
from edges e join labels a on e.src = a.node join labels b on e.dst = b.node where a.component <> b.component group by 1, 2"""


def redundant_edges(spark: SparkSession, sf_dir: str, least: int = 49) -> DataFrame:
    """On the condensation; by default that of the sparser graph, whose closure DuckDB can make."""
    e = graph.cut(part_edges(spark, sf_dir, least), "edges")
    return graph.redundant(graph.condensation(e, graph.components(e)).select("src", "dst"))


REDUNDANT = f"""with recursive {_SCC.replace(_edges_sql(48), _edges_sql(49))},
c as (select distinct a.component as src, b.component as dst from edges e join labels a on e.src = a.node join labels b on e.dst = b.node where a.component <> b.component),
p(a, b) as (select src, dst from c union select p.a, c.dst from p join c on c.src = p.b)
select src, dst, exists (select 1 from c o join p on p.a = o.dst where o.src = c.src and p.b = c.dst) as redundant from c"""


def transparent_projection(spark: SparkSession, sf_dir: str, least: int = 48, limit: int = 3) -> DataFrame:
    opaque = read(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("node"))
    return graph.projected(part_edges(spark, sf_dir, least), opaque, limit)


PROJECTION = f"""with {_edges_sql(48)}, o as (select p_partkey as node from part where p_size % 2 = 0), t as (select p_partkey as node from part where p_size % 2 <> 0),
h1 as (select src, dst, 1::bigint as hops from edges where src in (select node from o)),
h2 as (select h.src, e.dst, 2::bigint as hops from h1 h join edges e on e.src = h.dst where h.dst in (select node from t)),
h3 as (select h.src, e.dst, 3::bigint as hops from h2 h join edges e on e.src = h.dst where h.dst in (select node from t))
select src, dst, min(hops) as hops from (select * from h1 union all select * from h2 union all select * from h3) x where dst in (select node from o) and src <> dst group by src, dst"""


def adjacency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(part_edges(spark, sf_dir))


STATS = f"""with {_edges_sql()}, d as (select node, sum(o) as o, sum(i) as i from (select src as node, 1 as o, 0 as i from edges union all select dst, 0, 1 from edges) x group by node)
select count(*) as nodes, sum(o)::bigint as edges, max(o)::bigint as max_out, max(i)::bigint as max_in from d"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    nation, customer, orders = (read(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    return nation.select(name("region", "n_regionkey").alias("src"), name("nation", "n_nationkey").alias("dst")).union(customer.select(name("nation", "c_nationkey"), name("customer", "c_custkey"))).union(orders.select(name("customer", "o_custkey"), name("order", "o_orderkey")))


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.cut(_chain(spark, sf_dir), "edges")
    return graph.topological_levels(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).groupBy("level").agg(F.count("*").alias("nodes"), F.min("node").alias("least"))


TOPO = """with recursive e as (select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst from nation union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer union select 'customer:' || o_custkey, 'order:' || o_orderkey from orders),
n as (select src as node from e union select dst from e),
r(node, level) as (select node, 0::bigint from n where node not in (select dst from e) union select e.dst, level + 1 from r join e on e.src = r.node),
m as (select node, max(level) as level from r group by node) select level, count(*) as nodes, min(node) as least from m group by level"""


def spanning_tree_depths(spark: SparkSession, sf_dir: str, least: int = 30) -> DataFrame:
    e = graph.cut(part_edges(spark, sf_dir, least), "edges")
    tree = graph.shortest_paths(e, least_part(spark, sf_dir))
    return tree.select("node", "parent", "distance")


TREE = f"""with recursive {_edges_sql(30)},
r(node, distance) as (select min(p_partkey), 0::bigint from part union select e.dst, distance + 1 from r join edges e on e.src = r.node where distance < 9),
b as (select node, min(distance) as distance from r group by node)
select b.node, min(p.node) as parent, any_value(b.distance) as distance from b left join edges e on e.dst = b.node left join b p on p.node = e.src and p.distance = b.distance - 1 group by b.node"""

def whole_scc_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scc_components(spark, sf_dir, 0)


def whole_condensation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condensation_edges(spark, sf_dir, 0)


def whole_redundant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redundant_edges(spark, sf_dir, 0)


def whole_transparent_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of any length: a shortest one has no more hops than there are parts."""
    return transparent_projection(spark, sf_dir, 0, read(spark, sf_dir, "part").count() + 1)


def whole_multi_root_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is a root. Counted over the strong components and their closure: no row for each root and node."""
    e = graph.cut(part_edges(spark, sf_dir), "edges")
    roots = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).distinct()
    alone = roots.join(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "node", "left_anti")
    labels = graph.cut(graph.components(e).unionByName(alone.withColumn("component", F.col("node"))), "labels")
    own = labels.join(roots, "node").groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("least"))
    above = graph.closure(graph.condensation(e, labels)).select(F.col("src").alias("component"), F.col("dst").alias("to"))
    above = above.union(labels.select("component", F.col("component").alias("to")).distinct())
    found = above.join(own, "component").groupBy("to").agg(F.sum("n").alias("roots"), F.min("least").alias("least_root"))
    return labels.join(found, F.col("component") == F.col("to")).select("node", "roots", "least_root")


def whole_spanning_tree_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning_tree_depths(spark, sf_dir, 0)


#: Over all of lineitem and part; no SQL, since DuckDB's recursive closure is too slow there. The tests hold them against brute force.
WHOLE = (whole_multi_root_attribution, whole_scc_components, whole_condensation_edges, whole_redundant_edges, whole_transparent_projection, whole_spanning_tree_depths)

QUERIES = {f.__name__: (f, sql) for f, sql in ((reach_parts, REACH), (shortest_path_len, PATHS), (multi_root_attribution, ATTRIBUTION), (scc_components, SCC), (condensation_edges, CONDENSATION), (redundant_edges, REDUNDANT), (transparent_projection, PROJECTION), (adjacency_stats, STATS), (topo_levels, TOPO), (spanning_tree_depths, TREE))} | {f.__name__: (f, None) for f in WHOLE}
