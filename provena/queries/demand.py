"""Registered queries of the demand analysis over a universe made of the driver's tables: nations are packages, customers their bindings,
orders what bindings refer to. The fact tables are made by SQL that both engines read; the rest of the SQL restates the rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.plans import analysis, explain
from provena.plans.storage import cut
from provena.queries.graphs import _SCC, part_edges, read

TABLES = ("nation", "customer", "orders", "supplier")
ROOT, EXTERNAL = "n1", ["n3", "n7"]

_HERE = "n_nationkey % 5 <> 4"
_LEAST = "(select c_nationkey as lk, min(c_custkey) as least from customer where c_mktsegment <> 'BUILDING' group by c_nationkey)"
_OF = "orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"
_NEXT = "(select c_custkey as nk, lead(c_custkey) over (partition by c_nationkey order by c_custkey) as next from customer)"
#: Every fifth nation is not installed; the names u0 to u6 are defined nowhere, b0 to b4 are base's, i0 and i1 are imported.
FACTS = {
    "packages": f"select concat('n', n_nationkey) as name, concat('1.', n_nationkey) as version, n_name as fp, case when n_regionkey = 0 then 'base' end as priority, n_nationkey = 1 as root_flag from nation where {_HERE}",
    "relations": "select concat('n', n_nationkey) as package, 'Suggests' as field, 'n9' as dep, cast(null as string) as op, cast(null as string) as version, 0 as pos from nation",
    "bindings": f"select concat('n', c_nationkey) as package, concat('f', c_custkey) as name, 'Closure' as kind, '' as source, '' as env, false as has_attributes from customer join nation on c_nationkey = n_nationkey where {_HERE} union all select concat('n', n_nationkey), '.onLoad', 'Closure', '', '', false from nation where {_HERE} and n_nationkey % 2 = 0",
    "exports": f"select concat('n', c_nationkey) as package, concat('f', c_custkey) as export, concat('f', c_custkey) as binding from customer join nation on c_nationkey = n_nationkey where {_HERE} and c_mktsegment <> 'BUILDING'",
    "base_bindings": "select distinct concat('b', n_regionkey) as name from nation",
    "name_refs": f"select concat('n', c_nationkey) as package, concat('f', o_custkey) as source_key, case o_orderkey % 6 when 0 then coalesce('f' || next, 'b1') when 1 then concat('i', o_orderkey % 3) when 2 then concat('b', o_orderkey % 5) when 3 then concat('u', o_orderkey % 7) when 4 then 'b0' else 'u99' end as name, case when o_orderkey % 6 = 5 then 'n9' end as guard, o_orderkey * 10 as start, o_orderkey * 10 + 5 as {{end}} from {_OF} join {_NEXT} x on nk = c_custkey where {_HERE}",
    "package_refs": f"select concat('n', c_nationkey) as package, concat('f', o_custkey) as source_key, concat('n', o_orderkey % 25) as target, case o_orderstatus when 'F' then concat('f', coalesce(least, 0)) when 'O' then concat('d', o_orderkey % 25) else 'zz' end as name, cast(null as string) as guard, o_orderkey * 10 + 6 as start, o_orderkey * 10 + 7 as {{end}} from {_OF} left join {_LEAST} l on lk = o_orderkey % 25 where {_HERE} and o_orderpriority = '1-URGENT'",
    "calls": f"select concat('n', c_nationkey) as package, concat('f', o_custkey) as source_key, case o_orderkey % 4 when 0 then 'requireNamespace' when 1 then 'loadNamespace' when 2 then 'library' else 'system.file' end as callee, case o_orderkey % 4 when 0 then concat('n', o_orderkey % 25) when 2 then 'n2' when 3 then concat('data/', o_orderkey % 10) end as literal, cast(null as string) as guard, o_orderkey * 10 + 8 as start, o_orderkey * 10 + 9 as {{end}} from {_OF} where {_HERE} and o_orderpriority = '2-HIGH'",
    "files": "select distinct concat('n', s_nationkey) as package, concat('data/', s_suppkey % 5) as path from supplier",
    "natives": f"select concat('n', s_nationkey) as package, concat('lib', s_suppkey) as component, 'go' as symbol, case when s_suppkey % 2 = 0 then 'safe' else 'unknown' end as safety from supplier join nation on s_nationkey = n_nationkey where {_HERE}",
    "creators": f"select concat('n', c_nationkey) as package, concat('f', c_custkey) as source_key, case when c_acctbal < 9990 then 'u1' end as created from customer join nation on c_nationkey = n_nationkey where {_HERE} and c_acctbal > 9700",
    "issues": f"select concat('n', c_nationkey) as package, concat('f', c_custkey) as binding, 'ParserIssue' as code, 'cannot be read' as message from customer join nation on c_nationkey = n_nationkey where {_HERE} and c_acctbal between 0 and 200",
    "s3": f"select concat('n', c_nationkey) as package, cast(null as string) as generic_pkg, case when c_acctbal > 9000 then 'b0' else 'gen' end as generic, case c_custkey % 3 when 0 then 'a' when 1 then 'b' else 'default' end as class, concat('f', c_custkey) as method from customer join nation on c_nationkey = n_nationkey where {_HERE} and c_mktsegment in ('MACHINERY', 'BUILDING')",
    # with arrays in the table that Spark reads, as text here
    "imports": f"select concat('n', n_nationkey) as package, 0 as pos, 'from' as kind, concat('n', (n_nationkey + 1) % 25) as from_pkg, 'i0' as local, concat('f', coalesce(least, 0)) as remote from nation left join {_LEAST} l on lk = (n_nationkey + 1) % 25 where {_HERE} union all select concat('n', n_nationkey), 1, 'from', 'n3', 'i1', 'f3' from nation where {_HERE} union all select 'n1', cast(10 + n_nationkey as int), 'from', concat('n', n_nationkey), cast(null as string), cast(null as string) from nation where {_HERE} and n_nationkey <> 1",
    "generics": f"select concat('n', c_nationkey) as package, concat('f', c_custkey) as source_key, 'gen' as generic, case when c_custkey % 2 = 0 then 'a' end as class from customer join nation on c_nationkey = n_nationkey where {_HERE} and c_acctbal < -700",
    "data_sets": f"select concat('n', n_nationkey) as package, 's' as {{set}}, concat('d', n_nationkey) as object from nation where {_HERE}",
}


def facts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The fact tables of the universe."""
    tables = {t: read(spark, sf_dir, t) for t in TABLES}
    out = {name: spark.sql(sql.replace("{end}", "end").replace("{set}", "`set`").replace("from nation", "from {nation} nation").replace("join nation", "join {nation} nation").replace("from customer", "from {customer} customer").replace("join customer", "join {customer} customer").replace("from orders", "from {orders} orders").replace("from supplier", "from {supplier} supplier"), **tables) for name, sql in FACTS.items()}
    names = F.when(F.col("local").isNull(), F.array().cast("array<struct<local:string,remote:string>>")).otherwise(F.array(F.struct("local", "remote")))
    out["imports"] = out["imports"].select("package", "pos", "kind", "from_pkg", F.lit(None).cast("array<string>").alias("except"), names.alias("names"))
    out["generics"] = out["generics"].select("package", "source_key", "generic", F.when(F.col("class").isNotNull(), F.array("class")).alias("classes"))
    out["data_sets"] = out["data_sets"].select("package", "set", F.array("object").alias("objects"))
    return out


def _analysis(spark: SparkSession, sf_dir: str) -> analysis.Analysis:
    return analysis.analyze(spark, facts(spark, sf_dir), analysis.Options(ROOT, linked=["n2"], external=EXTERNAL))


def analyze_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the root demands."""
    return _analysis(spark, sf_dir).nodes


def analyze_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why: all edges that start at something retained."""
    return _analysis(spark, sf_dir).edges.select("src", "dst", "kind", "reason", F.col("source").alias("place"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


def analyze_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a build from going on."""
    return _analysis(spark, sf_dir).blockers.select("package", "code", "binding", "message", F.col("source").alias("place"), F.col("start").cast("long").alias("start"))


def analyze_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why one package's activation is kept: the shortest paths' length, and the packages retained and those External ones that are not."""
    done = _analysis(spark, sf_dir)
    why = explain.why(done, "n13").select(F.lit("why").alias("what"), F.col("path")[F.size("path") - 1].alias("name"), F.col("distance").alias("n"))
    kept = done.packages.select(F.lit("retained"), "name", F.lit(0).cast("long"))
    return why.union(kept).union(done.unreached_external.select(F.lit("unreached"), "name", F.lit(0).cast("long")))


def _duck(sql: str) -> str:
    return sql.replace("{end}", '"end"').replace("{set}", "set")


_FACTS = ", ".join(f"f_{name} as materialized ({_duck(sql)})" for name, sql in FACTS.items())
_DEMAND = f"""{_FACTS}, role as (select name, case when name = '{ROOT}' then 'Root' when name in ('n3', 'n7') or priority = 'base' then 'External' else 'Linked' end as role from f_packages),
refs as (select * from f_name_refs where guard is null),
found as materialized (select r.*, case when b.name is not null then 'own' when i.local is not null then 'imported' when a.name is not null then 'base' else 'none' end as found, i.from_pkg, i.remote
  from refs r left join (select distinct package, name from f_bindings) b on b.package = r.package and b.name = r.name
  left join (select package, local, arg_max(from_pkg, pos) as from_pkg, arg_max(remote, pos) as remote from f_imports where local is not null group by 1, 2) i on i.package = r.package and i.local = r.name left join f_base_bindings a on a.name = r.name),
q as materialized (select p.*, role, case when role is null then 'missing:' || target when role = 'External' then 'external:' || target || '::' || p.name when b.name is not null then 'binding:' || target || '::' || p.name when d.object is not null then 'dataset:' || target || '::' || p.name end as access
  from f_package_refs p left join role on role.name = target left join (select distinct package, name from f_bindings) b on b.package = target and b.name = p.name left join f_data_sets d on d.package = target and d.object = p.name),
loads as (select c.*, case when role is null then 'missing:' || literal when role = 'External' then 'package:' || literal else 'activation:' || literal end as loaded, role from f_calls c left join role on role.name = literal where callee in ('requireNamespace', 'loadNamespace') and literal is not null
  and (role is not null or literal <> 'n9' or (package, literal) in (select (package, from_pkg) from f_imports))),
methods as (select 'activation:' || package as home, 'binding:' || package || '::' || method as dst, generic, class from f_s3 where package in (select name from role where role <> 'External')),
sites as (select 'binding:' || package || '::' || source_key as site, generic, class from f_generics),
e as materialized (
  select distinct 'binding:' || package || '::' || source_key as src, 'binding:' || package || '::' || name as dst, 'NameReference' as kind, 'names a binding' as reason, package || '::' || source_key as place, start, "end" as stop from found where found = 'own'
  union select 'binding:' || package || '::' || source_key, case when role = 'External' then 'external:' || from_pkg || '::' || remote when role is null then 'missing:' || from_pkg else 'binding:' || from_pkg || '::' || remote end, 'ImportReference', 'names an import', package || '::' || source_key, start, "end" from found left join role on role.name = from_pkg where found = 'imported'
  union select 'binding:' || package || '::' || source_key, access, 'QualifiedReference', 'qualified access', package || '::' || source_key, start, "end" from q where access is not null
  union select 'binding:' || package || '::' || source_key, loaded, 'NamespaceCall', 'loads a namespace', package || '::' || source_key, start, "end" from loads
  union select 'binding:' || c.package || '::' || source_key, 'resource:' || c.package || '/' || literal, 'ResourceAccess', 'reads a resource', c.package || '::' || source_key, start, "end" from f_calls c join f_files f on f.package = c.package and path = literal where callee = 'system.file'
  union select 'binding:' || package || '::' || name, 'activation:' || package, 'Activation', 'activates its namespace', null, null, null from f_bindings
  union select 'dataset:' || package || '::' || object, 'activation:' || package, 'Activation', 'activates its namespace', null, null, null from f_data_sets
  union select 'activation:' || package, case when role is null then 'missing:' || from_pkg when role = 'External' then 'package:' || from_pkg else 'activation:' || from_pkg end, 'Import', 'imports a namespace', null, null, null from f_imports left join role on role.name = from_pkg
  union select 'activation:' || package, 'binding:' || package || '::' || name, 'Lifecycle', 'runs a hook', null, null, null from f_bindings where name = '.onLoad'
  union select 'activation:' || package, 'native:' || package || '::' || component, 'Native', 'loads a component', null, null, null from f_natives
  union select 'package:{ROOT}', 'activation:{ROOT}', 'Activation', 'root package', null, null, null
  union select site, dst, 'Dispatch', 'dispatches to a method', null, null, null from sites s join methods m on m.generic = s.generic and m.class in (s.class, 'default') where s.class is not null
  union select site, dst, 'OpenDispatch', 'classes are unknown', null, null, null from sites s join methods m on m.generic = s.generic where s.class is null
  union select home, dst, 'Registration', 'registers a method of a base generic', null, null, null from methods where generic in (select name from f_base_bindings)),
start as (select 'binding:' || package || '::' || binding as node from f_exports where package = '{ROOT}' union select 'package:{ROOT}' union select 'activation:{ROOT}'),
reached(node) as (select node from start union select dst from reached join e on src = node)"""

NODES = f"""with recursive {_DEMAND} select node, regexp_extract(node, '^[a-z]+:([^:/]+)', 1) as package, upper(substr(node, 1, 1)) || substr(split_part(node, ':', 1), 2) as kind, nullif(regexp_extract(node, '^[a-z]+:[^:/]+(::|/)(.*)$', 2), '') as name from reached"""
EDGES = f"with recursive {_DEMAND} select src, dst, kind, reason, place, start, stop from e where src in (select node from reached)"
_LIVE = """live as (select node from reached where node like 'binding:%'),
made as (select package, 'n' as x, package || '::' || source_key as creator, created from f_creators where 'binding:' || package || '::' || source_key in (select node from live)),
free as (select f.*, (select min(creator) from made m where m.package = f.package and (m.created is null or m.created = f.name)) as creator from found f where found = 'none' and 'binding:' || package || '::' || source_key in (select node from live)),
b as (select package, case when creator is null then 'UnresolvedName' else 'DynamicName' end as code, source_key as binding, case when creator is null then 'cannot resolve ' || name else 'may be created by ' || creator end as message, package || '::' || source_key as place, start from free
  union all select package, 'MissingDependency', source_key, 'package ' || target || ' is not installed', package || '::' || source_key, start from q where role is null and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, 'MissingExport', source_key, target || ' does not export ' || name, package || '::' || source_key, start from q where role is not null and access is null and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, 'MissingDependency', source_key, 'package ' || literal || ' is not installed', package || '::' || source_key, start from loads where role is null and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, 'DynamicNamespace', source_key, callee || ' of a computed name', package || '::' || source_key, start from f_calls where callee = 'loadNamespace' and literal is null and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, 'Attachment', source_key, 'library changes the search path', package || '::' || source_key, start from f_calls where callee = 'library' and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, 'MissingResource', source_key, 'no file ' || literal, package || '::' || source_key, start from f_calls where callee = 'system.file' and (package, literal) not in (select (package, path) from f_files) and 'binding:' || package || '::' || source_key in (select node from live)
  union all select package, code, binding, message, null, null from f_issues where 'binding:' || package || '::' || binding in (select node from live)
  union all select package, 'UnsafeNative', null, 'component ' || component || ' may call back', null, null from f_natives where safety = 'unknown' and 'native:' || package || '::' || component in (select node from reached))"""
BLOCKERS = f"with recursive {_DEMAND}, {_LIVE} select package, code, binding, message, min(place) as place, min(start) as start from b group by 1, 2, 3, 4"
PATHS = f"""with recursive {_DEMAND}, roots as (select 'binding:' || package || '::' || binding as node from f_exports where package = '{ROOT}' union select 'package:{ROOT}'),
far(node, n) as (select node, 0::bigint from roots union select dst, n + 1 from far join e on src = node where n < 12), d as (select node, min(n) as n from far group by 1)
select 'why' as what, arg_min(node, (n, node)) as name, min(n) as n from d where node like '%:n13' or node like '%:n13::%' or node like '%:n13/%' having count(*) > 0
union all select distinct 'retained', regexp_extract(node, '^[a-z]+:([^:/]+)', 1), 0 from reached where regexp_extract(node, '^[a-z]+:([^:/]+)', 1) in (select name from role)
union all select 'unreached', x, 0 from (values ('n3'), ('n7')) v(x) where x not in (select regexp_extract(node, '^[a-z]+:([^:/]+)', 1) from reached)"""


# explanation of the graph of parts


def _explanation(spark: SparkSession, sf_dir: str) -> explain.Explanation:
    """The sparse graph of parts as an explanation: brands are packages, the least parts roots."""
    e = cut(part_edges(spark, sf_dir, 48), "edges")
    p = read(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*map(F.lit, ["Environment", "Package", "Binding", "Other"])), (F.col("p_size") % 4 + 1).cast("int"))
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    nodes = p.join(e.select(F.col("src").alias("p_partkey")).union(e.select("dst")).distinct(), "p_partkey").select(name(F.col("p_partkey")).alias("node"), F.col("p_brand").alias("package"), kinds.alias("kind"))
    edges = e.select(name(F.col("src")).alias("src"), name(F.col("dst")).alias("dst"), F.lit("Next").alias("kind"), F.lit("follows").alias("reason"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    roots = nodes.groupBy("package").agg(F.min("node").alias("node")).select("node", F.lit("least").alias("reason"))
    return explain.explain(nodes, edges, roots)


def explained_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with their members, packages, kind, cycle mark and identity."""
    c = _explanation(spark, sf_dir).components
    return c.select("component", F.array_join("members", ",").alias("members"), F.array_join("packages", ",").alias("packages"), "kind", "cyclic", "id")


def explained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explanation(spark, sf_dir).edges.select("src", "dst", F.size("evidence").alias("evidence"), F.array_join("reasons", ",").alias("reasons"), "occurrences", "redundant")


def explained_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _explanation(spark, sf_dir).stats


def explained_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each component how many roots reach it, and the least of them."""
    c = _explanation(spark, sf_dir).components.where("root_causes is not null")
    return c.select("component", F.size("root_causes").alias("roots"), F.col("root_causes")[0].alias("least"))


_NAMED = f"""{_SCC}, named as (select lpad(l.component::varchar, 9, '0') as component, lpad(node::varchar, 9, '0') as node, node as k, p_brand, p_size from labels l join part on p_partkey = node),
pairs as (select distinct a.component as src, b.component as dst, e.src as s, e.dst as d from edges e join named a on a.k = e.src join named b on b.k = e.dst where a.component <> b.component)"""
COMPONENTS = f"""with recursive {_NAMED} select component, string_agg(node, ',' order by node) as members, string_agg(distinct p_brand, ',' order by p_brand) as packages,
arg_min(['Environment', 'Package', 'Binding', 'Other'][p_size % 4 + 1], ([2, 1, 0, 3][p_size % 4 + 1], node)) as kind, count(*) > 1 as cyclic, sha256(from_hex(string_agg('0900000000000000' || hex(encode(node)), '' order by node))) as id from named group by 1"""
EXPLAINED = f"""with recursive {_NAMED}, c as (select src, dst, count(*) as n from pairs group by 1, 2), p(a, b) as (select src, dst from c union select p.a, c.dst from p join c on c.src = p.b)
select src, dst, n::int as evidence, 'Next' as reasons, n as occurrences, exists (select 1 from c o join p on p.a = o.dst where o.src = c.src and p.b = c.dst) as redundant from c"""
STATS = f"""with recursive {_NAMED} select (select count(*) from edges) as raw_edges, (select count(*) from named) as raw_nodes, (select count(distinct component) from named) as components,
(select count(*) from (select component from named group by 1 having count(*) > 1) x) as nontrivial_sccs, (select count(*) from (select distinct src, dst from pairs) y) as edges"""
CAUSES = f"""with recursive {_NAMED}, tops as (select min(node) as root from named group by p_brand), c as (select distinct src, dst from pairs),
w(root, component) as (select root, component from tops join named on node = root union select w.root, c.dst from w join c on c.src = w.component)
select component, count(distinct root)::int as roots, min(root) as least from w group by 1"""

_ALL = {analyze_nodes: NODES, analyze_edges: EDGES, analyze_blockers: BLOCKERS, analyze_paths: PATHS, explained_components: COMPONENTS, explained_edges: EXPLAINED, explained_stats: STATS, explained_causes: CAUSES}
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL.items()}
