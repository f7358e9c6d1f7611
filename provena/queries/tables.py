"""Registered queries of lookup, policy, sources, cache and emitted texts: nations are packages, customers their names, orders uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar
from provena.operators import emit, graph, policy, relocate, report, resolve, spans
from provena.plans.storage import cut, shared_path
from provena.queries.graphs import _chain, read, seconds
from provena.sources import images, index
from provena.sources.cache import Cache


def _name(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(kind), (F.col(key) if isinstance(key, str) else key).cast("string"))


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages that are there, with their role: every fifth nation is absent."""
    n = read(spark, sf_dir, "nation")
    rows = n.select(_name("n", "n_nationkey").alias("name"), F.concat(F.lit("1."), "n_nationkey").alias("version"), F.when(F.col("n_regionkey") == 0, "base").alias("priority"), F.when(F.col("n_nationkey") % 5 == 4, "absent").otherwise("there").alias("state"))
    return resolve.roles(rows.where("state = 'there'").drop("state"), "n1", ["n3", "n7"])


_ROLES = "roles as (select 'n' || n_nationkey as name, '1.' || n_nationkey as version, case when n_nationkey = 1 then 'Root' when n_nationkey in (3, 7) or n_regionkey = 0 then 'External' else 'Linked' end as role from nation where n_nationkey % 5 <> 4)"


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    field = F.when(F.col("c_acctbal") > 9000, "Imports").when(F.col("c_acctbal") > 8500, "Depends").when(F.col("c_acctbal") < 3000, "Suggests").otherwise("Enhances")
    op = F.when(F.col("c_acctbal") > 9500, ">=").when(F.col("c_acctbal") < 500, "<").when(F.col("c_acctbal") < 600, "!=")
    return c.select(_name("n", "c_nationkey").alias("package"), field.alias("field"), _name("n", F.col("c_custkey") % 28).alias("dep"), op.alias("op"), F.concat(F.lit("1."), F.when(op == "<", F.lit(10) + F.col("c_custkey") % 20).otherwise(F.col("c_custkey") % 9)).alias("version"))


_RELATIONS = """rel as (select 'n' || c_nationkey as package, 'n' || (c_custkey % 28) as dep, case when c_acctbal > 9000 then 'Imports' when c_acctbal > 8500 then 'Depends' when c_acctbal < 3000 then 'Suggests' else 'Enhances' end as field,
case when c_acctbal > 9500 then '>=' when c_acctbal < 500 then '<' when c_acctbal < 600 then '!=' end as op, case when c_acctbal < 500 then 10 + c_custkey % 20 else c_custkey % 9 end as v from customer)"""


def _imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directives: those of the poorest suppliers take all but two names, the others two named ones."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    names = F.array(F.struct(_name("f", k % 40).alias("local"), _name("f", k % 40).alias("remote")), F.struct(_name("f", (k * 7) % 40).alias("local"), _name("f", (k * 3) % 40).alias("remote")))
    every = F.col("s_acctbal") < 1000
    return s.select(_name("n", "s_nationkey").alias("package"), k.cast("int").alias("pos"), F.when(every, "all").otherwise("from").alias("kind"), _name("n", k % 28).alias("from_pkg"), F.when(every, F.array(_name("f", k % 7), F.lit("f1"))).alias("except"), F.when(~every, names).alias("names"))


_IMPORTS = """imp as (select 'n' || s_nationkey as package, s_suppkey as pos, 'n' || (s_suppkey % 28) as from_pkg, s_acctbal < 1000 as every, s_suppkey as k from supplier)"""


def _exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING' and c_nationkey % 4 <> 2")
    return c.select(_name("n", "c_nationkey").alias("package"), _name("f", F.col("c_custkey") % 40).alias("export"), _name("g", F.col("c_custkey") % 40).alias("binding")).distinct()


_EXPORTS = "exp as (select distinct 'n' || c_nationkey as package, 'f' || (c_custkey % 40) as export, 'g' || (c_custkey % 40) as binding from customer where c_mktsegment <> 'BUILDING' and c_nationkey % 4 <> 2)"
#: Import tables of the directives above.
_IMPORTED = f"""{_IMPORTS}, {_EXPORTS}, tab as (
  select package, pos, 0 as name_pos, 'f' || (k % 40) as local, from_pkg, 'f' || (k % 40) as remote, true as known from imp where not every
  union all select package, pos, 1, 'f' || (k * 7 % 40), from_pkg, 'f' || (k * 3 % 40), true from imp where not every
  union all select i.package, pos, 0, export, from_pkg, export, true from imp i join exp e on e.package = i.from_pkg where every and export not in ('f' || (k % 7), 'f1')
  union all select i.package, pos, 0, null, from_pkg, null, false from imp i where every and from_pkg not in (select package from exp))"""


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("use"), _name("n", "c_nationkey").alias("package"), _name("f", F.col("o_orderkey") % 45).alias("name"))


_USES = "uses as (select o_orderkey as use, 'n' || c_nationkey as package, 'f' || (o_orderkey % 45) as name from orders join customer on o_custkey = c_custkey)"


# lookup


def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)).withColumn("name_pos", F.col("name_pos").cast("int"))


IMPORT_TABLE = f"with {_IMPORTED} select package, pos, name_pos, local, from_pkg, remote, known from tab"


def import_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    imported = cut(resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)), "imported")
    return resolve.import_lookup(_uses(spark, sf_dir), imported).select("use", "from_pkg", "remote", "state")


IMPORT_LOOKUP = f"""with {_IMPORTED}, {_USES},
hit as (select package, local as name, arg_max(from_pkg, (pos, name_pos, from_pkg, remote)) as from_pkg, arg_max(remote, (pos, name_pos, from_pkg, remote)) as remote, max(pos) as pos from tab where local is not null group by 1, 2),
wild as (select package, max(pos) as pos from tab where not known group by 1)
select use, case when w.pos is null or w.pos <= h.pos then h.from_pkg end as from_pkg, case when w.pos is null or w.pos <= h.pos then h.remote end as remote,
case when w.pos is not null and (h.pos is null or w.pos > h.pos) then 'unknown' when h.pos is not null then 'imported' else 'absent' end as state
from uses left join hit h using (package, name) left join wild w using (package)"""


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that stand for other packages' names, followed to where they are defined; some go in a circle."""
    s = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    to = F.when(k % 10 == 3, k + 7).when(k % 10 == 7, k - 7).when(k % 10 != 0, k - 1)
    aliases = s.where(to.isNotNull()).select(_name("p", k % 3).alias("package"), _name("f", k).alias("name"), _name("p", to % 3).alias("to_package"), _name("f", to).alias("to_name"))
    return resolve.definitions(aliases)


DEFINITIONS = """with recursive a as (select p_partkey as k, case when p_partkey % 10 = 3 then p_partkey + 7 when p_partkey % 10 = 7 then p_partkey - 7 when p_partkey % 10 <> 0 then p_partkey - 1 end as t from part),
e as (select * from a where t is not null), r(k, goal, hops) as (select k, t, 1 from e union select r.k, e.t, hops + 1 from r join e on e.k = r.goal where hops < 12),
d as (select k, arg_min(goal, (hops, goal)) as goal, min(hops) as hops from r where goal not in (select k from e) group by k)
select 'p' || (e.k % 3) as package, 'f' || e.k as name, 'p' || (d.goal % 3) as def_package, 'f' || d.goal as def_name, hops::int as hops from e left join d on d.k = e.k"""


def scope_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = _chain(spark, sf_dir).select(F.col("dst").alias("scope"), F.col("src").alias("parent"))
    return resolve.ancestors(parents).select("scope", "ancestor", F.col("depth").cast("int").alias("depth"))


_CHAIN = "e as (select 'region:' || n_regionkey as src, 'nation:' || n_nationkey as dst from nation union select 'nation:' || c_nationkey, 'customer:' || c_custkey from customer union select 'customer:' || o_custkey, 'order:' || o_orderkey from orders)"
ANCESTORS = f"""with recursive {_CHAIN}, r(scope, ancestor, depth) as (select x, x, 0 from (select src as x from e union select dst from e) union select r.scope, e.src, depth + 1 from r join e on e.dst = r.ancestor)
select scope, ancestor, depth::int as depth from r"""


def visible_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of a nation or customer that a use in an order sees."""
    chain = resolve.ancestors(_chain(spark, sf_dir).select(F.col("dst").alias("scope"), F.col("src").alias("parent")))
    o, c, n = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    uses = o.select(F.col("o_orderkey").alias("use"), _name("order:", "o_orderkey").alias("scope"), _name("v", F.col("o_orderkey") % 3).alias("name"))
    domains = c.select(_name("customer:", "c_custkey").alias("scope"), _name("v", F.col("c_custkey") % 3).alias("name"), F.col("c_mktsegment").alias("domain")).union(n.select(_name("nation:", "n_nationkey"), _name("v", F.col("n_nationkey") % 3), "n_name"))
    return policy.visible(uses, chain, domains)


VISIBLE = """select o_orderkey as use, c_mktsegment as domain from orders join customer on o_custkey = c_custkey where o_orderkey % 3 = c_custkey % 3
union select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderkey % 3 = n_nationkey % 3"""


def shadowed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s, p = (read(spark, sf_dir, t) for t in ("customer", "supplier", "part"))
    return policy.shadow_set(c.select(_name("n", "c_nationkey").alias("package"), _name("f", F.col("c_custkey") % 50).alias("name")), s.select(_name("n", "s_nationkey").alias("package"), _name("f", F.col("s_suppkey") % 60).alias("name")), p.select(_name("n", F.col("p_size") % 25).alias("package"), _name("C_", "p_size").alias("name")))


SHADOWED = "select 'n' || c_nationkey as package, 'f' || (c_custkey % 50) as name from customer union select 'n' || s_nationkey, 'f' || (s_suppkey % 60) from supplier union select 'n' || (p_size % 25), 'C_' || p_size from part"


def name_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a name that code uses freely comes from: shadowed, imported, an unknown import-all, or base."""
    uses = _uses(spark, sf_dir)
    own = _exports(spark, sf_dir).where("export < 'f2'").select("package", F.col("export").alias("name"), F.lit("own").alias("target"))
    tab = cut(resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)), "imported")
    named = tab.where("known").select("package", F.col("local").alias("name"), F.col("from_pkg").alias("target"))
    wild = uses.select("package", "name").distinct().join(tab.where("not known").select("package").distinct(), "package").select("package", "name", F.lit("any").alias("target"))
    base = uses.select("package", "name").distinct().where("name < 'f3'").withColumn("target", F.lit("base"))
    return resolve.cascade(uses, [("Shadowed", own), ("Imported", named), ("UnknownImportAll", wild), ("Base", base)], ["package", "name"]).select("use", "target", F.col("found_in").alias("origin"))


ORIGIN = f"""with {_IMPORTED}, {_USES}, named as (select package, local as name, min(from_pkg) as t from tab where known group by 1, 2), wild as (select distinct package from tab where not known)
select use, case when e.export is not null then 'own' when n.t is not null then n.t when w.package is not null then 'any' when u.name < 'f3' then 'base' end as target,
case when e.export is not null then 'Shadowed' when n.t is not null then 'Imported' when w.package is not null then 'UnknownImportAll' when u.name < 'f3' then 'Base' end as origin
from uses u left join exp e on e.package = u.package and e.export = u.name and e.export < 'f2' left join named n on n.package = u.package and n.name = u.name left join wild w on w.package = u.package"""


def selected_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own and imported names that start like a generic's methods."""
    tab = resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)).where("known").withColumnRenamed("local", "name")
    own = _exports(spark, sf_dir).select("package", F.col("binding").alias("name"))
    return policy.selected_methods(own, tab, F.col("name").rlike("^[fg]1"))


METHODS = f"""with {_IMPORTED} select package, package as home, binding from exp where binding like 'g1%' union select package, from_pkg, remote from tab where known and local like 'f1%'"""


def located_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as libraries in order of their key: the first that ships a part (and has no returned line of it) has it."""
    l = read(spark, sf_dir, "lineitem")
    rows = l.groupBy(F.col("l_partkey").cast("string").alias("name"), F.col("l_suppkey").alias("rank")).agg(F.min(F.when(F.col("l_returnflag") != "R", F.col("l_linestatus"))).alias("version"))
    located = cut(resolve.locate(rows), "located")
    return resolve.frozen(read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name")), located)


LOCATED = """with l as (select l_partkey::varchar as name, l_suppkey as rank, min(l_linestatus) filter (where l_returnflag <> 'R') as version from lineitem group by 1, 2),
f as (select name, min(rank) as rank, arg_min(version, rank) as version from l where version is not null group by 1) select p_partkey::varchar as name, f.rank, f.version from part left join f on f.name = p_partkey::varchar"""


def changed_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities that differ between two looks at the universe."""
    s = read(spark, sf_dir, "supplier")
    before = s.select("s_suppkey", F.floor(F.col("s_acctbal") / 1000).cast("long").alias("fp"))
    after = s.select("s_suppkey", F.floor((F.col("s_acctbal") + 100) / 1000).cast("long").alias("fp"))
    return resolve.changes(before, after)


CHANGED = """with b as (select s_suppkey, floor(s_acctbal / 1000)::bigint as fp from supplier), a as (select s_suppkey, floor((s_acctbal + 100) / 1000)::bigint as fp from supplier)
select *, 'before' as side from (select * from b except all select * from a) x union all select *, 'after' from (select * from a except all select * from b) y"""


# policy


def declared_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.declared(_relations(spark, sf_dir), _imports(spark, sf_dir))


_DECLARED = f"""{_RELATIONS}, {_IMPORTS}, req as (select package, dep from rel where field in ('Imports', 'Depends') union select package, from_pkg from imp),
dcl as (select package, dep, 'required' as kind from req union all select package, dep, 'suggested' from (select package, dep from rel where field = 'Suggests' except select * from req) x)"""
DECLARED = f"with {_DECLARED} select package, dep, kind from dcl"


def guard_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.guard_states(policy.declared(_relations(spark, sf_dir), _imports(spark, sf_dir)), _roles(spark, sf_dir), ["n3", "n7", "n11"])


GUARD_STATES = f"with {_DECLARED}, {_ROLES} select package, dep as guard, case when dep not in (select name from roles) then 'absent' when dep in ('n3', 'n7', 'n11') then 'active' else 'unselected' end as state from dcl where kind = 'suggested'"


def established_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.established(_roles(spark, sf_dir), _imports(spark, sf_dir))


ESTABLISHED = f"with {_ROLES}, {_IMPORTS} select name as package, name from roles union select package, from_pkg from imp"


def _namespace_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("call"), _name("n", "c_nationkey").alias("package"), F.when(F.col("o_orderstatus") != "P", _name("n", F.col("o_orderkey") % 28)).alias("target"))


def discovered_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.discovered(_namespace_calls(spark, sf_dir), _roles(spark, sf_dir), policy.declared(_relations(spark, sf_dir), _imports(spark, sf_dir)))


DISCOVERED = f"""with {_DECLARED}, {_ROLES}, calls as (select o_orderkey as call, 'n' || c_nationkey as package, case when o_orderstatus <> 'P' then 'n' || (o_orderkey % 28) end as target from orders join customer on o_custkey = c_custkey)
select call, package, target, case when target is null then 'Computed' when r.role is not null then case when target = package or r.role in ('External', 'Root') then 'Settled' else 'Linked' end
when (package, target) in (select (package, dep) from dcl where kind = 'suggested') then 'Optional' else 'Missing' end as state from calls left join roles r on r.name = target"""


def consulted_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that was asked for, with its identity if there is one, and its place in order."""
    asked = _namespace_calls(spark, sf_dir).where("target is not null").select(F.col("target").alias("name"))
    out = resolve.frozen(asked, _roles(spark, sf_dir).select("name", "version"))
    return out.join(policy.batches(out.withColumn("all", F.lit(1)), "all", "name", 1).select("name", "batch"), "name")


CONSULTED = f"""with {_ROLES}, a as (select distinct 'n' || (o_orderkey % 28) as name from orders where o_orderstatus <> 'P') select a.name, version, row_number() over (order by a.name) - 1 as batch from a left join roles using (name)"""


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that code asks of each package, once each, eight to a batch."""
    return policy.batches(_uses(spark, sf_dir), "package", "name", 8)


BATCHES = f"with {_USES}, d as (select distinct package, name from uses) select package, name, (row_number() over (partition by package order by name) - 1) // 8 as batch from d"


def platform_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("priority", F.when(F.col("n_regionkey") == 0, "base").when(F.col("n_regionkey") == 1, "recommended"))
    return n.select("n_name", policy.is_platform().alias("platform"))


def resource_accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "part"), read(spark, sf_dir, "supplier")
    path = F.when(F.col("p_size") % 7 != 0, F.concat(F.when(F.col("p_size") % 5 == 0, "../").otherwise("data/"), F.lit("s"), F.col("p_partkey") % 120))
    calls = p.select(F.col("p_partkey").alias("call"), F.lit("pkg").alias("package"), path.alias("path"), (F.col("p_size") > 25).alias("must_work"))
    return policy.resource_accesses(calls, s.select(F.lit("pkg").alias("package"), F.concat(F.lit("data/s"), "s_suppkey").alias("path")))


RESOURCES = """with c as (select p_partkey as call, 'pkg' as package, case when p_size % 7 <> 0 then case when p_size % 5 = 0 then '../' else 'data/' end || 's' || (p_partkey % 120) end as path, p_size > 25 as must_work from part)
select *, case when path is null then 'deferred' when path like '../%' then 'invalid' when path in (select 'data/s' || s_suppkey from supplier) then 'present' when must_work then 'fatal' else 'empty' end as state from c"""


def external_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _relations(spark, sf_dir).where("field in ('Imports', 'Depends', 'Suggests')")
    return policy.external_contracts(rel, _roles(spark, sf_dir))


CONTRACTS = f"""with {_RELATIONS}, {_ROLES}, a as (select dep as name, max(v) filter (where op = '>=') as lo, min(v) filter (where op = '<') as hi, list_sort(list_distinct(coalesce(list(v) filter (where op = '!='), []))) as ex from rel
  where field in ('Imports', 'Depends', 'Suggests') and package in (select name from roles where role <> 'External') group by 1),
b as (select r.name, split_part(version, '.', 2)::int as own, a.name is null as none, lo, hi, ex, list_filter(coalesce(ex, []), lambda x: (lo is null or x >= lo) and (hi is null or x < hi)) as inside from roles r left join a using (name) where role = 'External')
select name, coalesce(nullif(concat_ws(', ', '>=1.' || lo, '<1.' || hi, case when len(inside) > 0 then array_to_string(list_transform(inside, lambda x: '!=1.' || x), ', ') end), ''), 'any') as requirement,
case when none then 'undeclared' when lo >= hi then 'conflict' when own < lo or own >= hi or list_contains(ex, own) then 'unsatisfied' end as problem from b"""


def attached_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)).where("known").select("package", "local", "from_pkg", "remote").distinct()
    retained = _exports(spark, sf_dir).where("export < 'f25'").select("package", F.col("export").alias("name"))
    return policy.attached(slots, _roles(spark, sf_dir), retained)


ATTACHED = f"""with {_IMPORTED}, {_ROLES}, s as (select distinct package, local, from_pkg, remote from tab where known)
select * from (select s.*, case when (from_pkg, remote) in (select (package, export) from exp where export < 'f25') then 'Bound' when from_pkg in (select name from roles where role = 'Linked') then 'Removed' end as state from s) x where state is not null"""


def load_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)).where("known").select("local", "from_pkg").distinct()
    return policy.load_stages(slots, _roles(spark, sf_dir))


STAGES = f"with {_IMPORTED}, {_ROLES} select distinct local, from_pkg, case when from_pkg in (select name from roles where role = 'Linked') then 'after' else 'before' end as stage from tab where known"


def bound_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = resolve.import_all(_imports(spark, sf_dir), _exports(spark, sf_dir)).where("known").select("local", "from_pkg").distinct()
    uses = _uses(spark, sf_dir).select("use", "name")
    closures = _exports(spark, sf_dir).where("package = 'n1' and export < 'f2'").select(F.col("export").alias("name"))
    return policy.bound_early(uses, closures, slots, _roles(spark, sf_dir))


EARLY = f"""with {_IMPORTED}, {_ROLES}, {_USES}, i as (select local as name, bool_or(from_pkg in (select name from roles where role = 'Linked')) as linked from (select distinct local, from_pkg from tab where known) x group by 1)
select use, u.name, u.name in (select export from exp where package = 'n1' and export < 'f2') or not coalesce(linked, false) as early from uses u left join i using (name)"""


def retained_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.retained_names(_uses(spark, sf_dir))
    return out.select("package", F.array_join("names", ",").alias("names"))


RETAINED = f"with {_USES} select package, string_agg(distinct name, ',' order by name) as names from uses group by 1"


def removed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.removed_names(_exports(spark, sf_dir).withColumnRenamed("export", "name"), _uses(spark, sf_dir).where("use % 3 = 0"))


REMOVED = f"with {_EXPORTS}, {_USES} select distinct package, export as name from exp where (package, export) not in (select (package, name) from uses where use % 3 = 0)"


def retention_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nations' suppliers ship to which other nations' customers."""
    l, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    owner = c.select(_name("c", "c_custkey").alias("node"), F.col("c_nationkey").alias("package")).union(s.select(_name("s", "s_suppkey"), "s_nationkey"))
    return policy.retention_edges(l.join(o, l.l_orderkey == o.o_orderkey).select(_name("s", "l_suppkey").alias("src"), _name("c", "o_custkey").alias("dst")), owner)


RETENTION = "select distinct s_nationkey as src, c_nationkey as dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey"


def unreached_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External packages that nothing ordered from reaches."""
    external = _roles(spark, sf_dir).where("role = 'External'").select("name")
    reached = _imports(spark, sf_dir).where("kind = 'all'").select(F.col("from_pkg").alias("name"))
    return policy.removed_names(external.withColumn("package", F.lit("x")), reached.withColumn("package", F.lit("x"))).select("name")


UNREACHED = f"with {_ROLES}, {_IMPORTS} select name from roles where role = 'External' and name not in (select from_pkg from imp where every)"


def native_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as native calls: selectors that a supplier's summary has under its own name or under an alias."""
    l, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    selectors = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use"), (F.col("l_suppkey") % 10).alias("component"), _name("s", F.col("l_partkey") % 100).alias("selector")).distinct()
    summaries = p.where("p_size > 20").select((F.col("p_partkey") % 10).alias("component"), _name("s", F.col("p_partkey") % 50).alias("selector"), F.col("p_type").alias("summary")).distinct()
    aliases = p.where("p_size <= 20").select((F.col("p_partkey") % 10).alias("component"), _name("s", F.col("p_partkey") % 100).alias("binding"), _name("s", F.col("p_partkey") % 50).alias("selector")).distinct()
    return policy.native_summaries(selectors, summaries, aliases)


SUMMARIES = """with u as (select distinct l_orderkey * 10 + l_linenumber as use, l_suppkey % 10 as c, 's' || (l_partkey % 100) as s from lineitem), m as (select distinct p_partkey % 10 as c, 's' || (p_partkey % 50) as s, p_type as summary from part where p_size > 20),
a as (select distinct p_partkey % 10 as c, 's' || (p_partkey % 100) as b, 's' || (p_partkey % 50) as s from part where p_size <= 20)
select use, summary from u join m on m.c = u.c and m.s = u.s union select use, summary from u join a on a.c = u.c and a.b = u.s join m on m.c = a.c and m.s = a.s"""


def produced_and_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive lines of an order as a call that makes a namespace and the one that takes it."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"))
    uses = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("producer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") + 1).alias("consumer"), F.lit(0).alias("index"))
    callees = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("call"), _name("f", F.col("part") % 9).alias("callee"))
    return policy.produced_and_used(uses, callees)


PRODUCED = """with c as (select l_orderkey * 10 + l_linenumber as call, 'f' || (min(l_partkey) % 9) as callee from lineitem group by l_orderkey, l_linenumber)
select a.call as producer, a.call + 1 as consumer, 0 as index, a.callee as made_by, b.callee as goes_to from c a left join c b on b.call = a.call + 1"""


def unregistered_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _uses(spark, sf_dir).select(F.col("use").alias("call"), "package", F.col("name").alias("binding"))
    return policy.unregistered(calls, _exports(spark, sf_dir).select("package", F.col("export").alias("method")))


NEXT = f"with {_USES}, {_EXPORTS} select use as call, package, name as binding from uses where (package, name) not in (select (package, export) from exp)"


def external_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as generics that suppliers' registrations may answer."""
    s, p = read(spark, sf_dir, "supplier"), read(spark, sf_dir, "part")
    registrations = s.select(_name("n", "s_nationkey").alias("package"), _name("g", F.col("s_suppkey") % 50).alias("generic"), F.when(F.col("s_acctbal") > 2000, _name("o", F.col("s_suppkey") % 5)).alias("generic_pkg"), _name("c", F.col("s_suppkey") % 4).alias("class"))
    generics = p.select(_name("g", "p_size").alias("generic"), _name("o", F.col("p_partkey") % 5).alias("owner"), F.when(F.col("p_retailprice") > 950, F.array(_name("c", F.col("p_partkey") % 4), F.lit("c9"))).alias("classes"))
    return policy.openings(registrations, generics)


OPENINGS = """with r as (select 'n' || s_nationkey as package, s_suppkey % 50 as g, case when s_acctbal > 2000 then s_suppkey % 5 end as o, s_suppkey % 4 as c from supplier)
select distinct 'g' || g as generic, package from r join part on p_size = g and (o is null or o = p_partkey % 5) and (p_retailprice <= 950 or c = p_partkey % 4)"""


def exported_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers as shown, each with its place; and the report by code."""
    o = read(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderstatus") == "P", "MissingDependency").otherwise(F.col("o_orderpriority"))
    rows = o.select(_name("n", F.col("o_custkey") % 25).alias("package"), code.alias("code"), F.when(F.col("o_orderstatus") == "F", _name("b", F.col("o_custkey") % 9)).alias("binding"), _name("m", "o_orderkey").alias("message"))
    return policy.exported_blockers(rows)


BLOCKERS = """select case when o_orderstatus = 'F' then 'n' || (o_custkey % 25) || '::b' || (o_custkey % 9) else 'n' || (o_custkey % 25) end as owner, o_orderpriority as code, 'm' || o_orderkey as message from orders where o_orderstatus <> 'P'"""


def build_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    rows = o.select(_name("n", F.col("o_custkey") % 25).alias("package"), F.col("o_orderpriority").alias("code"), F.lit(None).cast("string").alias("binding"), _name("m", F.col("o_orderkey") % 500).alias("message"))
    return emit.build_report(rows.union(rows)).select("code", "n", F.md5(F.col("text").cast("binary")).alias("text_md5"))


REPORTS = """with d as (select distinct o_orderpriority as code, 'n' || (o_custkey % 25) || ' m' || (o_orderkey % 500) as line from orders) select code, count(*) as n, md5(string_agg(line, chr(10) order by line)) as text_md5 from d group by 1"""


def blockers_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.col("user_id").cast("string").alias("message"))
    return report.by_code(e).select("code", F.array_join("messages", ",").alias("messages"), "n")


BY_CODE = "select event_type as code, string_agg(distinct user_id::varchar, ',' order by user_id::varchar) as messages, count(distinct user_id) as n from events group by 1"


def identity_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.identity_conflicts(read(spark, sf_dir, "part"), "p_name", "p_brand")


CONFLICTS = "select p_name, count(distinct p_brand) as identities from part group by 1 having count(distinct p_brand) > 1"


def ordered_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics in order, with the package before each."""
    e = read(spark, sf_dir, "customer").select(_name("n", "c_nationkey").alias("package"), F.col("c_mktsegment").alias("code"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("binding"), F.col("c_custkey").cast("string").alias("message"))
    return report.diagnostics_in_order(e).limit(20)


ORDERED = "select 'n' || c_nationkey as package, c_mktsegment as code, case when c_acctbal > 0 then c_name end as binding, c_custkey::varchar as message from customer order by package, code, binding nulls first, message limit 20"


def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that documents of each language mention."""
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("package"), "text")
    names = read(spark, sf_dir, "benchmark").select(F.explode(scalar.identifiers(F.col("text"))).alias("name")).distinct()
    return policy.mentioned(d, names.join(d.select("package").distinct(), F.lit(True)))


MENTIONED = """with b as (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9._]+')) as name from benchmark), d as (select distinct lang as package, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+')) as name from documents)
select package, name from d join b using (name) where package is not null"""


def changed_root_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, [".onLoad", ".provena_runtime", ".provena_root_on_load", ".onAttach", "x"]))
    return read(spark, sf_dir, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int")).alias("name")).withColumn("changed", policy.changed_in_root("name"))


CHANGED_ROOT = "select p_partkey, ['.onLoad', '.provena_runtime', '.provena_root_on_load', '.onAttach', 'x'][p_partkey % 5 + 1] as name, p_partkey % 5 < 3 as changed from part"


# sources and cache


def _listing(spark: SparkSession, sf_dir: str, column: str = "html") -> DataFrame:
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)
    return p.select(host.alias("package"), F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 9, "0")).alias("path"), F.octet_length(F.coalesce(column, F.lit(""))).cast("long").alias("bytes"), scalar.digest(F.coalesce(column, F.lit(""))).alias("digest"))


_LISTING = "l as (select regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as package, 'p' || lpad(page_id::varchar, 9, '0') as path, strlen(coalesce(html, '')) as bytes, sha256(coalesce(html, '')) as digest from pages)"


def image_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as packages, pages as their files."""
    return images.fingerprints(_listing(spark, sf_dir))


FINGERPRINTS = f"with {_LISTING} select package, sha256(from_hex(string_agg('0a00000000000000' || hex(encode(path)) || '4000000000000000' || hex(encode(digest)), '' order by path, digest))) as fingerprint, count(*) as files, sum(bytes)::bigint as bytes from l group by 1"


def image_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed, came or went between two snapshots of the pages."""
    before = _listing(spark, sf_dir).where("path < 'p000000200'")
    after = _listing(spark, sf_dir).where("path >= 'p000000020'").withColumn("digest", F.when(F.col("bytes") % 3 == 0, F.lit("new")).otherwise(F.col("digest")))
    return images.compared(before, after)


IMAGE_CHANGES = f"with {_LISTING} select package, path, case when path < 'p000000020' then 'missing' when path >= 'p000000200' then 'extra' when bytes % 3 = 0 then 'changed' else 'unchanged' end as state from l"


def copied_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source that are copied, and those of them that the installed package has too."""
    p = read(spark, sf_dir, "part")
    top = F.element_at(F.array(*map(F.lit, ["R", "inst", "man", "data", "extra", "DESCRIPTION"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    listing = p.select(F.lit("pkg").alias("package"), F.concat_ws("/", top, _name("f", "p_partkey")).alias("path"), "p_size")
    kept = images.resources(listing, list(policy.NOT_COPIED))
    return images.present_in_both(kept, listing.where("p_size > 25")).select("path")


COPIED = "select ['R', 'inst', 'man', 'data', 'extra', 'DESCRIPTION'][p_partkey % 6 + 1] || '/f' || p_partkey as path from part where p_partkey % 6 in (1, 4) and p_size > 25"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package indexes, one for each nation: customers are exports, suppliers imports, methods, native components and data sets."""
    n, c, s = (read(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    least = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_custkey").alias("least"))
    rows = c.join(least, F.col("c_nationkey") == F.col("k"))
    exports = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct(F.when(F.col("c_custkey") == F.col("least"), "").otherwise(_name("x", "c_custkey")).alias("key"), _name("f", "c_custkey").alias("value")))).alias("exports"))
    sk = F.col("s_suppkey")
    named = F.array(F.struct(F.when(sk % 2 == 0, _name("l", sk)).alias("local"), _name("r", sk).alias("remote")))
    imports = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.struct(_name("n", sk % 25).alias("package"), F.array(_name("e", sk)).alias("except"), F.when(sk % 3 != 0, named).alias("names")).alias("i")))), lambda x: x["i"])
    s3 = F.collect_list(F.struct(F.when(sk % 4 == 0, F.lit("base")).alias("generic_pkg"), F.lit("print").alias("generic"), _name("c", sk).alias("class"), _name("print.c", sk).alias("method")))
    routines = F.array(F.struct(F.lit("call").alias("table"), _name("go", sk).alias("name"), F.when(sk % 2 == 0, 2).alias("arity")))
    natives = F.collect_list(F.struct(_name("lib", sk).alias("component"), F.lit("").alias("alias"), F.lit("C_").alias("prefix"), F.lit(None).cast("string").alias("suffix"), F.when(sk % 2 == 0, "safe").otherwise("unknown").alias("safety"), F.array(_name("sym", sk)).alias("symbols"), routines.alias("routines")))
    data = F.map_from_entries(F.collect_list(F.struct(_name("set", sk).alias("key"), F.array(_name("d", sk), _name("e", sk)).alias("value"))))
    parts = s.groupBy(F.col("s_nationkey").alias("k")).agg(imports.alias("imports"), s3.alias("s3"), natives.alias("natives"), data.alias("data_sets"))
    out = n.select(F.col("n_nationkey").alias("k"), _name("n", "n_nationkey").alias("name"), F.concat(F.lit("1."), "n_nationkey").alias("version"), F.md5("n_name").alias("fingerprint"), F.when(F.col("n_regionkey") == 0, "base").alias("priority"), F.array(F.concat(F.lit("^"), "n_name")).alias("export_patterns"))
    return out.join(exports, "k", "left").join(parts, "k", "left").withColumn("bindings", F.map_values("exports")).drop("k")


def _read_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The indexes written as JSON and read with their fixed schema."""
    path = shared_path(spark, "index")
    _index(spark, sf_dir).write.json(path)
    return index.decode(index.read(spark, path))


def index_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["packages"]


def index_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["exports"]


def index_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.transform("names", lambda x: F.concat_ws("=", x["local"], x["remote"]))
    return _read_index(spark, sf_dir)["imports"].select("package", "pos", "kind", "from_pkg", F.array_join("except", ",").alias("except"), F.array_join(names, ",").alias("names"))


def index_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["s3"]


def index_natives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["natives"]


def index_routines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["routines"]


def index_data_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_index(spark, sf_dir)["data_sets"].select("package", "set", F.array_join("objects", ",").alias("objects"))


INDEX_SQL = {
    "index_packages": "select 'n' || n_nationkey as name, '1.' || n_nationkey as version, md5(n_name) as fp, case when n_regionkey = 0 then 'base' end as priority, false as root_flag from nation",
    "index_exports": "with l as (select c_nationkey as k, min(c_custkey) as least from customer group by 1) select 'n' || c_nationkey as package, case when c_custkey = least then 'f' || c_custkey else 'x' || c_custkey end as export, 'f' || c_custkey as binding from customer join l on k = c_nationkey",
    "index_imports": "select 'n' || s_nationkey as package, (row_number() over (partition by s_nationkey order by s_suppkey) - 1)::int as pos, case when s_suppkey % 3 = 0 then 'all' else 'from' end as kind, 'n' || (s_suppkey % 25) as from_pkg, 'e' || s_suppkey as \"except\", case when s_suppkey % 3 <> 0 then case when s_suppkey % 2 = 0 then 'l' else 'r' end || s_suppkey || '=r' || s_suppkey end as names from supplier",
    "index_methods": "select 'n' || s_nationkey as package, case when s_suppkey % 4 = 0 then 'base' end as generic_pkg, 'print' as generic, 'c' || s_suppkey as class, 'print.c' || s_suppkey as method from supplier",
    "index_natives": "with s as (select 'n' || s_nationkey as package, 'lib' || s_suppkey as component, s_suppkey as k, case when s_suppkey % 2 = 0 then 'safe' else 'unknown' end as safety from supplier) select package, component, 'sym' || k as symbol, safety from s union all select package, component, 'C_go' || k, safety from s",
    "index_routines": "select 'n' || s_nationkey as package, 'lib' || s_suppkey as component, 'call' as \"table\", 'go' || s_suppkey as name, case when s_suppkey % 2 = 0 then 2 end::int as arity from supplier",
    "index_data_sets": "select 'n' || s_nationkey as package, 'set' || s_suppkey as set, 'd' || s_suppkey || ',e' || s_suppkey as objects from supplier",
}


def index_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes that differ from what was located, that were not, or that come twice."""
    i = _index(spark, sf_dir).select("name", "version", "fingerprint")
    found = i.where("name <> 'n24'").withColumn("fingerprint", F.when(F.col("name") == "n3", "x").otherwise(F.col("fingerprint")))
    return index.violations(i.union(i.where("name = 'n5'")), found)


VIOLATIONS = "select name, problem from (values ('n24', 'identity differs'), ('n3', 'identity differs'), ('n5', 'indexed twice')) v(name, problem) where exists (select 1 from nation)"


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    routines = F.when(k % 5 != 0, F.array(F.struct(_name("go", k).alias("selector"), F.array((k % 3).cast("int")).alias("callback_arguments")), F.struct(F.when(k % 4 == 0, _name("go", k)).otherwise(_name("other", k)).alias("selector"), F.array(F.lit(1)).alias("callback_arguments"))))
    c = s.groupBy("s_nationkey").agg(F.collect_list(F.struct(_name("lib", k).alias("component"), F.lit("declared").alias("safety"), routines.alias("routines"))).alias("components"))
    p = c.select(_name("n", "s_nationkey").alias("name"), F.concat(F.lit("1."), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).otherwise(99)).alias("version"), F.md5(F.concat(F.lit("NATION_"), "s_nationkey")).alias("fingerprint"), "components")
    path = shared_path(spark, "manifest")
    p.agg(F.lit(1).alias("schema"), F.collect_list(F.struct("*")).alias("packages")).coalesce(1).write.json(path)
    return index.manifest(spark, path)


def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.manifest_violations(_manifest(spark, sf_dir))


MANIFEST = """select 'n' || s_nationkey as name, 'lib' || s_suppkey as component, 'selector comes twice' as problem from supplier where s_suppkey % 5 <> 0 and s_suppkey % 4 = 0
union all select 'n' || s_nationkey, 'lib' || s_suppkey, 'callback positions count from one' from supplier where s_suppkey % 5 <> 0 and s_suppkey % 3 = 0"""


def applied_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safety of components after a manifest whose identities hold for every other package."""
    t = _read_index(spark, sf_dir)
    return index.apply_manifest(t["natives"], t["packages"], _manifest(spark, sf_dir)).select("package", "component", "safety").distinct()


APPLIED = "select 'n' || s_nationkey as package, 'lib' || s_suppkey as component, case when s_nationkey % 2 = 0 then 'declared' when s_suppkey % 2 = 0 then 'safe' else 'unknown' end as safety from supplier"


def object_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as objects, with nations, customers and orders inside them; and members that are no plain data."""
    e = _chain(spark, sf_dir)
    objects = e.select(F.col("dst").alias("object"), F.col("src").alias("parent")).union(e.where("src like 'region:%'").select("src", F.lit(None).cast("string")).distinct())
    found = cut(index.members(objects), "members")
    kinds = objects.select("object", F.split_part("object", F.lit(":"), F.lit(1)).alias("kind"))
    return index.not_passive(found, kinds, ["order", "customer"]).select("object", "member", "parent", F.col("depth").cast("int").alias("depth"), "kind")


MEMBERS = "select 'region:' || n_regionkey as object, 'nation:' || n_nationkey as member, 'region:' || n_regionkey as parent, 1::int as depth, 'nation' as kind from nation union select 'region:' || n_regionkey, 'region:' || n_regionkey, null, 0, 'region' from nation"


def object_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    parent = F.when(F.col("p_size") == 1, F.col("p_partkey")).when(F.col("p_size") == 2, -1).otherwise(F.floor(F.col("p_partkey") / 2))
    objects = p.select(F.col("p_partkey").alias("object"), parent.cast("long").alias("parent"), F.lit("list").alias("kind"))
    return policy.object_problems(objects.union(objects.where("parent = 10")))


PROBLEMS = """select p_partkey as object, 'its own parent' as problem from part where p_size = 1 or (p_size <> 2 and p_partkey = 0) union select p_partkey, 'no such parent' from part where p_size = 2
union select p_partkey, 'comes twice' from part where case when p_size = 1 then p_partkey when p_size = 2 then -1 else p_partkey // 2 end = 10"""


def _cache(spark: SparkSession, sf_dir: str) -> tuple[Cache, int, int]:
    """Documents of the first source are published, then all; entries are named by their text's digest."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    name = scalar.cache_name(F.coalesce("lang", F.lit("none")), scalar.digest("text"), F.lit(None).cast("string"), F.lit("text"))
    rows = d.select(name.alias("name"), F.col("text").cast("binary").alias("bytes"), "source")
    cache = Cache(spark, shared_path(spark, "cache"))
    return cache, cache.publish(rows.where("source = 'src0'")), cache.publish(rows)


_CACHED = f"c as (select distinct coalesce(lang, 'none') || '-' || sha256(text) || '.text.{scalar.ENTRY_SUFFIX}' as name, coalesce(lang, 'none') as package, text, source from documents where text is not null)"


def cache_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first and the second publication wrote, and all entries."""
    cache, first, second = _cache(spark, sf_dir)
    return cache.listing().withColumn("first", F.lit(first).cast("long")).withColumn("second", F.lit(second).cast("long")).withColumn("length", F.col("length").cast("long"))


PUBLISH = f"with {_CACHED} select name, any_value(strlen(text))::bigint as length, (select count(distinct name) from c where source = 'src0') as first, (select count(distinct name) from c) - (select count(distinct name) from c where source = 'src0') as second from c group by name"


def cache_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses: half the asked names are not there."""
    cache, _, _ = _cache(spark, sf_dir)
    names = cache.listing().select("name")
    got = cache.read(names.union(names.select(F.concat(F.lit("no-"), "name"))))
    return got.select("name", F.md5("bytes").alias("bytes_md5"))


CACHE_READ = f"with {_CACHED} select name, md5(text) as bytes_md5 from c group by name, text union all select 'no-' || name, null from c group by name"


def cache_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, _, _ = _cache(spark, sf_dir)
    return cache.report().select("package", "kind", "entries", F.col("bytes").cast("long").alias("bytes"))


CACHE_REPORT = f"with {_CACHED}, d as (select distinct name, package, strlen(text) as n from c) select package, 'text' as kind, count(*) as entries, sum(n)::bigint as bytes from d group by 1"


def cache_without(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays when one language's entries are removed, and how many went."""
    cache, _, _ = _cache(spark, sf_dir)
    other, gone = cache.without(F.col("name").startswith("en-"), shared_path(spark, "cache"))
    return other.listing().select("name", F.lit(gone).cast("long").alias("gone"))


CACHE_WITHOUT = f"with {_CACHED} select distinct name, (select count(distinct name) from c where name like 'en-%') as gone from c where name not like 'en-%'"


# emitted texts


def namespace_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read_index(spark, sf_dir)
    lines = emit.namespace_lines(t["exports"], t["imports"], t["natives"], t["s3"])
    return emit.text(lines, ["package"]).select("package", F.md5(F.col("text").cast("binary")).alias("text_md5"))


NAMESPACES = f"""with ex as ({INDEX_SQL["index_exports"]}), im as ({INDEX_SQL["index_imports"]}),
l as (select package, 1 as s, 0 as o, 'export("' || export || '")' as line from ex
union all select package, 2, pos, case when kind = 'all' then 'import("' || from_pkg || '")' else 'importFrom("' || from_pkg || '", ' || case when split_part(names, '=', 1) = split_part(names, '=', 2) then '"' || split_part(names, '=', 2) || '"' else '"' || split_part(names, '=', 1) || '" = "' || split_part(names, '=', 2) || '"' end || ')' end from im
union all select 'n' || s_nationkey, 3, 0, 'useDynLib("lib' || s_suppkey || '")' from supplier union all select 'n' || s_nationkey, 4, 0, 'S3method("print", "c' || s_suppkey || '", "print.c' || s_suppkey || '")' from supplier)
select package, md5(string_agg(line, chr(10) order by s, o, line)) as text_md5 from l group by 1"""


def method_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = emit.s3_matrix(_read_index(spark, sf_dir)["s3"])
    return out.select("package", "rows", F.array_join("cells", ",").alias("cells"))


MATRIX = """with s as (select 'n' || s_nationkey as package, 'c' || s_suppkey as c, case when s_suppkey % 4 = 0 then 'base' else '' end as h from supplier)
select package, count(*)::int as rows, string_agg('print', ',') || ',' || string_agg(c, ',' order by c) || ',' || string_agg('print.' || c, ',' order by c) || ',' || string_agg(h, ',' order by c) as cells from s group by 1"""


def description_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewritten descriptions and their problems in one table."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    field = lambda name, value: n.select(_name("n", k).alias("package"), F.lit(name).alias("field"), value.alias("value"))
    fields = field("Title", F.col("n_name")).union(field("Collate", F.lit("a.R b.R"))).union(field("Suggests", F.concat(F.lit("n2 (>= 1.0), n3, n"), k, F.lit(", "), F.lit("zed")))).union(field("Depends", F.concat(F.lit("R (>= 3.5), n"), k + 1))).union(field("LinkingTo", F.when(k % 2 == 0, "(bad").otherwise("cpp"))).union(field("Imports", F.lit("old")))
    imports = n.select(_name("n", k).alias("package"), F.lit("methods").alias("text")).union(n.select(_name("n", k), F.lit("base (>= 1)")))
    new, problems = emit.description(fields, _roles(spark, sf_dir), imports)
    return new.unionByName(problems.select("package", F.concat(F.lit("problem:"), "field").alias("field"), F.col("problem").alias("value")))


DESCRIPTION = f"""with {_ROLES}, lk as (select name from roles where role = 'Linked'), n as (select n_nationkey as k, 'n' || n_nationkey as package, n_name from nation)
select package, 'Title' as field, n_name as value from n union all select package, 'Depends', 'R (>= 3.5), n' || (k + 1) from n union all select package, 'LinkingTo', case when k % 2 = 0 then '(bad' else 'cpp' end from n
union all select package, 'Imports', 'base (>= 1), methods' from n
union all select package, 'Suggests', concat_ws(', ', case when 'n2' not in (select name from lk) then 'n2 (>= 1.0)' end, case when 'n3' not in (select name from lk) then 'n3' end, case when package not in (select name from lk) then package end, 'zed') from n
union all select package, 'problem:Depends', 'names the linked package n' || (k + 1) from n where 'n' || (k + 1) in (select name from lk)
union all select package, 'problem:LinkingTo', 'cannot be read: (bad' from n where k % 2 = 0"""


def binding_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", emit.binding_reference(_name("n", "c_nationkey"), F.col("c_name"), F.col("c_acctbal") > 0).alias("text"))


REFERENCES = """select c_custkey, case when c_acctbal > 0 then 'base::getExportedValue("n' || c_nationkey || '", "' || c_name || '")' else 'base::get("' || c_name || '", envir = base::asNamespace("n' || c_nationkey || '"), inherits = FALSE)' end as text from customer"""


def imports_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit.imports_info(_imports(spark, sf_dir).where("kind = 'from'"))


INFOS = f"""with {_IMPORTS} select package, 'list(base = TRUE, ' || string_agg('"' || from_pkg || '" = structure(as.character(c("f' || (k % 40) || '", "f' || (k * 3 % 40) || '")), names = as.character(c("f' || (k % 40) || '", "f' || (k * 7 % 40) || '")))', ', ' order by pos) || ')' as text from imp where not every group by 1"""


def bootstrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text that brings up all packages, one line a row with its number."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    activations = n.select(_name("n", k).alias("package"), F.lit("1.0").alias("version"), (k % 2 == 0).alias("hook"))
    natives = read(spark, sf_dir, "supplier").select(_name("n", "s_nationkey").alias("package"), _name("lib", "s_suppkey").alias("component"))
    slots = n.select(_name("n", k).alias("package"), F.lit("f").alias("local"), F.lit("dep").alias("from_pkg"), F.lit("g").alias("remote"), F.when(k % 3 == 0, "Removed").otherwise("Bound").alias("state"), (k % 2 == 0).alias("external"))
    closures = n.select(_name("n", k).alias("package"), F.concat(F.lit('f <- "'), "n_name", F.lit('"')).alias("source"))
    texts = emit.text(emit.activation_lines(activations, natives, slots, closures), ["package"])
    text = emit.bootstrap(texts, n.select(_name("n", k).alias("package"), (-k).alias("position")))
    return text.select(F.posexplode(F.split("text", "\n")).alias("line", "text"))


BOOTSTRAP = r"""with n as (select n_nationkey as k, 'n' || n_nationkey as p, n_name from nation),
l as (select p, k, 1 as s, 'ns <- new_namespace("' || p || '", "1.0")' as line from n union all select 'n' || s_nationkey, s_nationkey, 2, '  load_native(ns, "lib' || s_suppkey || '")' from supplier
union all select p, k, 3, case when k % 3 = 0 then '  removed(imports, "f", "dep::g")' else '  assign("f", ' || case when k % 2 = 0 then 'base::getExportedValue("dep", "g")' else 'base::get("g", envir = base::asNamespace("dep"), inherits = FALSE)' end || ', envir = imports)' end from n
union all select p, k, 4, '  eval(parse(text = "f <- \"' || n_name || '\""), envir = ns)' from n union all select p, k, 5, 'activate(ns, ' || case when k % 2 = 0 then 'TRUE' else 'FALSE' end || ')' from n),
a as (select k, string_agg(line, chr(10) order by s, line) as t from l where k in (select k from n) group by k),
w as (select 'bootstrap <- function(root) {' || chr(10) || string_agg('  namespaces[["n' || k || '"]] <- empty()', chr(10) order by -k) || chr(10) || string_agg('  local({' || chr(10) || t || chr(10) || '  })', chr(10) order by -k) || chr(10) || '}' as t from a),
u as (select string_split(t, chr(10)) as x from w) select (unnest(generate_series(1, len(x))) - 1)::int as line, unnest(x) as text from u"""


# spans and relocations


def inert_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events outside every ten hours after an error of their user."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), "event_type", seconds("ts").alias("start")).withColumn("end", F.col("start") + 1)
    regions = e.where("event_type = 'error'").select("source", "start", (F.col("start") + 36_000).alias("end"), F.col("event_id").alias("region"))
    return spans.outside(e, regions, ["event_id"], 4_096).select("event_id", "source")


INERT = """with e as (select event_id, user_id, event_type, epoch(ts)::bigint as s from events) select event_id, user_id as source from e where not exists (select 1 from e r where r.event_type = 'error' and r.user_id = e.user_id and r.s <= e.s and e.s + 1 <= r.s + 36000)"""


def long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of overlapping spans of a user's events whose lengths differ by four orders of magnitude, counted."""
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("source"), seconds("ts").alias("start"))
    e = e.withColumn("end", F.col("start") + F.pow(F.lit(10), 2 + F.col("id") % 5).cast("long"))
    pairs = spans.overlapping(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 256)
    return pairs.groupBy("a_id").agg(F.count("*").alias("n"), F.min("b_id").alias("least"))


LONG_SPANS = """with e as (select event_id as id, user_id as u, epoch(ts)::bigint as s, epoch(ts)::bigint + (10 ** (2 + event_id % 5))::bigint as t from events)
select a.id as a_id, count(*) as n, min(b.id) as least from e a join e b on a.u = b.u and a.id % 2 = 0 and b.id % 2 = 1 and a.s < b.t and b.s < a.t group by 1"""


def misplaced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.unix_timestamp("o_orderdate").alias("start"), "o_orderkey")
    o = o.withColumn("start", F.col("start") + F.col("o_orderkey") % 997).withColumn("end", F.col("start") + 40 * 86_400)
    return spans.misplaced(o).select("o_orderkey")


MISPLACED = """with o as (select o_custkey as c, o_orderkey as k, epoch(o_orderdate)::bigint + o_orderkey % 997 as s from orders) select k as o_orderkey from (select k, s, max(s + 3456000) over (partition by c order by s, s + 3456000 rows between unbounded preceding and 1 preceding) as reached from o) x where s < reached"""


def _plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rewrites of the first word of each part's name, by kind."""
    p = read(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ["binding", "internal_binding", "require_namespace", "namespace", "loaded_query", "native_symbol", "package_version", "resource", "absent_resource", "dataset"]))
    kind = F.element_at(kinds, (F.col("p_partkey") % 10 + 1).cast("int"))
    end = F.when(F.col("p_size") == 50, 999).otherwise(F.octet_length(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return p.select(F.col("p_partkey").cast("string").alias("source"), F.lit(0).alias("start"), end.cast("int").alias("end"), kind.alias("kind"), _name("n", F.col("p_size") % 25).alias("package"), F.col("p_brand").alias("name"), F.lit("lib").alias("component"), F.lit("call").alias("table"), (F.col("p_size") > 20).alias("flag"))


_TEXTS = """case p_partkey % 10 when 0 then 'base::getExportedValue(base::asNamespace("' || n || '"), "' || p_brand || '")' when 1 then 'base::get("' || p_brand || '", envir = base::asNamespace("' || n || '"), inherits = FALSE)'
when 2 then case when p_size > 20 then 'base::invisible(TRUE)' else 'base::invisible(FALSE)' end when 3 then 'base::asNamespace("' || n || '")' when 4 then 'TRUE' when 5 then 'base::getDLLRegisteredRoutines(base::getLoadedDLLs()[["lib"]])[["call"]][["' || p_brand || '"]]'
when 6 then 'base::package_version("' || p_brand || '")' when 7 then 'base::system.file("resources", "' || n || '", "' || p_brand || '", package = "root")' when 8 then '""' else 'base::getExportedValue(base::asNamespace("' || n || '"), "' || p_brand || '")' end"""


def rewritten_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), F.col("p_name").alias("text"))
    return relocate.rewritten(_plans(spark, sf_dir), sources, "root")


REWRITTEN = f"with p as (select *, 'n' || (p_size % 25) as n from part) select p_partkey::varchar as source, case when p_size < 50 then {_TEXTS} || substr(p_name, length(split_part(p_name, ' ', 1)) + 1) end as text from p"


def rejected_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("source"), F.col("p_name").alias("text"))
    carried = read(spark, sf_dir, "part").where("p_size % 2 = 0").select(_name("n", F.col("p_size") % 25).alias("package"), F.col("p_brand").alias("name")).distinct()
    return relocate.rejected(_plans(spark, sf_dir), sources, carried).select("source", "problem")


REJECTED = """select p_partkey::varchar as source, 'outside its code' as problem from part where p_size = 50
union all select p_partkey::varchar, 'names a dataset that is not carried' from part where p_partkey % 10 = 9 and (p_size % 25, p_brand) not in (select (p_size % 25, p_brand) from part where p_size % 2 = 0)"""


def needed_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relocate.needed(_plans(spark, sf_dir), _roles(spark, sf_dir)).select("source", "kind")


NEEDED = f"with {_ROLES}, p as (select p_partkey::varchar as source, ['binding', 'internal_binding', 'require_namespace', 'namespace', 'loaded_query', 'native_symbol', 'package_version', 'resource', 'absent_resource', 'dataset'][p_partkey % 10 + 1] as kind, 'n' || (p_size % 25) as n from part) select source, kind from p where kind = 'package_version' or n in (select name from roles where role = 'Linked')"


# orders and trees


def load_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-first post-order of regions, nations and customers below one root."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    e = r.select(F.lit("all").alias("src"), _name("r", "r_regionkey").alias("dst"), F.col("r_regionkey").alias("pos")).union(n.select(_name("r", "n_regionkey"), _name("n", "n_nationkey"), "n_nationkey")).union(c.select(_name("n", "c_nationkey"), _name("c", "c_custkey"), "c_custkey"))
    return graph.load_order(e.withColumn("root", F.col("src") == "all"))


LOAD_ORDER = """with x as (select 'all' as node, '~' as path union all select 'r' || r_regionkey, lpad(r_regionkey::varchar, 9, '0') || '~' from region union all select 'n' || n_nationkey, lpad(n_regionkey::varchar, 9, '0') || lpad(n_nationkey::varchar, 9, '0') || '~' from nation
union all select 'c' || c_custkey, lpad(n_regionkey::varchar, 9, '0') || lpad(n_nationkey::varchar, 9, '0') || lpad(c_custkey::varchar, 9, '0') || '~' from customer join nation on c_nationkey = n_nationkey)
select node, row_number() over (order by path) - 1 as position from x"""


def activation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations in order of their key, each behind the last of its region, and two that wait for each other."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    nodes = n.select(_name("n", k).alias("node"), k.alias("preferred"))
    needs = n.select(_name("n", k).alias("node"), F.when(k == 20, _name("n", F.lit(21))).when(k == 21, _name("n", F.lit(20))).when(k < 20, _name("n", 20 + k % 5)).alias("needs")).where("needs is not null")
    return graph.activation_order(nodes, needs)


ORDER = """with recursive n as (select n_nationkey as k, case when n_nationkey = 20 then 21 when n_nationkey = 21 then 20 when n_nationkey < 20 then 20 + n_nationkey % 5 end as need from nation),
l as (select list({'k': k, 'need': need} order by k) as x from n),
s(done, i, broke) as (select []::int[], 0, false union all select list_append(done, coalesce(ready, free)), i + 1, ready is null from (select done, i, list_filter(x, lambda e: not list_contains(done, e.k) and (e.need is null or list_contains(done, e.need)))[1].k as ready, list_filter(x, lambda e: not list_contains(done, e.k))[1].k as free from s, l where i < len(x)) y)
select 'n' || done[i] as node, i - 1 as position, broke as broke_cycle from s where i > 0"""


def spanning_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first trees over the chain of regions, nations, customers and orders with one region as root, and what it doesn't reach."""
    e = _chain(spark, sf_dir)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return graph.spanning_tree(e, nodes, "region:3").select("node", "parent", "depth")


FOREST = f"""with recursive {_CHAIN}, r(scope, ancestor, depth) as (select x, x, 0::bigint from (select src as x from e union select dst from e) union select r.scope, e.src, depth + 1 from r join e on e.dst = r.ancestor),
o as (select scope as node, case when bool_or(ancestor = 'region:3') then 'region:3' else min(ancestor) end as owner from r group by 1)
select node, case when owner <> node then e.src end as parent, r.depth from o join r on r.scope = node and r.ancestor = owner left join e on e.dst = node"""


def reached_environments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Environments that one is enclosed in, upwards, and those of them in other packages where the way leaves its own."""
    up = _chain(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    roots = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(_name("order:", "o_orderkey").alias("node"))
    return graph.reach(up, roots)


ENVIRONMENTS = f"""with recursive {_CHAIN}, r(node) as (select 'order:' || o_orderkey from orders where o_orderpriority = '1-URGENT' union select e.src from r join e on e.dst = r.node) select node from r"""


def crossing_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach inside the regions' own nations, up to the first customer with a negative account, which belongs elsewhere."""
    e = _chain(spark, sf_dir)
    poor = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(_name("customer:", "c_custkey").alias("node"), F.lit("poor").alias("package"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    owner = nodes.join(poor, "node", "left").select("node", F.coalesce("package", F.lit("own")).alias("package"))
    return graph.crossing(e, owner, e.where("src like 'region:%'").select(F.col("src").alias("node")).distinct())


CROSSING = "select distinct 'own' as package, 'poor' as foreign from customer where c_acctbal < 0"


#: Queries with their SQL, or those whose SQL stands in ``INDEX_SQL``.
_ALL = {
    import_table: IMPORT_TABLE, import_lookup: IMPORT_LOOKUP, definitions: DEFINITIONS, scope_ancestors: ANCESTORS, visible_domains: VISIBLE, shadowed_names: SHADOWED, name_origin: ORIGIN, selected_methods: METHODS, located_packages: LOCATED, changed_packages: CHANGED,
    declared_dependencies: DECLARED, guard_states: GUARD_STATES, established_namespaces: ESTABLISHED, discovered_packages: DISCOVERED, consulted_packages: CONSULTED, request_batches: BATCHES, platform_packages: "select n_name, n_regionkey = 0 as platform from nation", resource_accesses: RESOURCES,
    external_contracts: CONTRACTS, attached_imports: ATTACHED, load_stages: STAGES, bound_early: EARLY, retained_names: RETAINED, removed_names: REMOVED, retention_edges: RETENTION, unreached_external: UNREACHED, native_summaries: SUMMARIES, produced_and_used: PRODUCED,
    unregistered_next: NEXT, external_openings: OPENINGS, exported_blockers: BLOCKERS, build_reports: REPORTS, blockers_by_code: BY_CODE, identity_conflicts: CONFLICTS, ordered_diagnostics: ORDERED, mentioned_names: MENTIONED, changed_root_names: CHANGED_ROOT,
    image_fingerprints: FINGERPRINTS, image_changes: IMAGE_CHANGES, copied_resources: COPIED, index_packages: None, index_exports: None, index_imports: None, index_methods: None, index_natives: None, index_routines: None, index_data_sets: None, index_violations: VIOLATIONS,
    manifest_violations: MANIFEST, applied_manifest: APPLIED, object_members: MEMBERS, object_problems: PROBLEMS, cache_publish: PUBLISH, cache_read: CACHE_READ, cache_report: CACHE_REPORT, cache_without: CACHE_WITHOUT,
    namespace_texts: NAMESPACES, method_matrix: MATRIX, description_fields: DESCRIPTION, binding_references: REFERENCES, imports_infos: INFOS, bootstrap_text: BOOTSTRAP, inert_facts: INERT, long_spans: LONG_SPANS, misplaced_spans: MISPLACED,
    rewritten_code: REWRITTEN, rejected_rewrites: REJECTED, needed_rewrites: NEEDED, load_order: LOAD_ORDER, activation_order: ORDER, spanning_forest: FOREST, reached_environments: ENVIRONMENTS, crossing_packages: CROSSING,
}
QUERIES = {f.__name__: (f, sql or INDEX_SQL[f.__name__]) for f, sql in _ALL.items()}
