"""Registered queries of the front end: R functions written from customers, and the facts that their text must have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.frontend import facts
from provena.queries.graphs import read

#: A function per customer: a guarded access, whose other branch leaves, binds too, or is absent; a super-assignment; a call.
_TEXT = """concat('f', c_custkey, ' <- function(x, n = ', c_custkey, 'L) {{', {nl}, '  if (requireNamespace("p', c_custkey % 5, '")) y <- p', c_custkey % 5, '::g(x)', case c_custkey % 3 when 1 then ' else stop("no")' when 2 then ' else y <- 1' else '' end, {nl}, '  z <<- y', {nl}, '  h', c_custkey % 7, '(y, u', c_custkey % 4, ' + n)', {nl}, '}}')"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("n"), "c_nationkey").alias("package"), F.concat(F.lit("f"), "c_custkey").alias("source_key"), F.expr(_TEXT.format(nl="char(10)")).alias("text"))


def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All facts of all functions."""
    return facts.extract(sources(spark, sf_dir)).select("source_key", "kind", "name", "target", "guard", "start")


FACTS = f"""with c as (select 'f' || c_custkey as source_key, c_custkey as k, c_custkey % 3 as alt, 'p' || (c_custkey % 5) as p, 'h' || (c_custkey % 7) as h, 'u' || (c_custkey % 4) as u, {_TEXT.format(nl="chr(10)")} as t from customer),
x as (select *, strpos(t, 'function') - 1 as fn, strpos(t, 'requireNamespace') - 1 as rn, strpos(t, 'y <- p') - 1 as yp, strpos(t, '::g(') - 1 as gg, strpos(t, 'z <<- y') - 1 as zy, strpos(t, chr(10) || '  h') + 2 as hh, case when alt = 0 then 'conditional' else 'bound' end as state from c)
select source_key, 'function' as kind, null as name, null as target, null as guard, fn as start from x
union all select source_key, 'pinned_default', 'n', '{{"number": "' || k || 'L"}}', null, strpos(t, 'n = ') + 3 from x union all select source_key, 'if', null, null, null, strpos(t, 'if (') - 1 from x
union all select source_key, 'use', 'requireNamespace', 'external', null, rn from x union all select source_key, 'reference', 'requireNamespace', 'callee', null, rn from x union all select source_key, 'call', 'requireNamespace', null, null, rn from x
union all select source_key, 'guard', p, 'requireNamespace', p, yp from x union all select source_key, 'access', 'g', p, p, yp + 5 from x union all select source_key, 'call', 'g', p, p, yp + 5 from x
union all select source_key, 'use', 'x', 'bound', p, gg + 4 from x union all select source_key, 'definition', 'y', null, p, yp from x
union all select source_key, 'use', 'stop', 'external', null, strpos(t, 'stop(') - 1 from x where alt = 1 union all select source_key, 'reference', 'stop', 'callee', null, strpos(t, 'stop(') - 1 from x where alt = 1
union all select source_key, 'call', 'stop', null, null, strpos(t, 'stop(') - 1 from x where alt = 1 union all select source_key, 'no_return', 'stop', null, null, strpos(t, 'stop(') - 1 from x where alt = 1
union all select source_key, 'definition', 'y', null, null, strpos(t, 'else y <- 1') + 4 from x where alt = 2
union all select source_key, 'use', 'y', state, null, zy + 6 from x union all select source_key, 'super_assignment', 'z', null, null, zy from x
union all select source_key, 'use', h, 'external', null, hh from x union all select source_key, 'reference', h, 'callee', null, hh from x union all select source_key, 'call', h, null, null, hh from x
union all select source_key, 'use', 'y', state, null, hh + 3 from x union all select source_key, 'reference', 'y', 'maybe_local', null, hh + 3 from x where alt = 0
union all select source_key, 'operator', '+', null, null, hh + 6 from x union all select source_key, 'use', u, 'external', null, hh + 6 from x union all select source_key, 'reference', u, 'free', null, hh + 6 from x
union all select source_key, 'use', 'n', 'bound', null, hh + 11 from x union all select source_key, 'used_parameters', null, 'n,x', null, fn from x union all select source_key, 'definition', source_key, null, null, 0 from x"""


def source_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the places and literal values of their arguments."""
    calls = facts.extract(sources(spark, sf_dir)).where("kind = 'call'")
    arguments = F.from_json(F.get_json_object("detail", "$.arguments"), "array<struct<name:string,static:struct<string:string,symbol:string,number:string>,start:long,end:long>>")
    return calls.select("source_key", F.col("name").alias("callee"), F.posexplode(arguments).alias("pos", "a")).select("source_key", "callee", "pos", F.col("a.static.string").alias("string"), F.col("a.static.symbol").alias("symbol"), (F.col("a.end") - F.col("a.start")).alias("length"))


ARGUMENTS = """with c as (select 'f' || c_custkey as source_key, c_custkey % 3 as alt, 'p' || (c_custkey % 5) as p, 'h' || (c_custkey % 7) as h from customer)
select source_key, 'requireNamespace' as callee, 0 as pos, p as string, null as symbol, 4::bigint as length from c union all select source_key, 'g', 0, null, 'x', 1 from c union all select source_key, 'stop', 0, 'no', null, 4 from c where alt = 1
union all select source_key, h, 0, null, 'y', 1 from c union all select source_key, h, 1, null, null, 6 from c"""


def source_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are no programs, or only by chance: what the parser says of their first lines, cut off inside a call."""
    d = read(spark, sf_dir, "customer").select(F.lit("p").alias("package"), F.col("c_name").alias("source_key"), F.concat(F.lit("f("), F.when(F.col("c_acctbal") > 0, F.lit("1")).otherwise(F.lit("1)")), F.lit("\n")).alias("text"))
    found = facts.extract(d).where("kind in ('issue', 'call')")
    return found.select("source_key", "kind", "target", "start")


PROBLEMS = "select c_name as source_key, case when c_acctbal > 0 then 'issue' else 'call' end as kind, case when c_acctbal > 0 then 'expected )' end as target, case when c_acctbal > 0 then 4 else 0 end as start from customer"

_ALL = {source_facts: FACTS, source_arguments: ARGUMENTS, source_problems: PROBLEMS}
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL.items()}
