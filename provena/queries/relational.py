"""Registered queries of the resolution, span, report and scalar operators on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar
from provena.operators import report, resolve, spans
from provena.queries.graphs import ORDER, read, seconds

_LINE_ORDER = [c.strip() for c in ORDER.split(",")]


def last_wins_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.last_wins(read(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER).select("l_orderkey", "l_partkey", "l_suppkey")


LAST_WINS = f"""select l_orderkey, l_partkey, l_suppkey from lineitem
qualify row_number() over (partition by l_orderkey order by {", ".join(c + " desc" for c in _LINE_ORDER)}) = 1"""


def priority_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's account: that of its least supplier, else of its least customer, else none."""
    uses = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), "n_name")
    suppliers = read(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("target"))
    customers = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("target"))
    return resolve.cascade(uses, [("supplier", suppliers), ("customer", customers)], ["key"])


PRIORITY = """with s as (select s_nationkey as key, min(s_suppkey) as target from supplier where s_acctbal > 5000 group by 1), c as (select c_nationkey as key, min(c_custkey) as target from customer where c_mktsegment = 'BUILDING' group by 1)
select n_nationkey as key, n_name, coalesce(s.target, c.target) as target, case when s.key is not null then 'supplier' when c.key is not null then 'customer' end as found_in
from nation left join s on s.key = n_nationkey left join c on c.key = n_nationkey"""


def scope_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's size limit from the nearest scope that sets one: the part, its brand, its type."""
    parts = read(spark, sf_dir, "part")
    chain = parts.select(F.concat(F.lit("p"), "p_partkey").alias("scope"), F.posexplode(F.array(F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("t"), "p_type"))).alias("depth", "ancestor"))
    own = parts.where("p_size > 45").select(F.concat(F.lit("p"), "p_partkey").alias("scope"), F.lit("limit").alias("name"), F.col("p_size").alias("target"))
    brand = parts.where("p_brand like '%3'").groupBy(F.concat(F.lit("b"), "p_brand").alias("scope")).agg(F.max("p_size").alias("target")).select("scope", F.lit("limit").alias("name"), "target")
    kind = parts.groupBy(F.concat(F.lit("t"), "p_type").alias("scope")).agg(F.min("p_size").alias("target")).select("scope", F.lit("limit").alias("name"), "target")
    uses = parts.select(F.col("p_partkey").alias("use"), F.concat(F.lit("p"), "p_partkey").alias("scope"), F.lit("limit").alias("name"))
    return resolve.nearest(uses, chain, own.union(brand).union(kind)).select("use", "target", "found_in", "depth")


SCOPE = """with b as (select p_brand, max(p_size) as v from part where p_brand like '%3' group by 1), t as (select p_type, min(p_size) as v from part group by 1)
select p_partkey as use, case when p_size > 45 then p_size when b.v is not null then b.v else t.v end as target,
case when p_size > 45 then 'p' || p_partkey when b.v is not null then 'b' || part.p_brand else 't' || part.p_type end as found_in,
case when p_size > 45 then 0 when b.v is not null then 1 else 2 end as depth from part left join b on b.p_brand = part.p_brand left join t on t.p_type = part.p_type"""


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = read(spark, sf_dir, "customer").where("c_acctbal > 0")
    orders = read(spark, sf_dir, "orders")
    return orders.join(present, orders.o_custkey == present.c_custkey, "left_anti").select("o_orderkey", "o_custkey")


MISSING = "select o_orderkey, o_custkey from orders where not exists (select 1 from customer where c_custkey = o_custkey and c_acctbal > 0)"


def export_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    names = parts.select(F.col("p_brand").alias("package"), F.col("p_name").alias("name"))
    patterns = parts.groupBy(F.col("p_brand").alias("package")).agg(F.concat(F.lit("^["), F.substr(F.min("p_name"), F.lit(1), F.lit(1)), F.lit("a-m]")).alias("pattern"))
    listed = parts.where("p_size = 1").select(F.col("p_brand").alias("package"), F.col("p_name").alias("export"), F.col("p_name").alias("binding"))
    return resolve.expand_exports(patterns, names, listed)


EXPORTS = """with p as (select p_brand, '^[' || substr(min(p_name), 1, 1) || 'a-m]' as pattern from part group by 1)
select distinct p_brand as package, p_name as export, p_name as binding from part left join p using (p_brand) where p_size = 1 or regexp_matches(p_name, pattern)"""


def guard_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    state = F.when(F.col("value") < 5, "unselected").when(F.col("value") > 90, "absent").otherwise("active")
    return report.guard_verdicts(events.select(F.col("user_id").alias("fact"), F.col("event_id").alias("pos"), state.alias("state")))


GUARDS = """with g as (select user_id as fact, event_id as pos, case when value < 5 then 'unselected' when value > 90 then 'absent' else 'active' end as state from events),
f as (select fact, arg_min(state, pos) filter (where state <> 'active') as s from g group by fact)
select fact, case when s = 'unselected' then 'PrunedByUnselectedOptional' when s is not null then 'Pruned' else 'Active' end as verdict from f"""


def _event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), "event_type", seconds("ts").alias("start"))
    return e.withColumn("end", F.col("start") + 1)


def range_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the ten hours after an event of the first type (in order) of their user."""
    inner = _event_spans(spark, sf_dir)
    first = inner.agg(F.min("event_type").alias("t"))
    regions = inner.join(first, inner.event_type == first.t).select("source", "start", (F.col("start") + 36_000).alias("end"), F.concat(F.lit("r"), F.lpad(F.col("event_id").cast("string"), 10, "0")).alias("region"))
    return spans.tagged(inner, regions, ["event_id"], 36_000).select("event_id", F.size("regions").alias("n_regions"), F.array_join("regions", ",").alias("regions"))


TAGGING = """with e as (select event_id, user_id, event_type, epoch(ts)::bigint as s from events), r as (select * from e where event_type = (select min(event_type) from e))
select e.event_id, count(r.event_id)::int as n_regions, coalesce(string_agg('r' || lpad(r.event_id::varchar, 10, '0'), ',' order by r.event_id), '') as regions
from e left join r on r.user_id = e.user_id and r.s <= e.s and e.s + 1 <= r.s + 36000 group by e.event_id"""


def innermost_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = _event_spans(spark, sf_dir)
    size = 3_600 * (1 + F.col("event_id") % 7)
    regions = inner.select("source", "start", (F.col("start") + size).alias("end"), F.col("event_id").alias("region"))
    return spans.innermost(inner, regions, ["event_id"], 14_400).select("event_id", "region")


INNERMOST = """with e as (select event_id, user_id, epoch(ts)::bigint as s, 3600 * (1 + event_id % 7) as size from events)
select a.event_id, arg_min(b.event_id, (b.size, b.s, b.event_id)) as region from e a join e b on a.user_id = b.user_id and b.s <= a.s and a.s + 1 <= b.s + b.size group by 1"""


def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders open (for thirty days) at the same time as a high-priority order of the same customer."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("id"), F.unix_timestamp("o_orderdate").alias("start"), "o_orderpriority").withColumn("end", F.col("start") + 30 * 86_400)
    return spans.overlapping_any(o.where("o_orderpriority not like '1%'"), o.where("o_orderpriority like '1%'"), 30 * 86_400).select("id", "source")


OVERLAP = """with o as (select o_custkey as source, o_orderkey as id, epoch(o_orderdate)::bigint as s, o_orderpriority as p from orders)
select id, source from o a where p not like '1%' and exists (select 1 from o b where b.source = a.source and b.p like '1%' and a.s < b.s + 2592000 and b.s < a.s + 2592000)"""


def theta_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the least creator of its user that can bind its type: one of the type, or one for any (value above 99)."""
    e = read(spark, sf_dir, "events")
    names = e.select(F.col("event_id").alias("use"), F.col("user_id").alias("scope"), F.col("event_type").alias("name"))
    creators = e.where("value > 95").select(F.col("event_id").alias("creator"), F.col("user_id").alias("scope"), F.when(F.col("value") <= 99, F.col("event_type")).alias("created"))
    return resolve.matching_creator(names, creators).select("use", "creator")


THETA = """select a.event_id as use, min(b.event_id) as creator from events a left join (select * from events where value > 95) b
on a.user_id = b.user_id and (b.value > 99 or b.event_type = a.event_type) group by 1"""


def anti_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    return parts.join(lines, parts.p_partkey == lines.l_partkey, "left_anti").select("p_partkey", "p_name")


ANTI = "select p_partkey, p_name from part where not exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 45)"


def full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    return report.compared(lines.where("l_returnflag = 'A' and l_quantity > 40"), lines.where("l_returnflag = 'R' and l_quantity < 10"), ["l_suppkey", "l_partkey"])


DIFF = """with a as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 40), b as (select distinct l_suppkey, l_partkey from lineitem where l_returnflag = 'R' and l_quantity < 10)
select coalesce(a.l_suppkey, b.l_suppkey) as l_suppkey, coalesce(a.l_partkey, b.l_partkey) as l_partkey, case when b.l_partkey is null then 'left' when a.l_partkey is null then 'right' else 'both' end as side
from a full join b on a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey"""


def coalesce_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade from a supplier's nation to a customer's: parallel lines as one edge with its distinct flags."""
    l, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    e = l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, l.l_suppkey == s.s_suppkey)
    e = e.groupBy(F.col("s_nationkey").alias("src"), F.col("c_nationkey").alias("dst")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("reasons"), F.count("*").alias("occurrences"))
    return e


COALESCE = """select s_nationkey as src, c_nationkey as dst, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') as reasons, count(*) as occurrences
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2"""


def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coalesced edges with their sorted evidence: the orders of a customer by status."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("dst"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("reason"))
    e = report.coalesce_edges(o, ["at", "reason"])
    return e.select("src", "dst", F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["at"], x["reason"])), ";").alias("evidence"), F.array_join("reasons", ";").alias("reasons"), "occurrences")


EVIDENCE = """select o_custkey as src, o_orderstatus as dst, string_agg(o_orderkey || ':' || o_orderpriority, ';' order by o_orderkey) as evidence,
array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') as reasons, count(*) as occurrences from orders group by 1, 2"""


def diagnostics_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return report.first_diagnostics(e, ["user_id", "event_type", "k"], ["ts", "event_id"]).select("user_id", "event_type", F.col("k").cast("string").alias("k"), "event_id")


DEDUP = """select user_id, event_type, props->>'$.k' as k, event_id from events qualify row_number() over (partition by user_id, event_type, props->>'$.k' order by ts, event_id) = 1"""


def derived_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.grouped_by_cause(read(spark, sf_dir, "events"), "event_type", ["event_id", "user_id"], "user_id")
    return out.select("event_type", F.col("primary.event_id").alias("primary_event"), F.col("primary.user_id").alias("primary_user"), F.size("evidence").alias("n_evidence"), F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("evidence"))


GROUPING = """select event_type, min(event_id) as primary_event, arg_min(user_id, event_id) as primary_user, len(list_distinct(list(user_id)))::int as n_evidence,
array_to_string(list_sort(list_distinct(list(user_id))), ',') as evidence from events group by 1"""


def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = read(spark, sf_dir, "events").groupBy("event_type").agg(F.array_sort(F.collect_set("user_id")).alias("s"))
    return sites.select("event_type", report.evidence_text(F.transform("s", lambda x: x.cast("string"))).alias("summary"))


SUMMARY = """with s as (select event_type, list_sort(list_distinct(list(user_id))) as s from events group by 1)
select event_type, array_to_string(s[1:4], ', ') || case when len(s) > 4 then ' and ' || (len(s) - 4) || ' more' else '' end as summary from s"""


def coverage_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey")
    calls = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("invocation"))
    return report.coverage(customers, calls, "c_custkey").select("c_custkey", "state", F.array_join("invocations", ",").alias("invocations"))


COVERAGE = """with o as (select o_custkey, bool_or(o_orderstatus = 'P') as open, list_sort(list_distinct(list(case when o_orderstatus <> 'P' then o_orderpriority end))) as l from orders group by 1)
select c_custkey, case when open is null then 'pending' when open then 'open' else 'known' end as state, case when not open then array_to_string(l, ',') end as invocations from customer left join o on o_custkey = c_custkey"""


def dispatch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part")
    out = report.dispatch(parts.select("p_brand", F.when(~((F.col("p_brand") == "Brand#11") & (F.col("p_size") > 40)), F.array("p_type")).alias("classes")), "p_brand", "classes")
    return out.select("p_brand", "open", F.array_join("classes", "|").alias("classes"))


DISPATCH = """with d as (select p_brand, bool_or(p_brand = 'Brand#11' and p_size > 40) as open, list_sort(list_distinct(list_append(list(p_type), 'default'))) as c from part group by 1)
select p_brand, open, case when not open then array_to_string(c, '|') end as classes from d"""


def package_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as packages of customers and suppliers; lines are edges from supplier to customer."""
    l, o, c, s = (read(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier"))
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("package")).union(s.select(F.concat(F.lit("s"), "s_suppkey"), "s_nationkey"))
    edges = l.join(o, l.l_orderkey == o.o_orderkey).select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst")).distinct()
    return report.package_summaries(nodes, edges).select("package", "retained", F.size("entry_members").cast("long").alias("entries"), "edges_in", "edges_out")


PACKAGES = """with n as (select 'c' || c_custkey as node, c_nationkey as p from customer union all select 's' || s_suppkey, s_nationkey from supplier),
e as (select distinct 's' || l_suppkey as src, 'c' || o_custkey as dst from lineitem join orders on l_orderkey = o_orderkey),
x as (select a.p as sp, b.p as dp, e.dst from e join n a on a.node = e.src join n b on b.node = e.dst where a.p <> b.p)
select p as package, count(distinct node) as retained, coalesce(any_value(i.entries), 0) as entries, coalesce(any_value(i.n), 0) as edges_in, coalesce(any_value(o.n), 0) as edges_out
from n left join (select dp, count(distinct dst) as entries, count(*) as n from x group by 1) i on i.dp = p left join (select sp, count(*) as n from x group by 1) o on o.sp = p group by p"""


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("key"))
    b = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"))
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "key")
    return tag(a.union(b).distinct(), "union").union(tag(a.intersect(b), "intersect")).union(tag(a.subtract(b), "except"))


SETS = """with a as (select c_nationkey as key from customer where c_acctbal > 9000), b as (select s_nationkey as key from supplier)
select 'union' as op, key from (select * from a union select * from b) x union all select 'intersect', key from (select * from a intersect select * from b) y union all select 'except', key from (select * from a except select * from b) z"""


def version_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per type: lower bounds from brands that end in an odd digit, upper bounds from the others, exclusions from large parts."""
    parts = read(spark, sf_dir, "part")
    brand = F.substr("p_brand", F.lit(7), F.lit(2))
    rows = parts.select("p_type", F.when(F.col("p_size") > 48, "!=").when(brand.cast("int") % 2 == 1, F.when(F.col("p_size") % 2 == 1, ">=").otherwise(">")).otherwise(F.when(F.col("p_size") % 2 == 1, "<=").otherwise("<")).alias("op"), scalar.version(F.concat(F.lit("1."), F.when(brand.cast("int") % 2 == 1, brand).otherwise((brand.cast("int") + 30).cast("string")))).alias("v"))
    agg = rows.groupBy("p_type").agg(*[c.alias(k) for k, c in scalar.bounds(F.col("op"), F.col("v")).items()])
    lower, upper = F.col("lower"), F.col("upper")
    return agg.select("p_type", scalar.version_text(lower["version"]).alias("lower"), lower["exclusive"].alias("lower_exclusive"), scalar.version_text(upper["version"]).alias("upper"), upper["inclusive"].alias("upper_inclusive"), scalar.conflict(lower, upper, F.col("exact"), F.col("excluded")).alias("conflict"))


VERSIONS = """with b as (select p_type, p_size, substr(p_brand, 7, 2)::int as n from part), r as (select p_type, case when p_size > 48 then '!=' when n % 2 = 1 then case when p_size % 2 = 1 then '>=' else '>' end else case when p_size % 2 = 1 then '<=' else '<' end end as op, case when n % 2 = 1 then n else n + 30 end as v from b),
a as (select p_type, max(v) filter (where op in ('>', '>=')) as lo, min(v) filter (where op in ('<', '<=')) as hi, list(v) filter (where op = '!=') as ex from r group by 1),
c as (select a.*, (select bool_or(op = '>') from r where r.p_type = a.p_type and r.v = a.lo and op in ('>', '>=')) as le, (select bool_and(op = '<=') from r where r.p_type = a.p_type and r.v = a.hi and op in ('<', '<=')) as ui from a)
select p_type, '1.' || lo as lower, le as lower_exclusive, '1.' || hi as upper, ui as upper_inclusive,
coalesce(lo > hi or (lo = hi and (le or not ui or list_contains(coalesce(ex, []), lo))), false) as conflict from c"""


def sha_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", scalar.digest("text").alias("sha"))
    return d.groupBy("sha").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


SHA = "select sha256(text) as sha, min(doc_id) as first_doc, count(*) as copies from documents group by 1"


def framed_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of two framed fields; the oracle frames short lengths in hexadecimal."""
    return read(spark, sf_dir, "nation").select("n_nationkey", scalar.fingerprint(F.col("n_name"), F.col("n_regionkey").cast("string")).alias("fp"))


FRAMED = "select n_nationkey, sha256(from_hex(printf('%02x00000000000000', strlen(n_name)) || hex(n_name::blob) || printf('%02x00000000000000', strlen(n_regionkey::varchar)) || hex((n_regionkey::varchar)::blob))) as fp from nation"


def edge_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", "r_name", scalar.edge_id(F.col("n_name"), F.col("r_name")).alias("id"))


EDGE_ID = "select n_name, r_name, sha256(from_hex(hex(n_name::blob) || '00' || hex(r_name::blob))) as id from nation join region on n_regionkey = r_regionkey"


def identifier_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.explode(scalar.identifiers(F.col("text"))).alias("token"))
    return d.groupBy("token").agg(F.count("*").alias("n"))


TOKENS = "select token, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z0-9._]+')) as token from documents) x group by 1"


def text_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes the first element of the head from each page by byte offsets."""
    p = read(spark, sf_dir, "pages")
    start = F.octet_length(F.substring_index("html", "<title>", 1))
    end = F.octet_length(F.substring_index("html", "</title>", 1)) + 8
    edits = F.when(F.col("html").contains("<title>") & F.col("html").contains("</title>"), F.array(F.struct(start.alias("start"), end.alias("end"), F.lit("<t/>").alias("text"))))
    return p.select("page_id", F.md5(scalar.splice("html", F.coalesce(edits, F.array().cast("array<struct<start:int,end:int,text:string>>"))).cast("binary")).alias("html_md5"))


SPLICE = """select page_id, md5(case when contains(html, '<title>') and contains(html, '</title>') then substr(html, 1, instr(html, '<title>') - 1) || '<t/>' || substr(html, instr(html, '</title>') + 8) else html end) as html_md5 from pages"""


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of links, and whether a page of the table has them."""
    p = read(spark, sf_dir, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target")).groupBy("page_id", "target").agg(F.count("*").alias("n"))
    own = p.select(F.col("url").alias("target")).distinct().withColumn("known", F.lit(True))
    return links.join(own, "target", "left").select("page_id", "target", "n", F.coalesce("known", F.lit(False)).alias("known"))


LINKS = """with l as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as target from pages)
select page_id, target, count(*) as n, target in (select url from pages) as known from l group by 1, 2"""


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n"))


JSON = "select event_type, sum((props->>'$.k')::bigint)::bigint as sum_k, count(props->>'$.k') as n from events group by 1"


def role_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 0, "base").alias("priority"))
    return resolve.roles(p, "NATION_1", ["NATION_3", "NATION_7"]).select("name", "role")


ROLES = "select n_name as name, case when n_name = 'NATION_1' then 'Root' when n_name in ('NATION_3', 'NATION_7') or n_regionkey = 0 then 'External' else 'Linked' end as role from nation"


def sole_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select(F.lit("p").alias("package"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("component"))
    return resolve.sole_owner(l).select("name", "component")


SOLE = "select l_partkey as name, case when count(distinct l_suppkey) = 1 then min(l_suppkey) end as component from lineitem group by 1"


def presentation_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(F.lit("Environment"), F.lit("Package"), F.lit("Binding"), F.lit("Other")), (F.col("p_size") % 4 + 1).cast("int"))
    return report.presentation(read(spark, sf_dir, "part").select(F.col("p_type").alias("component"), F.col("p_partkey").alias("member"), kinds.alias("kind")))


PRESENTATION = """select p_type as component, arg_min(['Environment', 'Package', 'Binding', 'Other'][p_size % 4 + 1], ([2, 1, 0, 3][p_size % 4 + 1], p_partkey)) as kind from part group by 1"""

_ALL = {
    last_wins_import: LAST_WINS, priority_resolve: PRIORITY, scope_chain: SCOPE, missing_targets: MISSING, export_expansion: EXPORTS, guard_verdict: GUARDS, range_tagging: TAGGING, innermost_region: INNERMOST, span_overlap: OVERLAP,
    theta_creators: THETA, anti_removed: ANTI, full_outer_diff: DIFF, coalesce_edges: COALESCE, edge_evidence: EVIDENCE, diagnostics_dedup: DEDUP, derived_grouping: GROUPING, evidence_summary: SUMMARY, coverage_lattice: COVERAGE,
    dispatch_classes: DISPATCH, package_summary: PACKAGES, set_ops: SETS, version_intersect: VERSIONS, sha_identity: SHA, framed_fingerprint: FRAMED, edge_identity: EDGE_ID, 
    identifier_tokens: TOKENS, text_splice: SPLICE, link_extract: LINKS, json_props: JSON, role_policy: ROLES, sole_owner: SOLE, presentation_kind: PRESENTATION,
}
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL.items()}
