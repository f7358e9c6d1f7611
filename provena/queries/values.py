"""Registered queries of the scalar functions: digests, codecs, versions, paths, names and argument matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions import scalar
from provena.operators import calls, report
from provena.plans import analysis
from provena.queries.graphs import read


def _hex(text: str) -> str:
    """SQL for a framed field in hexadecimal: eight bytes of length, least first, then the bytes."""
    n = f"strlen({text})"
    bytes_ = " || ".join(f"printf('%02x', ({n} >> {8 * k}) & 255)" for k in range(8))
    return f"({bytes_} || hex(encode({text})))"


def _joined(c: Column, by: str = ",") -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), by, "-")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each nation with the sorted names of its suppliers."""
    return read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))


def framed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_nationkey", F.sha2(scalar.framed_list(F.col("names")), 256).alias("digest"))


FRAMED_LIST = f"""with n as (select s_nationkey, count(*) as n, string_agg({_hex("s_name")}, '' order by s_name) as h from supplier group by 1)
select s_nationkey, sha256(from_hex(printf('%02x', n & 255) || printf('%02x', (n >> 8) & 255) || '000000000000' || h)) as digest from n"""


def string_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).select("s_nationkey", scalar.string_key(F.col("names")).alias("key"))


STRING_KEY = f"select s_nationkey, sha256(from_hex('{(scalar.KEY_PREFIX).encode().hex()}' || string_agg(hex(encode(s_name)) || '00', '' order by s_name))) as key from supplier group by 1"


def component_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each nation's set of suppliers, given in any order."""
    return _suppliers(spark, sf_dir).select("s_nationkey", scalar.component_id(F.reverse("names")).alias("id"))


COMPONENT_ID = f"select s_nationkey, sha256(from_hex(string_agg({_hex('s_name')}, '' order by s_name))) as id from supplier group by 1"


def document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache key of each document from its language, source and whole text."""
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", scalar.cache_key(F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("key"))


DOCUMENT_KEY = f"select doc_id, sha256(from_hex({' || '.join(_hex(f'''coalesce({c}, '')''') for c in ('lang', 'source', 'text'))})) as key from documents"


def cache_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry names of documents made and read again; every fifth has no member, every seventh is another file's name."""
    d = read(spark, sf_dir, "documents")
    member = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("m"), "doc_id"))
    made = scalar.cache_name(F.concat(F.lit("pkg-"), F.col("doc_id") % 3), F.md5(F.col("doc_id").cast("string")), member, F.lit("binding"))
    d = d.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("other"), "doc_id")).otherwise(made).alias("name"))
    p = scalar.parse_cache_name(F.col("name"))
    return d.select("doc_id", "name", p["package"].alias("package"), p["key"].alias("key"), p["member"].alias("member"), p["kind"].alias("kind"))


CACHE_NAMES = f"""with p as (select doc_id, doc_id % 7 = 0 as other, 'pkg-' || (doc_id % 3) as package, md5(doc_id::varchar) as key, case when doc_id % 5 <> 0 then 'm' || doc_id end as member from documents)
select doc_id, case when other then 'other' || doc_id else package || '-' || key || coalesce('-' || member, '') || '.binding.{scalar.ENTRY_SUFFIX}' end as name,
case when not other then package end as package, case when not other then key end as key, case when not other then member end as member, case when not other then 'binding' end as kind from p"""


def size_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from a byte to gibibytes, for people."""
    n = F.col("p_partkey").cast("long") * F.pow(F.lit(2), (F.col("p_partkey") % 4) * 8).cast("long")
    return read(spark, sf_dir, "part").select("p_partkey", F.replace(scalar.size_text(n), F.lit(","), F.lit("")).alias("size"))


SIZES = """with n as (select p_partkey, p_partkey::bigint << (8 * (p_partkey % 4))::int as n from part)
select p_partkey, case when n >= 1073741824 then printf('%.1f GiB', n / 1073741824) when n >= 1048576 then printf('%.1f MiB', n / 1048576) when n >= 1024 then printf('%.1f KiB', n / 1024) else n || ' B' end as size from n"""


def quoted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals of whole documents."""
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5(scalar.quoted(F.col("text")).cast("binary")).alias("literal_md5"))


QUOTED = r"""select doc_id, md5('"' || replace(replace(replace(replace(text, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r') || '"') as literal_md5 from documents where text is not null"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*map(F.lit, ["a/b{}", "/a{}", "a/../b{}", "..", "./a{}", "", "a..b{}", "a/..", "x{}/./y"]))
    return read(spark, sf_dir, "part").select("p_partkey", F.replace(F.element_at(forms, (F.col("p_partkey") % 9 + 1).cast("int")), F.lit("{}"), F.col("p_partkey").cast("string")).alias("path"))


def resource_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("p_partkey", scalar.valid_resource_path(F.col("path")).alias("valid"))


RESOURCE_PATHS = """with p as (select p_partkey, replace(['a/b{}', '/a{}', 'a/../b{}', '..', './a{}', '', 'a..b{}', 'a/..', 'x{}/./y'][p_partkey % 9 + 1], '{}', p_partkey::varchar) as path from part)
select p_partkey, path <> '' and not starts_with(path, '/') and not list_contains(string_split(path, '/'), '..') as valid from p"""


def environment_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(*map(F.lit, ["namespace:", "private:", "unsupported:", "base:base", "base:empty", "base:x", "other:"]))
    form = F.element_at(forms, (F.col("p_partkey") % 7 + 1).cast("int"))
    label = F.when(F.endswith(form, F.lit(":")), F.concat(form, "p_partkey")).otherwise(form)
    parsed = scalar.environment_label(F.col("label"))
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label")).select("p_partkey", "label", parsed["kind"].alias("kind"), parsed["name"].alias("name"))


LABELS = """with p as (select p_partkey, ['namespace:', 'private:', 'unsupported:', 'base:base', 'base:empty', 'base:x', 'other:'][p_partkey % 7 + 1] as f from part),
l as (select p_partkey, case when f like '%:' then f || p_partkey else f end as label from p)
select p_partkey, label, case when p_partkey % 7 < 5 then split_part(label, ':', 1) end as kind, case when p_partkey % 7 < 5 then split_part(label, ':', 2) end as name from l"""


def member_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths into values: an element per line of an order, a step of another kind behind every third order."""
    step = F.struct(F.when(F.col("l_linenumber") % 2 == 0, "attribute").otherwise("element").alias("kind"), F.col("l_linenumber").cast("int").alias("pos"), F.col("l_returnflag").alias("name"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", step.alias("step")))).alias("steps"))
    last = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.struct(F.lit("body").alias("kind"), F.lit(0).alias("pos"), F.lit("").alias("name")))).otherwise(F.array().cast("array<struct<kind:string,pos:int,name:string>>"))
    return lines.select("l_orderkey", scalar.member_path(F.concat(F.transform("steps", lambda x: x["step"]), last)).alias("path"))


MEMBER_PATHS = """select l_orderkey, '$' || string_agg(case when l_linenumber % 2 = 0 then '.attr[[' || l_linenumber || ', "' || l_returnflag || '"]]' else '[[' || l_linenumber || ']]' end, '' order by l_linenumber, l_returnflag) || case when l_orderkey % 3 = 0 then '.body' else '' end as path from lineitem group by 1"""


def method_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class in a name like ``generic.class``, for the first word of each part's name as generic."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("binding"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("generic"))
    return p.select("p_partkey", scalar.method_class(F.col("binding"), F.col("generic")).alias("class"), scalar.labelled(F.when(F.col("p_partkey") % 2 == 0, ""), F.col("generic")).alias("label"))


METHOD_CLASSES = """select p_partkey, nullif(substr(replace(p_name, ' ', '.'), length(split_part(p_name, ' ', 1)) + 2), '') as class, split_part(p_name, ' ', 1) as label from part"""


def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of generics, keys of private namespaces and semantic ids of customers as bindings of their nation."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    ids = [analysis.node_id(kind, F.col("n_name"), F.col("c_name")).alias(kind) for kind in ("binding", "dataset", "external", "native", "resource", "activation", "package", "missing")]
    return c.select("c_custkey", scalar.qualified(F.col("n_name"), F.col("c_name")).alias("label"), scalar.private_key(F.lit("root"), F.col("n_name")).alias("private"), *ids)


QUALIFIED = """select c_custkey, n_name || '::' || c_name as label, 'root:' || n_name as private, 'binding:' || n_name || '::' || c_name as binding, 'dataset:' || n_name || '::' || c_name as dataset,
'external:' || n_name || '::' || c_name as external, 'native:' || n_name || '::' || c_name as native, 'resource:' || n_name || '/' || c_name as resource,
'activation:' || n_name as activation, 'package:' || n_name as package, 'missing:' || n_name as missing from customer join nation on c_nationkey = n_nationkey"""


def package_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of documents could be package names."""
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).distinct()
    return words.select("word", scalar.valid_package_name(F.col("word")).alias("valid"))


PACKAGE_NAMES = r"""select distinct word, regexp_matches(word, '^[A-Za-z][A-Za-z0-9.]*$') and not word like '%.' as valid from (select unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) as word from documents) x"""


def text_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of the byte in the middle of a document's last line, and the bytes before it there."""
    d = read(spark, sf_dir, "documents").where("text is not null")
    last = F.substring_index("text", "\n", -1)
    half = F.substr(last, F.lit(1), F.floor(F.char_length(last) / 2).cast("int"))
    start = F.octet_length("text") - F.octet_length(last)
    at = scalar.location(F.col("text"), (start + F.octet_length(half)))
    return d.select("doc_id", at["line"].cast("long").alias("line"), at["column"].cast("long").alias("column"), F.md5(scalar.byte_slice(F.col("text"), start, start + F.octet_length(half)).cast("binary")).alias("slice_md5"))


LOCATIONS = """with d as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null)
select doc_id, len(l)::bigint as line, (length(l[-1]) // 2 + 1)::bigint as "column", md5(substr(l[-1], 1, length(l[-1]) // 2)) as slice_md5 from d"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency texts made of parts, some of them malformed, read back."""
    p = read(spark, sf_dir, "part")
    op = F.element_at(F.array(*map(F.lit, [">=", "<", "==", "=", "!=", "~"])), (F.col("p_size") % 6 + 1).cast("int"))
    text = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" pkg"), "p_partkey", F.lit(" "))).otherwise(F.concat(F.lit("pkg"), "p_partkey", F.lit(" ("), op, F.lit(" 1."), "p_size", F.lit(")")))
    r = scalar.relation(text)
    return p.select("p_partkey", r["package"].alias("package"), r["op"].alias("op"), scalar.version_text(scalar.version(r["version"])).alias("version"))


RELATIONS = """with p as (select p_partkey, p_size, ['>=', '<', '==', '=', '!=', '~'][p_size % 6 + 1] as op, p_partkey % 5 = 0 as bare from part)
select p_partkey, case when bare or op <> '~' then 'pkg' || p_partkey end as package, case when not bare and op <> '~' then case when op = '=' then '==' else op end end as op, case when not bare and op <> '~' then '1.' || p_size end as version from p"""


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remaining requirement of each brand, from bounds of its parts: text, and whether version 1.25 is admitted."""
    p = read(spark, sf_dir, "part")
    op = F.when(F.col("p_size") < 20, ">=").when(F.col("p_size") > 30, "<").otherwise("!=")
    rows = p.select("p_brand", op.alias("op"), scalar.version(F.concat(F.lit("1."), "p_size")).alias("v"))
    a = rows.groupBy("p_brand").agg(*[c.alias(k) for k, c in scalar.bounds(F.col("op"), F.col("v")).items()])
    lower, upper, exact, out = (F.col(c) for c in ("lower", "upper", "exact", "excluded"))
    return a.select("p_brand", scalar.requirement_text(lower, upper, exact, out).alias("text"), scalar.admits(F.array(F.lit(1), F.lit(25)), lower, upper, out).alias("admits"))


REQUIREMENTS = """with a as (select p_brand, max(p_size) filter (where p_size < 20) as lo, min(p_size) filter (where p_size > 30) as hi, list_sort(list_distinct(list(p_size) filter (where p_size between 20 and 30))) as ex from part group by 1)
select p_brand, concat_ws(', ', '>=1.' || lo, '<1.' || hi, case when len(ex) > 0 then array_to_string(list_transform(ex, lambda x: '!=1.' || x), ', ') end) as text, not coalesce(list_contains(ex, 25), false) as admits from a"""


def domain_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a brand's small, middle and large parts that all three have, in order; a brand without small parts isn't limited by them."""
    p = read(spark, sf_dir, "part")
    own = lambda low, high: F.array_sort(F.collect_set(F.when(F.col("p_size").between(low, high), F.col("p_type"))))
    a = p.groupBy("p_brand").agg(own(1, 17).alias("a"), own(18, 34).alias("b"), own(35, 50).alias("c"))
    a = a.withColumn("b", F.when(F.substr("p_brand", F.lit(7), F.lit(1)) != "3", F.col("b")))
    return a.select("p_brand", F.array_join(report.domain_intersection(F.array("a", "b", "c")), "|").alias("types"))


DOMAINS = """with a as (select p_brand, list_sort(list_distinct(coalesce(list(p_type) filter (where p_size between 1 and 17), []))) as a, list_distinct(coalesce(list(p_type) filter (where p_size between 18 and 34), [])) as b, list_distinct(coalesce(list(p_type) filter (where p_size between 35 and 50), [])) as c from part group by 1)
select p_brand, array_to_string(list_filter(a, lambda x: (substr(p_brand, 7, 1) = '3' or list_contains(b, x)) and list_contains(c, x)), '|') as types from a"""


def arg_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviated roles of each conversation's turns as argument names, matched against fixed formals; which argument the second takes."""
    formals = F.array(F.lit("user"), F.lit("assistant"), F.lit("..."), F.lit("system"))
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substr("role", F.lit(1), F.lit(3)).alias("r")))).alias("t"))
    c = c.withColumn("t", F.slice("t", F.lit(1), (F.col("conv_id") % 4 + 1).cast("int")))
    m = c.select("conv_id", scalar.matched(formals, F.col("t.r")).alias("m"))
    return m.select("conv_id", _joined(F.col("m.assigned")).alias("assigned"), F.col("m.error").alias("error"), scalar.argument_index(F.col("m"), formals, "assistant").alias("assistant"))


ARG_MATCH = """with t as (select conv_id, substr(role, 1, 3) as r, row_number() over (partition by conv_id order by turn, role) - 1 as k from conversations),
s as (select * from t where k < conv_id % 4 + 1),
n as (select conv_id, count(*) filter (where r = 'use') as u, count(*) filter (where r = 'ass') as a, min(k) filter (where r = 'use') as ku, min(k) filter (where r = 'ass') as ka from s group by 1),
e as (select *, case when u > 1 and (a < 2 or ku < ka) then 'formal ''user'' matched by multiple arguments' when a > 1 then 'formal ''assistant'' matched by multiple arguments' end as error from n)
select conv_id, case when error is not null then '-,-,-,-' else coalesce(ku::varchar, '-') || ',' || coalesce(ka::varchar, '-') || ',-,-' end as assigned, error, case when error is null then ka end::int as assistant from e"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as calls: the callee by key, one named and one unnamed argument; every fourth has a computed name."""
    callees = F.array(*map(F.lit, ["get", "assign", "exists", "do.call", "ls", "list2env", "other", "makeActiveBinding"]))
    o = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    statics = F.array(F.when(k % 4 != 0, F.col("c_name")), F.lit(None).cast("string"))
    names = F.when(k % 3 == 0, F.array(F.lit("envir"), F.lit(""))).otherwise(F.array(F.lit(""), F.lit("envir")))
    return o.select(k.alias("call"), F.element_at(callees, (k % 8 + 1).cast("int")).alias("callee"), names.alias("names"), F.when(k % 3 == 0, F.reverse(statics)).otherwise(statics).alias("statics"))


_CALLS = """c as (select c_custkey as call, ['get', 'assign', 'exists', 'do.call', 'ls', 'list2env', 'other', 'makeActiveBinding'][c_custkey % 8 + 1] as callee, case when c_custkey % 4 <> 0 then c_name end as s, c_custkey % 3 = 0 as flipped from customer)"""


def created_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.created_names(_calls(spark, sf_dir))


CREATED = f"with {_CALLS} select call, case when callee = 'assign' then s end as created from c where callee in ('assign', 'list2env') union all select call, null from c where callee = 'makeActiveBinding'"


def looked_up_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.looked_up_names(_calls(spark, sf_dir))


LOOKED_UP = f"with {_CALLS} select call, s as name from c where callee in ('get', 'exists', 'do.call')"


def namespace_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of a namespace passed as the argument named ``envir``."""
    c = _calls(spark, sf_dir).withColumn("index", F.when(F.col("call") % 3 == 0, 0).otherwise(1))
    return calls.namespace_actions(c).select("call", "index", "action", "name")


ACTIONS = f"""with {_CALLS} select call, case when flipped then 0 else 1 end as index,
case when callee in ('get', 'exists') then case when s is null then 'escape' when callee = 'get' then 'read' else 'exists' end when callee = 'assign' then 'write' when callee = 'ls' then 'names' else 'escape' end as action,
case when callee in ('get', 'exists', 'assign') then s end as name from c"""


def native_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second own argument of native calls, of which every third names its PACKAGE first; and the routine table by interface."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    names = F.when(k % 3 == 0, F.array(*map(F.lit, ["", "PACKAGE", "x", "y"]))).otherwise(F.array(*map(F.lit, ["", "x", "", "z"])))
    callee = F.element_at(F.array(*map(F.lit, [".C", ".Call", ".External2", ".Fortran", "f"])), (k % 5 + 1).cast("int"))
    rows = c.select(k.alias("call"), names.alias("names"), F.lit(2).alias("position"), scalar.native_table(callee).alias("table"))
    return calls.native_argument(rows).join(rows.select("call", "table"), "call")


NATIVE_ARGUMENTS = """select c_custkey as call, 2 as position, case when c_custkey % 3 = 0 then 3 else 2 end as index, ['c', 'call', 'external', 'fortran', null][c_custkey % 5 + 1] as "table" from customer"""


_ALL = {
    framed_list: FRAMED_LIST, string_key: STRING_KEY, component_identity: COMPONENT_ID, document_fingerprint: DOCUMENT_KEY, cache_names: CACHE_NAMES, size_texts: SIZES, quoted_texts: QUOTED, resource_paths: RESOURCE_PATHS,
    environment_labels: LABELS, member_paths: MEMBER_PATHS, method_classes: METHOD_CLASSES, qualified_names: QUALIFIED, package_names: PACKAGE_NAMES, text_locations: LOCATIONS, relations: RELATIONS, requirements: REQUIREMENTS,
    domain_intersections: DOMAINS, arg_match: ARG_MATCH, created_names: CREATED, looked_up_names: LOOKED_UP, namespace_actions: ACTIONS, native_arguments: NATIVE_ARGUMENTS,
}
QUERIES = {f.__name__: (f, sql) for f, sql in _ALL.items()}
