"""Scalar functions, joins, spans, graph kernels, sources and sinks against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from provena.api import RootSpec
from provena.functions import scalar
from provena.operators import emit, graph, report, resolve, spans
from provena.plans.fixpoint import stratified
from provena.sources import images, index
from provena.sources.cache import Cache


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def frame(*fields):
    return b"".join(len(f).to_bytes(8, "little") + f for f in fields)


def test_digests(spark):
    row = spark.createDataFrame([("ä", "b", ["x", "", "é"])], "a string, b string, l array<string>").select(
        scalar.digest("a").alias("d"), scalar.fingerprint(F.col("a"), F.col("b")).alias("f"), F.sha2(scalar.framed_list(F.col("l")), 256).alias("l"), scalar.component_id(F.col("l")).alias("c"), scalar.edge_id(F.col("a"), F.col("b")).alias("e"), scalar.string_key(F.col("l")).alias("k")
    ).first()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    items = ["x".encode(), b"", "é".encode()]
    assert row.d == sha("ä".encode()) and row.f == sha(frame("ä".encode(), b"b")) and row.l == sha((3).to_bytes(8, "little") + frame(*items))
    assert row.c == sha(frame(*sorted(items))) and row.e == sha("ä\0b".encode()) and row.k == sha(scalar.KEY_PREFIX.encode() + b"x\0\0" + "é\0".encode())


def test_small_strings(spark):
    lit = F.lit
    assert one(spark, scalar.quoted(lit('a"\\\n'))) == '"a\\"\\\\\\n"'
    assert [one(spark, scalar.size_text(lit(n))) for n in (12, 2048, 5 << 20)] == ["12 B", "2.0 KiB", "5.0 MiB"]
    assert one(spark, scalar.method_class(lit("print.foo.bar"), lit("print"))) == "foo.bar" and one(spark, scalar.method_class(lit("printer"), lit("print"))) is None
    assert [one(spark, scalar.valid_resource_path(lit(p))) for p in ("a/b", "/a", "a/../b", "..", "./a", "", "a..b")] == [True, False, False, False, True, False, True]
    assert [tuple(one(spark, scalar.environment_label(lit(x))) or ()) for x in ("namespace:x", "base:empty", "base:x", "x")] == [("namespace", "x"), ("base", "empty"), (), ()]
    got = one(spark, scalar.parse_cache_name(scalar.cache_name(lit("a-b"), lit("0123456789abcdef"), lit("m"), lit("binding"))))
    assert (got.package, got.key, got.member, got.kind) == ("a-b", "0123456789abcdef", "m", "binding")
    assert one(spark, scalar.member_path(F.array(F.struct(lit("element").alias("kind"), lit(1).alias("pos"), lit("").alias("name")), F.struct(lit("body").alias("kind"), lit(0).alias("pos"), lit("").alias("name"))))) == "$[[1]].body"
    assert tuple(one(spark, scalar.location(lit("ä\nbc"), lit(4)))) == (2, 2) and one(spark, scalar.byte_slice(lit("äbc"), lit(2), lit(4))) == "bc"


def test_splice_and_overlap_admission(spark):
    edits = lambda *e: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in e])
    assert one(spark, scalar.splice(F.lit("äbcd"), edits((0, 2, "x"), (3, 4, "")))) == "xbd"
    assert one(spark, scalar.splice(F.lit("abcd"), edits((0, 3, "x"), (2, 4, "y")))) is None
    rows = spark.createDataFrame([("s", 0, 5), ("s", 5, 7), ("s", 6, 9), ("t", 3, 2)], "source string, start long, end long")
    assert sorted((r.source, r.start) for r in spans.misplaced(rows).collect()) == [("s", 6), ("t", 3)]


@pytest.mark.parametrize(
    ("formals", "names", "want", "error"),
    [
        (["alpha", "alpine", "...", "tail"], ["alph", "alph"], None, "multiple arguments"),
        (["alpha", "alpine", "...", "tail"], ["al"], None, "multiple formals"),
        (["alpha", "alpine", "...", "tail"], ["alph", "alpha", "tail"], [1, None, None, 2], None),
        (["...", "nm"], ["n"], [None, None], None),
        (["...", "nm"], ["nm"], [None, 0], None),
        (["x", "y"], [None, "x", None], None, "unused"),
        (["x", "y"], [None, "x"], [1, 0], None),
    ],
)
def test_argument_matching(formals, names, want, error):
    got, said = scalar.match_arguments(formals, names)
    if error:
        assert error in said
    else:
        assert (got, said) == (want, None)


def test_requirement_intersection(spark):
    cases = {
        ">=1.0.0, >=1.1.0, <2.0.0": ">=1.1.0, <2.0.0", ">=3.0, >3.0": ">3.0", ">=1.0, ==1.1.0": "==1.1.0", ">=1.0, !=0.9, !=1.2": ">=1.0, !=1.2", ">=1.0, <=1.0": ">=1.0, <=1.0",
        ">=2.0, <1.5": None, ">=1.0, <1.0": None, "==1.0, ==1.1": None, "==1.0, !=1.0": None, ">=1.0, <=1.0, !=1.0": None,
    }
    rows = [(case, f"pkg ({part[: 2 if part[1] == '=' else 1]} {part.lstrip('<>=!')})") for case in cases for part in case.split(", ")]
    r = spark.createDataFrame(rows, "id string, text string").select("id", scalar.relation(F.col("text")).alias("r")).select("id", F.col("r.op").alias("op"), scalar.version(F.col("r.version")).alias("v"))
    agg = r.groupBy("id").agg(*[c.alias(k) for k, c in scalar.bounds(F.col("op"), F.col("v")).items()])
    cols = [F.col(c) for c in ("lower", "upper", "exact", "excluded")]
    got = {x.id: x.t for x in agg.select("id", F.when(~scalar.conflict(*cols), scalar.requirement_text(*cols)).alias("t")).collect()}
    assert got == cases


def test_spans_against_brute_force(spark):
    r = random.Random(0)
    rows = [(r.choice("st"), s := r.randint(0, 60), s + r.randint(1, 30), f"i{k:02}") for k in range(60)]
    df = spark.createDataFrame(rows, "source string, start long, end long, id string")
    got = sorted((x.a_id, x.b_id) for x in spans.overlapping(df, df, 16).collect())
    assert got == sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    tagged = {x.id: x.regions for x in spans.tagged(df, df.withColumnRenamed("id", "region"), ["id"], 16).collect()}
    assert tagged == {a[3]: sorted(b[3] for b in rows if a[0] == b[0] and b[1] <= a[1] and a[2] <= b[2]) for a in rows}


def test_graph_kernels_against_brute_force(spark):
    r = random.Random(1)
    pairs = sorted({(r.randrange(25), r.randrange(25)) for _ in range(34)})
    edges = spark.createDataFrame(pairs, "src long, dst long")
    reach = {n: set() for n in range(25)}
    for n in reach:
        todo = [b for a, b in pairs if a == n]
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += [b for a, b in pairs if a == x]
    seen = {x for p in pairs for x in p}
    want = {n: min([m for m in reach[n] if n in reach[m]], default=n) for n in seen}
    want = {n: min(n, m) for n, m in want.items()}
    assert {x.node: x.component for x in graph.components(edges).collect()} == want
    assert {x.node: x.component for x in graph.components(edges, kernel_edges=0).collect()} == want
    start = min(seen)
    assert {x.node for x in graph.reach(edges, spark.createDataFrame([(start,)], "node long")).collect()} == reach[start] | {start}
    tree = graph.spanning_tree(edges, spark.createDataFrame([(n,) for n in seen], "node long"), start).collect()
    assert sorted(x.node for x in tree) == sorted(seen) and all((x.parent, x.node) in pairs for x in tree if x.parent is not None)


def test_orders(spark):
    nodes = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "node string, preferred int")
    needs = spark.createDataFrame([("a", "c"), ("b", "d"), ("d", "b")], "node string, needs string")
    got = [(x.node, x.broke_cycle) for x in graph.activation_order(nodes, needs).orderBy("position").collect()]
    assert got == [("c", False), ("a", False), ("b", True), ("d", False)]
    imports = spark.createDataFrame([("r", "x", 1, True), ("r", "y", 2, True), ("x", "z", 1, False), ("y", "z", 1, False)], "src string, dst string, pos int, root boolean")
    assert [x.node for x in graph.load_order(imports).orderBy("position").collect()] == ["z", "x", "y", "r"]


def test_strata_return_to_the_first(spark):
    seed = spark.createDataFrame([(1,)], "n long")
    double = lambda df: df.union(df.select(F.col("n") * 2)).where("n < 20").distinct()
    late = lambda df: df.agg(F.max("n").alias("n")).select(F.col("n") + 1).where("n < 7").toDF("n")
    assert {x.n for x in stratified(seed, [double, late], ["n"]).collect()} == {1, 2, 3, 4, 6, 7, 8, 12, 14}


def test_definitions_end_or_circle(spark):
    rows = [("a", "x", "b", "y"), ("b", "y", "c", "z"), ("p", "q", "r", "s"), ("r", "s", "p", "q")]
    got = {(x.package, x.name): (x.def_package, x.def_name) for x in resolve.definitions(spark.createDataFrame(rows, "package string, name string, to_package string, to_name string")).collect()}
    assert got == {("a", "x"): ("c", "z"), ("b", "y"): ("c", "z"), ("p", "q"): (None, None), ("r", "s"): (None, None)}


def test_lexical_lookup_takes_the_nearest(spark):
    chain = resolve.ancestors(spark.createDataFrame([("in", "mid"), ("mid", "top"), ("top", None), ("loop", "loop")], "scope string, parent string"))
    names = spark.createDataFrame([("top", "x", "T"), ("mid", "x", "M"), ("top", "y", "Y")], "scope string, name string, target string")
    uses = spark.createDataFrame([(1, "in", "x"), (2, "in", "y"), (3, "in", "z"), (4, "top", "x")], "use int, scope string, name string")
    assert {x.use: x.target for x in resolve.nearest(uses, chain, names).collect()} == {1: "M", 2: "Y", 3: None, 4: "T"}


def test_report_pieces(spark):
    sites = F.array(*[F.lit(c) for c in "abcdef"])
    assert one(spark, report.evidence_text(sites)) == "a, b, c, d and 2 more" and one(spark, report.evidence_text(F.slice(sites, 1, 2))) == "a, b"
    domains = F.array(F.array(F.lit("c"), F.lit("a"), F.lit("b")), F.lit(None).cast("array<string>"), F.array(F.lit("b"), F.lit("c")))
    assert one(spark, report.domain_intersection(domains)) == ["c", "b"]


def test_images_and_cache(spark, tmp_path):
    for name, data in (("p/a.txt", b"1"), ("p/sub/b.txt", b"2"), ("q/c.txt", b"3")):
        at = tmp_path / "lib" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    before = spark.createDataFrame(images.files(spark, str(tmp_path / "lib")).collect())
    assert sorted((r.package, r.path) for r in before.collect()) == [("p", "a.txt"), ("p", "sub/b.txt"), ("q", "c.txt")]
    want = hashlib.sha256(frame(b"a.txt", hashlib.sha256(b"1").hexdigest().encode(), b"sub/b.txt", hashlib.sha256(b"2").hexdigest().encode())).hexdigest()
    assert images.fingerprints(before).where("package = 'p'").first().fingerprint == want
    (tmp_path / "lib/p/a.txt").write_bytes(b"x")
    assert {r.path: r.state for r in images.compared(before, images.files(spark, str(tmp_path / "lib"))).collect()} == {"a.txt": "changed", "sub/b.txt": "unchanged", "c.txt": "unchanged"}
    cache = Cache(spark, str(tmp_path / "cache"))
    rows = lambda *r: spark.createDataFrame([(n, bytearray(b)) for n, b in r], "name string, bytes binary")
    assert cache.publish(rows(("a", b"1"), ("b", b"2"))) == 2 and cache.publish(rows(("a", b"other"), ("c", b"3"))) == 1
    got = {r.name: r.bytes and bytes(r.bytes) for r in cache.read(spark.createDataFrame([("a",), ("z",)], "name string")).collect()}
    assert got == {"a": b"1", "z": None}
    other, gone = cache.without(F.col("name") == "a", str(tmp_path / "cache2"))
    assert gone == 1 and [r.name for r in other.listing().collect()] == ["b", "c"]


def test_index_and_manifest(spark, tmp_path):
    (tmp_path / "i.json").write_text('{"name":"p","version":"1","fingerprint":"f","exports":{"":"x","lab":"y"},"imports":[{"package":"q"},{"package":"r","names":[{"local":"","remote":"z"}]}],"natives":[{"component":"lib","prefix":"C_","routines":[{"table":"call","name":"go"}],"symbols":["s"],"safety":"unknown"}],"data_sets":{"d":["o"]}}')
    t = index.decode(index.read(spark, str(tmp_path / "i.json")))
    assert sorted((r.export, r.binding) for r in t["exports"].collect()) == [("lab", "y"), ("x", "x")]
    assert [(r.pos, r.kind, r.from_pkg, r.names and [tuple(n) for n in r.names]) for r in t["imports"].orderBy("pos").collect()] == [(0, "all", "q", None), (1, "from", "r", [("z", "z")])]
    (tmp_path / "m.json").write_text('{"schema":1,"packages":[{"name":"p","version":"1","fingerprint":"f","components":[{"component":"lib","safety":"declared","routines":[{"selector":"go","callback_arguments":[0]},{"selector":"go","callback_arguments":[1]}]}]}]}')
    m = index.manifest(spark, str(tmp_path / "m.json"))
    assert sorted(r.problem for r in index.manifest_violations(m).collect()) == ["callback positions count from one", "selector comes twice"]
    assert {r.symbol: r.safety for r in index.apply_manifest(t["natives"], t["packages"], m).collect()} == {"C_go": "declared", "s": "declared"}


def test_emitted_text(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    lines = emit.namespace_lines(t([("p", "x")], "package string, export string"), t([("p", 2, "all", "q", None), ("p", 1, "from", "r", [("a", "b")])], "package string, pos int, kind string, from_pkg string, names array<struct<local:string,remote:string>>"), t([("p", "lib")], "package string, component string"), t([("p", "print", "k", "print.k")], "package string, generic string, class string, method string"))
    assert emit.text(lines, ["package"]).first().text.split("\n") == ['export("x")', 'importFrom("r", "a" = "b")', 'import("q")', 'useDynLib("lib")', 'S3method("print", "k", "print.k")']
    fields = t([("p", "Title", "T"), ("p", "Depends", "linked, R (>= 3.5), (bad"), ("p", "Built", "x")], "package string, field string, value string")
    fields = fields.union(t([("p", "Collate", "a.R b.R"), ("p", "NeedsCompilation", "no"), ("p", "RemoteSha", "1f"), ("p", "Suggests", "x, linked (>= 2)")], fields.schema))
    new, problems = emit.description(fields, t([("linked", "Linked")], "name string, role string"), t([("p", "methods")], "package string, text string"))
    assert sorted((r.field, r.value) for r in new.collect()) == [("Depends", "linked, R (>= 3.5), (bad"), ("Imports", "methods"), ("NeedsCompilation", "no"), ("RemoteSha", "1f"), ("Suggests", "x"), ("Title", "T")]
    assert sorted(r.problem for r in problems.collect()) == ["cannot be read: (bad", "names the linked package linked"]


def test_root_specs():
    assert RootSpec.parse("foo.bar").kind == "name" and RootSpec.parse("./x").kind == "directory"
    for bad in ("", "1a", "a.", "a b"):
        with pytest.raises(ValueError, match="package name|path"):
            RootSpec.parse(bad)


def test_call_rules(spark):
    from provena.operators import calls

    rows = [(1, "assign", ["", "", "envir"], ["v", None, None], 2), (2, "get", ["envir", ""], [None, "n"], 0), (3, "get", ["", "envir"], [None, None], 1), (4, "ls", [""], [None], 0), (5, "list2env", [""], [None], 0), (6, "mystery", [""], [None], 0), (7, "environmentName", [""], [None], 0), (8, "makeActiveBinding", ["", "", ""], ["b", None, None], 2)]
    df = spark.createDataFrame(rows, "call int, callee string, names array<string>, statics array<string>, index int")
    assert {r.call: r.created for r in calls.created_names(df).collect()} == {1: "v", 5: None, 8: "b"}
    assert {r.call: r.name for r in calls.looked_up_names(df).collect()} == {2: "n", 3: None}
    got = {r.call: (r.action, r.name) for r in calls.namespace_actions(df).collect()}
    assert got == {1: ("write", "v"), 2: ("read", "n"), 3: ("escape", None), 4: ("names", None), 5: ("escape", None), 6: ("escape", None), 7: ("supported", None), 8: ("write", "b")}
    native = spark.createDataFrame([(1, ["", "", "PACKAGE", ""], 2), (2, [""], 1)], "call int, names array<string>, position int")
    assert {r.call: r["index"] for r in calls.native_argument(native).collect()} == {1: 3, 2: None}


def test_relocations(spark):
    from provena.operators import relocate

    sources = spark.createDataFrame([("a", "é foo::bar data")], "source string, text string")
    schema = "source string, start int, end int, kind string, package string, name string, component string, table string, flag boolean"
    plans = spark.createDataFrame([("a", 3, 11, "binding", "foo", "bar", None, None, None), ("a", 12, 16, "loaded_query", "foo", None, None, None, None)], schema)
    assert relocate.rewritten(plans, sources, "root").first().text == 'é base::getExportedValue(base::asNamespace("foo"), "bar") TRUE'
    bad = spark.createDataFrame([("a", 3, 11, "dataset", "foo", "iris", None, None, None), ("a", 9, 99, "resource", "foo", "x", None, None, None)], schema)
    carried = spark.createDataFrame([], "package string, name string")
    assert sorted(r.problem for r in relocate.rejected(bad, sources, carried).collect()) == ["names a dataset that is not carried", "outside its code", "overlaps another"]
    roles = spark.createDataFrame([("foo", "Linked")], "name string, role string")
    assert relocate.needed(plans, roles).count() == 2
