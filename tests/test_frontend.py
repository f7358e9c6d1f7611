"""Facts of R sources, and the demand analysis on facts that come from text."""

import json

import pytest

from provena.frontend.facts import analysis_tables, extract, facts_of
from provena.frontend.syntax import SyntaxProblem, parse
from provena.plans import analysis
from provena.schemas import TABLES


def found(text, *kinds):
    return [(f["kind"], f["name"], f["target"], f["guard"]) for f in facts_of(text) if f["kind"] in kinds]


def names(text, kind, target=None):
    return [f["name"] for f in facts_of(text) if f["kind"] == kind and target in (None, f["target"])]


def shape(node):
    inner = [shape(p) for p in node.parts]
    return f"({node.value or node.kind} {' '.join(inner)})" if inner else node.value or node.kind


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("-a^2 + b * c", "(+ (- (^ a 2)) (* b c))"),
        ("a <- b <- c", "(<- a (<- b c))"),
        ("1 -> x", "(<- x 1)"),
        ("!a == b && c | d", "(| (&& (! (== a b)) c) d)"),
        ("a$b$c(1)[[2]]", "([[ (call ($ ($ a b) c) 1) 2)"),
        ("x %in% y : z", "(%in% x (: y z))"),
        ("p::f(x) |> g(y)", "(call g (call (:: p f) x) y)"),
        ("if (a) b else if (c) d", "(if a b (if c d))"),
        ("{a; b\nc}", "({ a b c)"),
        ("f(a,\n b = , 'c' = 3)", "(call f a missing 3)"),
        ("m[1, ]", "([ m 1 missing)"),
        ("function(x, y = 2) x", "(function missing 2 x)"),
        ("\\(x) x + 1", "(function missing (+ x 1))"),
        ("(a\n+ b)", "(paren (+ a b))"),
        ("a\n+ b", "a (+ b)"),
        ("y ~ x | z", "(~ y (| x z))"),
        ("`a b` <- r\"(x\\y)\"", "(<- a b x\\y)"),
        ("'q\\n\\x41\\u{e9}'", "q\nAé"),
        ("repeat { break }", "(repeat ({ break))"),
        ("for (i in 1:3) while (TRUE) next", "(i (: 1 3) (while TRUE next))"),
        ("x = 5; y := 1", "(= x 5) (:= y 1)"),
        ("0x1FL + 1e-3 # end", "(+ 0x1FL 1e-3)"),
    ],
)
def test_grammar(text, want):
    assert " ".join(shape(p) for p in parse(text).parts) == want


@pytest.mark.parametrize("text", ["(1 + ", "f(a", "'x", "x <- ", "a b", "function(1) x", "if a", "}", "x[[1]", "r\"(x"])
def test_what_is_no_program_is_an_issue(text):
    with pytest.raises(SyntaxProblem):
        parse(text)
    assert [f["kind"] for f in facts_of(text)] == ["issue"]


def test_odd_texts():
    assert facts_of(None) == [] and facts_of("") == [] and facts_of("# only a remark\n\n") == []
    assert [f["kind"] for f in facts_of("(" * 100_000)] == ["issue"]
    assert len(facts_of("x\n" * 20_000)) == 40_000


def test_bound_conditional_lexical_external():
    text = "f <- function(a, flag) { if (flag) b <- 1 else stop('no'); b; if (flag) c <- 2; c; for (i in a) d <- i; d; i; g <- function() { a + b + e }; e <- 3; outer }"
    uses = [(f["name"], f["target"]) for f in facts_of(text) if f["kind"] == "use"]
    assert uses == [("flag", "bound"), ("stop", "external"), ("b", "bound"), ("flag", "bound"), ("c", "conditional"), ("a", "bound"), ("i", "bound"), ("d", "conditional"), ("i", "conditional"), ("a", "lexical"), ("b", "lexical"), ("e", "lexical"), ("outer", "external")]
    assert names(text, "used_parameters", "a,flag") == [None]
    # all paths bind, or leave
    assert names("f <- function(x) { if (x) { y <- 1 } else if (x > 2) { y <- 2 } else return(3); y }", "reference") == ["return"]
    # a function may call itself
    assert "fact" not in names("fact <- function(n) if (n < 2) 1 else n * fact(n - 1)", "reference")


def test_references_and_masks():
    text = "f <- function(df) { with(df, p + q); subset(df, r > 1); z ~ w; quote(s); x %op% y }"
    assert names(text, "reference", "maybe_local") == ["p", "q", "r"]
    assert names(text, "reference", "free") == ["x", "y"] and "%op%" in names(text, "reference", "callee")
    assert names(text, "data_mask") == ["with", "subset"]


def test_guards():
    text = "if (requireNamespace('p') && (isNamespaceLoaded('q'))) { p::f(); g() } else h()\nsetHook(packageEvent('r', 'onLoad'), function(...) k())\nif (requireNamespace('s') || x) t()"
    guards = {f["name"]: f["guard"] for f in facts_of(text) if f["kind"] in ("call", "access")}
    assert guards["f"] == guards["g"] == "p,q" and guards["h"] is None and guards["k"] == "r" and guards["t"] is None


def test_effects_and_replacements():
    text = "f <- function() { n <- 0; g <- function(v) { n <<- v; total <<- w; opts$a$b <<- 1 } ; names(x)[2] <- y; attr(x, 'k') <- 1 }"
    effects = [(f["name"], f["detail"]["captured"], f["detail"].get("value"), f["detail"]["whole"]) for f in facts_of(text) if f["kind"] == "super_assignment"]
    assert effects == [("n", True, "v", True), ("total", False, "w", True), ("opts", False, None, False)]
    assert "w" not in names(text, "reference") and names(text, "replacement") == ["[<-", "names<-", "attr<-"]


def test_calls_and_what_they_mean():
    text = "f <- function(x, n = 5, m = n, k = 1) { k <- 2; e <- environment(); makeActiveBinding('b', function() 1, e); system.file('a', 'b.txt', package = 'p', mustWork = TRUE); system.file(x, package = 'p'); assign('v', 1); list2env(x); UseMethod('gen'); .__NAMESPACE__.$spec; x[1]; -x; p:::q }"
    rows = facts_of(text)
    get = lambda kind: [(f["name"], f["target"]) for f in rows if f["kind"] == kind]
    assert get("pinned_default") == [("n", '{"number": "5"}')] and get("environment_alias") == [("e", "environment()")]
    assert get("active_binding") == [("b", None)] and get("resource") == [("a/b.txt", "p"), (None, "p")]
    assert get("creator") == [("v", "assign"), (None, "list2env")] and get("dispatch") == [("gen", "UseMethod")] and get("namespace_info") == [("spec", None)]
    assert [x for x, _ in get("dispatch_syntax")] == ["$", "[", "-"] and get("access") == [("q", "p")]
    assert [f["detail"]["internal"] for f in rows if f["kind"] == "access"] == [True]


def test_declarations_are_inert():
    text = "f <- function(x) { declare(provena(s3(x = c('a', 'b')), strings(y = 'q', x = 'z'), other(w = 'v'), s3(v = 1 + u))); x }"
    assert found(text, "declaration") == [("declaration", "x", "s3", None), ("declaration", "y", "strings", None)]
    assert [t for _, _, t, _ in found(text, "issue")] == ["two kinds of domain", "no such domain", "a domain is a vector of strings"]
    assert names(text, "reference") == [] and names(text, "call") == []


def test_places_are_bytes():
    f = next(f for f in facts_of("é <- 'ü'; g(é)") if f["kind"] == "call")
    assert (f["start"], f["end"]) == (12, 17)


def test_facts_feed_the_analysis(spark):
    rows = [
        ("root", "f", "f <- function(x) { dep::go(x); helper(x); if (requireNamespace('gone')) gone::away() }"),
        ("root", "helper", "helper <- function(y) { paste(y); nowhere }"),
        ("root", "idle", "idle <- function() dep::unused()"),
        ("dep", "go", "go <- function(z) { UseMethod('go'); declare(provena(s3(z = 'a'))) }"),
        ("dep", "go.a", "go.a <- function(z) inner(z)"),
        ("dep", "go.b", "go.b <- function(z) lost(z)"),
        ("dep", "inner", "inner <- function(z) system.file('x.txt', package = 'dep')"),
        ("dep", "unused", "unused <- function() 1"),
        ("dep", "broken", "broken <- function( {"),
    ]
    sources = spark.createDataFrame(rows, "package string, source_key string, text string")
    facts = extract(sources.repartition(3)).cache()
    t = lambda name, values: spark.createDataFrame(values, TABLES[name])
    tables = analysis_tables(facts) | {
        "packages": t("packages", [("root", "1", "a", None, True), ("dep", "1", "b", None, False)]),
        "relations": t("relations", [("root", "Suggests", "gone", None, None, 0)]),
        "bindings": t("bindings", [(p, k, "Closure", s, "", False) for p, k, s in rows]),
        "exports": t("exports", [("root", "f", "f"), ("dep", "go", "go"), ("dep", "unused", "unused")]),
        "base_bindings": t("base_bindings", [(x,) for x in ("paste", "requireNamespace", "UseMethod", "system.file")]),
        "s3": t("s3", [("dep", None, "go", "a", "go.a"), ("dep", None, "go", "b", "go.b")]),
        "files": t("files", [("dep", "x.txt")]),
    }
    got = analysis.analyze(spark, tables, analysis.Options("root"))
    nodes = {r.node for r in got.nodes.collect()}
    assert {"binding:root::f", "binding:root::helper", "binding:dep::go", "binding:dep::go.a", "binding:dep::inner", "resource:dep/x.txt"} <= nodes
    assert not {"binding:root::idle", "binding:dep::unused", "binding:dep::go.b", "missing:gone"} & nodes
    assert sorted((r.package, r.code, r.message) for r in got.blockers.collect()) == [("root", "UnresolvedName", "cannot resolve nowhere")]
    assert facts.where("kind = 'issue'").count() == 1
    call = facts.where("kind = 'call' and name = 'go'").first()
    assert json.loads(call.detail)["arguments"][0]["static"] == {"symbol": "x"}
