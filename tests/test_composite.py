"""Composite reports and phases on literal graphs."""

import pytest
from pyspark.sql import functions as F

from codeloom.model import Graph
from codeloom.operators import composite
from codeloom.plans import phases

NODES = "id string, label string, name string, filePath string, content string, cohesion double"
EDGES = "src string, dst string, type string, confidence double, reason string, step int"


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(
        [
            ("file:auth", "File", "auth.ts", "src/auth.ts", "login validate token", None),
            ("file:router", "File", "router.ts", "src/router.ts", "route request", None),
            ("f:login", "Function", "login", "src/auth.ts", "login user token", None),
            ("f:validate", "Function", "validate", "src/auth.ts", "validate login", None),
            ("f:route", "Function", "route", "src/router.ts", "call login", None),
            ("f:other", "Function", "other", "src/x.ts", "nothing", None),
            ("comm:a", "Community", "Auth", "", None, 0.8),
            ("proc:p", "Process", "Flow", "", None, None),
        ],
        NODES,
    )
    e = spark.createDataFrame(
        [("f:route", "f:login", "CALLS", 1.0, "", None), ("f:login", "f:validate", "CALLS", 1.0, "", None), ("f:login", "comm:a", "MEMBER_OF", 1.0, "", None), ("f:login", "proc:p", "STEP_IN_PROCESS", 1.0, "", 1), ("f:validate", "proc:p", "STEP_IN_PROCESS", 1.0, "", 2)],
        EDGES,
    )
    return Graph(n, e)


def test_file_and_symbol_search(spark, graph):
    files = composite.file_hits(composite.node_hits(graph, ["login"])).collect()
    assert files[0]["filePath"] == "src/auth.ts" and {r["filePath"] for r in files} == {"src/auth.ts", "src/router.ts"}
    hits = composite.symbol_search(graph, ["login"])
    assert {r["id"] for r in hits.collect()} == {"f:login", "f:validate", "f:route"}
    vectors = spark.createDataFrame([("f:other", 1), ("f:login", 2)], "id string, rank int")
    fused = {r["id"]: r["sources"] for r in composite.symbol_search(graph, ["login"], vectors).collect()}
    assert fused["f:login"] == "bm25,semantic" and fused["f:other"] == "semantic"
    assert composite.symbol_search(graph, ["absent"]).count() == 0


def test_process_query_and_enrichment(graph):
    hits = composite.symbol_search(graph, ["login"])
    processes, symbols, definitions = composite.process_query(graph, hits)
    row = processes.first()
    assert row["process"] == "proc:p" and row["n_symbols"] == 2 and row["boost"] == 0.8
    assert {r["id"] for r in symbols.collect()} == {"f:login", "f:validate"} and [r["id"] for r in definitions.collect()] == ["f:route"]
    login = composite.enrich(graph, hits).where("id = 'f:login'").first()
    assert (login["callers"], login["callees"], login["cluster"], login["processes"]) == (["f:route"], ["f:validate"], "comm:a", ["proc:p"])
    found = composite.augment(graph, "login user").collect()
    assert found[0]["id"] == "f:login" and found[0]["cohesion"] == 0.8
    assert composite.augment(graph, "  ").count() == 0


def test_group_query(spark):
    rows = spark.createDataFrame([("a", "p1", 1, "svc/x"), ("a", "p2", 2, "svc/x"), ("b", "q1", 1, "other")], "repo string, process string, rank int, filePath string")
    assert [r["process"] for r in composite.group_query(rows, 2).collect()] == ["p1", "q1"]
    assert composite.group_query(rows, 9, "svc").count() == 2


def test_routes_fetches_middleware(spark):
    routes = spark.createDataFrame([("Route:/api/a", "/api/a", 0), ("Route:/api/[id]", "/api/[id]", 1)], "id string, url string, seq int")
    fetches = spark.createDataFrame([("f1", "/api/a?x=1", ["k"]), ("f1", "/api/9", ["m"]), ("f2", "/none/x", []), ("f3", "`/api/${id}`", [])], "consumer string, url string, keys array<string>")
    got = {(r["src"], r["dst"]): r["reason"] for r in composite.fetch_edges(fetches, routes).collect()}
    assert got == {("f1", "Route:/api/a"): "fetch-url-match|keys:k|fetches:2", ("f1", "Route:/api/[id]"): "fetch-url-match|keys:m|fetches:2", ("f3", "Route:/api/a"): "fetch-url-match|keys:"}
    r = spark.createDataFrame([("/api/a", ["log", "auth"]), ("/x", None)], "url string, middleware array<string>")
    m = spark.createDataFrame([("/api/:path*", "auth")], "pattern string, label string")
    for limit in (10, 0):
        assert {x["url"]: x["middleware"] for x in composite.attach_middleware(r, m, limit).collect()} == {"/api/a": ["auth", "log"], "/x": []}
    twice = spark.createDataFrame([("/a", "f2", 2), ("/a", "f1", 1)], "url string, filePath string, seq int")
    assert composite.register_routes(twice).first()["filePath"] == "f1"


def test_links_heritage_imports(spark, graph):
    processes = spark.createDataFrame([("proc:p", "f:login")], "id string, entryPointId string")
    routes = spark.createDataFrame([("r1", "f:login", "zzz"), ("r2", None, "src/auth.ts"), ("r3", None, "none")], "id string, handler string, filePath string")
    tools = routes.limit(0)
    assert sorted((x["src"], x["dst"]) for x in composite.link_processes(processes, routes, tools, graph.nodes).collect()) == [("r1", "proc:p"), ("r2", "proc:p")]
    nodes = spark.createDataFrame([("A", "Class"), ("I", "Interface"), ("J", "Interface"), ("B", "Class")], "id string, label string")
    parents = spark.createDataFrame([("s1", "A", "EXTENDS"), ("s2", "A", None), ("s3", "J", "EXTENDS")], "site string, child string, kind string")
    resolved = spark.createDataFrame([("s1", "I", 0.9), ("s2", "B", 0.9), ("s3", "I", 0.9)], "site string, id string, confidence double")
    assert sorted((x["src"], x["dst"], x["type"]) for x in composite.heritage_edges(parents, resolved, nodes).collect()) == [("A", "B", "EXTENDS"), ("A", "I", "IMPLEMENTS"), ("J", "I", "EXTENDS")]
    imports = spark.createDataFrame([("f", "x"), ("f", "y")], "file string, spec string")
    one = spark.createDataFrame([("f", "x", "t1")], "file string, spec string, target string")
    two = spark.createDataFrame([("f", "x", "t2"), ("f", "y", "t3")], "file string, spec string, target string")
    assert {x["spec"]: x["target"] for x in composite.first_strategy(imports, [one, two]).collect()} == {"x": "t1", "y": "t3"}
    mro = spark.createDataFrame([("D", 1, "A"), ("D", 0, "B")], "child string, pos int, ancestor string")
    heritage = spark.createDataFrame([("B", "I", "IMPLEMENTS")], "child string, parent string, kind string")
    order, impl = composite.dispatch_index(mro, heritage)
    assert order.first()["mro"] == ["B", "A"] and impl.first()["implementors"] == ["B"]


def test_group_sync(spark):
    routes = spark.createDataFrame([("api", "u1", "/Orders/:id/", "get", "svc/orders/r.ts")], "repo string, uid string, url string, method string, filePath string")
    fetches = spark.createDataFrame([("web", "u2", "https://h/orders/42", None, "src/x.ts")], "repo string, uid string, url string, method string, filePath string")
    boundaries = spark.createDataFrame([("api", "svc"), ("api", "svc/orders")], "repo string, prefix string")
    declared = spark.createDataFrame([("web", "billing", "topic::paid", "topic")], "from_repo string, to_repo string, contract_id string, type string")
    contracts, links = composite.sync_group(composite.http_contracts(routes, fetches), boundaries, declared)
    assert contracts.where("repo = 'api'").first()["service"] == "api/svc/orders"
    got = sorted((r["from_repo"], r["to_repo"], r["match_type"]) for r in links.collect())
    assert got == [("web", "api", "exact"), ("web", "billing", "manifest")]


@pytest.mark.parametrize(("language", "name", "header", "want"), [("typescript", "a", "export function a", True), ("typescript", "a", "function a", False), ("python", "_a", "", False), ("go", "Get", "func Get", True), ("go", "get", "", False), ("java", "a", "public int a", True), ("java", "a", "int a", False), ("rust", "a", "pub fn a", True), ("c", "a", "static int a", False), ("kotlin", "a", "fun a", True), ("ruby", "a", "def a", True)])
def test_exports(spark, language, name, header, want):
    row = spark.range(1).select(composite.is_exported(F.lit(language), F.lit(name), F.lit(header)).alias("e")).first()
    assert row["e"] is want


def test_phases():
    seen = []

    def step(name, *needs):
        return phases.Phase(name, lambda got: seen.append((name, sorted(got))) or name, needs)

    run = phases.run_phases([step("load", "parse"), step("parse", "scan"), step("scan")])
    assert [s[0] for s in seen] == ["scan", "parse", "load"] and seen[2] == ("load", ["parse"]) and set(run.seconds) == {"scan", "parse", "load"}
    with pytest.raises(phases.CycleError, match="a -> b"):
        phases.ordered([step("a", "b"), step("b", "a"), step("c")])
    with pytest.raises(ValueError, match="unknown"):
        phases.ordered([step("a", "zzz")])
    assert phases.language_rules("python") == ("namespace", "c3") and phases.language_rules("vue") == ("named", "first-wins")
