"""Operators on literal graphs: expected values are worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import predicates, risk, text, urls
from codeloom.functions.frameworks import ast_multiplier, path_multiplier
from codeloom.functions.porter import porter, stem
from codeloom.model import Graph, first_writer_wins, label_of
from codeloom.operators import analytics, contracts, embedding, impact, incremental, relational, reports, resolution, search, structure, traverse

NODES = "id string, label string, name string, filePath string, startLine long, endLine long, isExported boolean, content string, description string, declaredType string"
EDGES = "src string, dst string, type string, confidence double, reason string, step int"


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame(
        [
            ("file:auth.ts", "File", "auth.ts", "src/auth.ts", None, None, None, "login() {\n validate()\n}", None, None),
            ("func:login", "Function", "login", "src/auth.ts", 1, 15, True, "function login() {}", "logs in", None),
            ("func:validate", "Function", "validate", "src/auth.ts", 17, 25, True, "x", None, None),
            ("func:hash", "Function", "hash", "src/utils.ts", 1, 8, True, "y", None, None),
            ("func:test", "Function", "check", "src/tests/auth.test.ts", 1, 8, False, "y", None, None),
            ("class:AuthService", "Class", "AuthService", "src/auth.ts", 30, 60, True, "z", None, None),
            ("ctor:AuthService", "Constructor", "AuthService", "src/auth.ts", 31, 33, True, "z", None, None),
            ("prop:svc", "Property", "svc", "src/app.ts", 3, 3, True, None, None, "Map<AuthService>"),
            ("func:main", "Function", "main", "src/main.ts", 1, 9, True, "m", None, None),
            ("comm:auth", "Community", "Authentication", "", None, None, None, None, None, None),
            ("proc:login-flow", "Process", "LoginFlow", "", None, None, None, None, None, None),
        ],
        NODES,
    )
    e = spark.createDataFrame(
        [
            ("func:login", "func:validate", "CALLS", 1.0, "direct", None),
            ("func:login", "func:hash", "CALLS", 0.9, "import-resolved", None),
            ("func:main", "func:login", "CALLS", 0.0, "", None),
            ("func:test", "func:login", "CALLS", 1.0, "", None),
            ("func:main", "ctor:AuthService", "CALLS", 0.8, "", None),
            ("prop:svc", "func:main", "CALLS", None, "", None),
            ("class:AuthService", "ctor:AuthService", "HAS_METHOD", 1.0, "", None),
            ("file:auth.ts", "class:AuthService", "DEFINES", 1.0, "", None),
            ("func:login", "comm:auth", "MEMBER_OF", 1.0, "", None),
            ("func:login", "proc:login-flow", "STEP_IN_PROCESS", 1.0, "", 1),
            ("func:validate", "proc:login-flow", "STEP_IN_PROCESS", 1.0, "", 2),
        ],
        EDGES,
    )
    return Graph(n, e)


def ids(df, column="id"):
    return sorted(r[column] for r in df.select(column).collect())


def frame(spark, values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


# ---- traversal


def test_bfs_levels_and_parent_choice(spark):
    e = spark.createDataFrame([("a", "b", "CALLS", 0.5), ("a", "c", "CALLS", 0.9), ("b", "d", "CALLS", 0.2), ("c", "d", "CALLS", 0.8), ("d", "a", "CALLS", 1.0), ("d", "e", "CALLS", None)], "src string, dst string, type string, confidence double")
    found = {r["id"]: (r["depth"], r["parent"]) for r in traverse.bfs(e, frame(spark, ["a"]), "down", 3).collect()}
    assert found == {"b": (1, "a"), "c": (1, "a"), "d": (2, "c"), "e": (3, "d")}
    assert ids(traverse.bfs(e, frame(spark, ["d"]), "up", 1)) == ["b", "c"]
    assert ids(traverse.bfs(e, frame(spark, ["a"]), "down", 3, node_filter=frame(spark, ["b", "d"]))) == ["b", "d"]
    assert traverse.bfs(e, frame(spark, ["nowhere"]), "down", 3).count() == 0


def test_bfs_equals_a_queue_on_random_graphs(spark):
    rng = random.Random(1)
    for _ in range(3):
        edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(60)}
        e = spark.createDataFrame([(str(a), str(b), "CALLS", 1.0) for a, b in edges], "src string, dst string, type string, confidence double")
        depth, queue = {0: 0}, [0]
        while queue:
            x = queue.pop(0)
            for a, b in edges:
                if a == x and b not in depth and depth[x] < 3:
                    depth[b] = depth[x] + 1
                    queue.append(b)
        got = {int(r["id"]): r["depth"] for r in traverse.bfs(e, frame(spark, ["0"]), "down", 3).collect()}
        assert got == {k: v for k, v in depth.items() if v}


def test_topological_levels_and_scc(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x")], "src string, dst string")
    assert {r["id"]: r["level"] for r in traverse.topological_levels(e).collect()} == {"c": 0, "b": 1, "a": 2, "x": -1, "y": -1, "z": -1}
    assert {r["id"]: r["scc"] for r in traverse.strongly_connected(e).collect()} == {"a": "a", "b": "b", "c": "c", "x": "x", "y": "x", "z": "z"}


def test_levels_and_components_are_whole_or_an_error(spark):
    chain = spark.createDataFrame([(f"{i:02}", f"{i - 1:02}") for i in range(7, 0, -1)], "src string, dst string")
    assert {r["id"]: r["scc"] for r in traverse.strongly_connected(chain, max_rounds=3).collect()} == {f"{i:02}": f"{i:02}" for i in range(8)}
    cycles = spark.createDataFrame([("x", "y"), ("y", "x"), ("y", "a"), ("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(RuntimeError):
        traverse.strongly_connected(cycles, max_rounds=1)
    with pytest.raises(RuntimeError):
        traverse.topological_levels(chain, max_levels=3)
    assert traverse.topological_levels(chain, max_levels=8).where("level = CAST(id AS INT)").count() == 8


def test_traces_cycles_depth_and_dedupe(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e")], "src string, dst string")
    got = sorted(tuple(r["path"]) for r in traverse.traces(e, frame(spark, ["a"])).collect())
    assert got == [("a", "b", "c"), ("a", "b", "d", "e")]
    assert sorted(tuple(r["path"]) for r in traverse.traces(e, frame(spark, ["a"]), max_depth=3).collect()) == [("a", "b", "c"), ("a", "b", "d")]
    assert traverse.traces(e, frame(spark, ["a"]), per_entry=1).count() == 1
    paths = spark.createDataFrame([(["a", "b", "c", "d"],), (["b", "c", "d"],), (["a", "x", "d"],), (["a", "b", "cc"],)], "path array<string>")
    left = traverse.drop_contained(paths)
    assert sorted(map(tuple, (r["path"] for r in left.collect()))) == [("a", "b", "c", "d"), ("a", "b", "cc"), ("a", "x", "d")]
    assert sorted(map(tuple, (r["path"] for r in traverse.longest_per_ends(left).collect()))) == [("a", "b", "c", "d"), ("a", "b", "cc")]


def test_include_closure_order_and_cap(spark):
    e = spark.createDataFrame([("a", "b", "I", 1.0), ("a", "c", "I", 1.0), ("b", "d", "I", 1.0)], "src string, dst string, type string, confidence double")
    rows = traverse.include_closure(e, frame(spark, ["a"]), cap=2).orderBy("position").collect()
    assert [r["id"] for r in rows] == ["b", "c"]


# ---- impact


def test_impact_filters(spark, graph):
    seeds = frame(spark, ["func:validate"])
    up = impact.impact(graph, seeds, "upstream")
    assert {r["id"]: r["depth"] for r in up.collect()} == {"func:login": 1, "func:main": 2, "prop:svc": 3}
    assert up.where("id = 'func:main'").first()["confidence"] == 0.9
    assert "func:test" in ids(impact.impact(graph, seeds, include_tests=True))
    assert ids(impact.impact(graph, seeds, confidence=0.95)) == ["func:login"]
    assert ids(impact.impact(graph, seeds, relation_types=["NONSENSE"])) == ids(up)
    assert impact.impact(graph, seeds, max_depth=0).count() == 1


def test_class_seeds(spark, graph):
    assert ids(impact.class_seeds(graph, frame(spark, ["class:AuthService"]))) == ["class:AuthService", "ctor:AuthService", "file:auth.ts", "prop:svc"]


def test_impact_enrichment(spark, graph):
    found = impact.impact(graph, frame(spark, ["func:hash"]))
    steps = graph.type("STEP_IN_PROCESS").selectExpr("src AS id", "dst AS process", "step")
    modules = impact.affected_modules(found, graph.type("MEMBER_OF").selectExpr("src AS id", "dst AS module"))
    processes = impact.affected_processes(found, steps)
    assert tuple(processes.first()) == ("proc:login-flow", 1, 1) and tuple(modules.first()) == ("comm:auth", 1, "direct")
    assert impact.summary(found, processes, modules).first()["risk"] == "LOW"


@pytest.mark.parametrize(("direct", "proc", "mod", "total", "want"), [(30, 0, 0, 30, "CRITICAL"), (0, 5, 0, 0, "CRITICAL"), (15, 0, 0, 15, "HIGH"), (5, 0, 0, 5, "MEDIUM"), (0, 0, 0, 30, "MEDIUM"), (4, 2, 2, 29, "LOW")])
def test_risk_classes(spark, direct, proc, mod, total, want):
    row = spark.range(1).select(risk.impact_risk(*map(F.lit, (direct, proc, mod, total))).alias("r")).first()
    assert row["r"] == want


def test_merged_and_api_risk(spark):
    one = spark.range(1)
    merged = lambda local, n, c: one.select(risk.merged_risk(F.lit(local), F.lit(n), F.lit(c).cast("double")).alias("r")).first()["r"]
    assert [merged("LOW", 0, None), merged("LOW", 1, 0.5), merged("MEDIUM", 1, 0.5), merged("LOW", 1, 0.9), merged("LOW", 3, 0.1), merged("CRITICAL", 0, None)] == ["LOW", "MEDIUM", "MEDIUM", "HIGH", "CRITICAL", "CRITICAL"]
    api = lambda n, bad: one.select(risk.api_risk(F.lit(n), F.lit(bad)).alias("r")).first()["r"]
    assert [api(0, False), api(0, True), api(4, True), api(10, True)] == ["LOW", "MEDIUM", "HIGH", "HIGH"]


# ---- search


def test_rrf_offsets_and_sources(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    got = {r["k"]: (round(r["score"], 9), r["sources"]) for r in search.rrf({"bm25": a, "semantic": b}, "k", 1).collect()}
    assert got == {"x": (round(1 / 61, 9), "bm25"), "y": (round(1 / 62 + 1 / 61, 9), "bm25,semantic")}
    assert search.rrf({"bm25": a}, "k", 0).where("k = 'x'").first()["score"] == pytest.approx(1 / 60)
    assert [r["rank"] for r in search.rrf({"bm25": a, "semantic": b}, "k", 1, 1).collect()] == [1]


def test_cosine_edges(spark):
    d = lambda a, b: spark.range(1).select(search.cosine_distance(F.lit(a).cast("array<double>"), F.lit(b).cast("array<double>")).alias("d")).first()["d"]
    assert d([1.0, 0.0], [0.0, 2.0]) == 1.0 and d([0.0, 0.0], [1.0, 1.0]) == 1.0
    assert d([1.0, 2.0], [2.0, 4.0]) == pytest.approx(0.0) and d([1.0, 0.0, 5.0], [1.0, 0.0]) == pytest.approx(0.0)


def test_best_chunk_is_order_independent(spark):
    rows = spark.createDataFrame([("n", 0.5, 1), ("n", 0.1, 2), ("m", 0.3, 1)], "node string, distance double, chunkIndex int")
    assert [(r["node"], r["distance"]) for r in search.best_chunk(rows, "node", 5).collect()] == [("n", 0.1), ("m", 0.3)]


def test_bm25_empty_and_special(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "alpha alpha")], "doc_id long, text string")
    assert search.bm25(docs, []).count() == 0 and search.bm25(docs, ["%$#"]).count() == 0
    scores = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["alpha"]).collect()}
    assert set(scores) == {1, 4} and scores[4] > scores[1] > 0
    assert [r["doc_id"] for r in search.bm25(docs, ["alpha", "beta"], conjunctive=True).collect()] == [1]
    index = search.postings(docs, "doc_id", "text", porter)
    assert {r["term"] for r in index.collect()} == {stem("alpha"), stem("beta")}


def test_overlay_and_grep(spark):
    files = spark.createDataFrame([("a", 0.2), ("b", 3.0)], "filePath string, score double")
    fresh = spark.createDataFrame([("a", "the quick fox"), ("b", "nothing"), ("c", "fox quick")], "filePath string, content string")
    got = {r["filePath"]: r["score"] for r in search.overlay_correction(files, fresh, "quick fox").collect()}
    assert got == {"a": 1.0, "c": 1.0}
    text_files = spark.createDataFrame([("a", "x\nHello World\nhello"), ("b", None)], "filePath string, content string")
    assert [(r["path"], r["line"]) for r in search.grep(text_files, "HELLO").collect()] == [("a", 2), ("a", 3)]
    assert search.grep(text_files, "hello", limit=0).count() == 0


def test_hashing_embedder_is_unit_and_stable(spark):
    embed = search.hashing_embedder(16)
    v = spark.createDataFrame([("a b c",), ("",)], "t string").select(embed("t").alias("v")).collect()
    assert sum(x * x for x in v[0]["v"]) == pytest.approx(1.0, abs=1e-5) and not any(v[1]["v"])


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("sky", "sky"), ("probate", "probat"), ("controll", "control"), ("authentication", "authent")])
def test_porter(word, want):
    assert stem(word) == want


# ---- joins and windows


def test_range_overlap_join_equals_nested_loop(spark):
    rng = random.Random(2)
    a = [(rng.choice("pq"), i, s := rng.randrange(200), s + rng.randrange(-3, 90)) for i in range(60)]
    b = [(rng.choice("pq"), i, s := rng.randrange(200), s + rng.randrange(-3, 90)) for i in range(60)]
    left = spark.createDataFrame(a, "file string, a int, start long, end long")
    right = spark.createDataFrame(b, "file string, b int, r_start long, r_end long")
    got = sorted((r["a"], r["b"]) for r in relational.range_overlap_join(left, right, "file", 16).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and x[3] >= y[2])
    assert got == want


def test_innermost_scope(spark):
    sites = spark.createDataFrame([("s1", "f", 5), ("s2", "f", 50)], "site string, file string, pos long")
    scopes = spark.createDataFrame([("f", "mod", 0, 100), ("f", "fn", 3, 10)], "file string, scope string, r_start long, r_end long")
    assert {r["site"]: r["scope"] for r in relational.innermost(sites, scopes).collect()} == {"s1": "fn", "s2": "mod"}


def test_common_prefix_and_mode(spark):
    df = spark.createDataFrame([("abcd", "abxy"), ("q", "z"), ("same", "same")], "a string, b string")
    assert [r["p"] for r in df.select(relational.common_prefix(F.col("a"), F.col("b")).alias("p")).collect()] == ["ab", "", "same"]


def test_first_writer_wins_and_labels(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early")], "id string, seq int, v string")
    assert first_writer_wins(df, "id", "seq").first()["v"] == "early"
    got = spark.createDataFrame([("Function:x",), ("comm_1",), ("proc_2_a",)], "id string").select(label_of("id").alias("l")).collect()
    assert [r["l"] for r in got] == ["Function", "Community", "Process"]


# ---- contracts

CONTRACTS = "repo string, service string, contract_id string, type string, role string, symbol_uid string, file_path string, ref_name string, symbol_name string, confidence double, source string, seq int"


def contract(repo, cid, role, uid, service=None, confidence=0.8, source="scan", seq=0, name="n", file="f"):
    return (repo, service, cid, cid.split("::")[0], role, uid, file, name, name, confidence, source, seq)


def test_contract_matching(spark):
    rows = [
        contract("a", "http::get::/x/", "provider", "p1"),
        contract("b", "http::GET::/x", "consumer", "c1"),
        contract("b", "http::*::/x", "consumer", "c2"),
        contract("a", "http::GET::/x", "consumer", "c3"),
        contract("a", "http::GET::/x", "consumer", "c4", service="other"),
        contract("a", "thrift::com.acme.User/get", "provider", "p2"),
        contract("b", "thrift::user/get", "consumer", "c5"),
        contract("a", "grpc::pkg.Svc/Do", "provider", "p3", confidence=0.6),
        contract("b", "grpc::Svc/*", "consumer", "c6", confidence=0.9),
        contract("a", "thrift::x.Dup/get", "provider", "p4"),
        contract("a", "thrift::y.Dup/get", "provider", "p5"),
        contract("b", "thrift::Dup/get", "consumer", "c7"),
        contract("b", "thrift::Dup/*", "consumer", "c8"),
    ]
    links = contracts.match(spark.createDataFrame(rows, CONTRACTS))
    got = sorted((r["from_symbol_uid"], r["to_symbol_uid"], r["match_type"], r["confidence"]) for r in links.collect())
    assert got == [("c1", "p1", "exact", 1.0), ("c2", "p1", "exact", 1.0), ("c5", "p2", "exact", 1.0), ("c6", "p3", "wildcard", 0.6)]
    left = contracts.unmatched(spark.createDataFrame(rows, CONTRACTS), links)
    assert ids(left, "symbol_uid") == ["c3", "c4", "c7", "c8", "p4", "p5"]


def test_contract_dedupe_and_endpoints(spark):
    rows = [contract("a", "http::GET::/x", "provider", "", confidence=0.9, seq=1, name=""), contract("a", "http::GET::/x", "provider", "u", confidence=0.5, seq=2)]
    got = contracts.dedupe_contracts(spark.createDataFrame(rows, CONTRACTS)).collect()
    assert len(got) == 1 and got[0]["symbol_uid"] == "u" and got[0]["confidence"] == 0.9
    t = spark.createDataFrame([contract("a", "x::1", "provider", "u1", file="f1", name="n1"), contract("a", "x::2", "provider", "u2", file="f2", name="n2"), contract("a", "x::3", "provider", "u3", file="f2", name="n3")], CONTRACTS)
    ends = spark.createDataFrame([("a", "provider", "u1", "?", "?"), ("a", "provider", "", "f2", "n3"), ("a", "provider", "", "f1", "zz"), ("a", "provider", "", "f2", "zz")], "repo string, role string, uid string, file_path string, name string")
    assert [r["node"] for r in contracts.resolve_endpoints(ends, t).orderBy("uid", "file_path", "name").collect()] == ["u1", "u3", None, "u1"]


@pytest.mark.parametrize(("raw", "want"), [("http::get::/A/", "http::GET::/A"), ("grpc::Pkg.Svc/Do", "grpc::pkg.svc/Do"), ("grpc::Pkg.Svc", "grpc::pkg.svc"), ("thrift::/x", "thrift::/x"), ("topic:: Orders ", "topic::orders"), ("lib::React", "lib::react"), ("include::./A//b.H", "include::a/b.h"), ("weird", "weird"), ("http::onlyone", "http::onlyone")])
def test_contract_ids(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(urls.normalize_contract_id("c").alias("n")).first()["n"] == want


# ---- URLs and predicates


@pytest.mark.parametrize(
    ("fetch", "route", "want"),
    [("/api/a", "/api/a", True), ("/api/a", "/api/b", False), ("/api/1", "/api/[id]", True), ("/api/[param]", "/api/x", True), ("/api/a/b", "/api/[...rest]", True), ("/api", "/api/[[...rest]]", True), ("/x", "/api/[...r]", False), ("/api/a", "/api", False)],
)
def test_route_matches(spark, fetch, route, want):
    df = spark.createDataFrame([(fetch, route)], "f string, r string")
    assert df.select(urls.route_matches(F.col("f"), F.col("r")).alias("m")).first()["m"] is want
    got = relational.first_route_match(df.select(F.col("f").alias("fetch")), df.selectExpr("r AS route", "0 AS seq"), urls.route_matches).count()
    assert got == int(want)


def test_urls(spark):
    one = lambda f, v: spark.createDataFrame([(v,)], "u string").select(f("u").alias("x")).first()["x"]
    assert one(urls.normalize_fetch_url, "/api/${id}/x.php?q=1") == "/api/[param]/x"
    assert one(urls.normalize_fetch_url, "/a" + "+b") is None and one(urls.normalize_fetch_url, "http://x/y") is None
    assert one(urls.normalize_http_path, "/A/:id/{x}/[y]/?z") == "/a/{param}/{param}/{param}" and one(urls.normalize_http_path, "/") == "/"
    assert one(urls.normalize_consumer_path, "https://h/api/orders/42/") == "/api/orders/{param}" and one(urls.normalize_consumer_path, "/u/${x}") == "/u/{param}"
    assert one(urls.nextjs_route, "app/(admin)/api/grants/route.ts") == "/api/grants" and one(urls.nextjs_route, "app/home/route.ts") is None and one(urls.nextjs_route, "pages/api/u/index.ts") == "/api/u"
    assert one(urls.expo_route, "app/(tabs)/index.tsx") == "/" and one(urls.expo_route, "app/users+api.ts") == "/users" and one(urls.expo_route, "app/_layout.tsx") is None
    assert one(urls.php_route, "api/up.php") == "/api/up" and one(urls.php_route, "api/db_config.php") is None


def test_predicates(spark):
    rows = [("src/a.test.ts",), ("src/test_x.py",), ("pkg/x_test.go",), ("src/a.ts",), ("A\\tests\\b.cs",)]
    got = [r["t"] for r in spark.createDataFrame(rows, "p string").select(predicates.is_test_path("p").alias("t")).collect()]
    assert got == [True, True, True, False, True]
    noisy = spark.createDataFrame([("http::GET::/{param}/{param}",), ("http::GET::/health/",), ("http::GET::/a",), ("grpc::x",)], "c string").select(predicates.is_noisy_contract("c", ["/health"], True).alias("n"))
    assert [r["n"] for r in noisy.collect()] == [True, True, False, False]
    under = spark.createDataFrame([("a/b",), ("a",), ("ab/c",)], "p string").select(predicates.under_prefix("p", "a").alias("u"))
    assert [r["u"] for r in under.collect()] == [True, True, False]
    frameworks = spark.createDataFrame([("src/pages/home.tsx",), ("cmd/main.go",), ("lib/x.py",), ("app/http/controllers/A.php",)], "p string").select(path_multiplier("p").alias("m"))
    assert [r["m"] for r in frameworks.collect()] == [3.0, 3.0, 1.0, 3.0]
    assert spark.range(1).select(ast_multiplier(F.lit("java"), F.lit("@GetMapping class")).alias("m")).first()["m"] == 3.2


# ---- text and embeddings


def test_text(spark):
    one = lambda c: spark.createDataFrame([("a\r\nb\x01\x7fc",)], "t string").select(c.alias("x")).first()["x"]
    assert one(text.sanitize("t")) == "a\nbc"
    assert one(text.is_binary(F.lit("\x01" * 200 + "x" * 800))) is True and one(text.is_binary(F.lit(""))) is False
    assert one(text.truncate(F.lit("x" * 12), 10)) == "x" * 10 + "\n... [truncated]"
    body = "\n".join(f"l{i}" for i in range(10))
    assert one(text.snippet(F.lit(body), F.lit(4), F.lit(5))) == "l2\nl3\nl4\nl5\nl6\nl7"
    assert one(text.clean_content(F.lit("a  \n\n\n\nb \n"))) == "a\n\nb"
    assert one(text.sanitize_id(F.lit("Handle Login/Now-and-then!"))) == "handle_login_now_and" and one(text.capitalize(F.lit("abc"))) == "Abc"


def test_chunks(spark):
    df = spark.createDataFrame([("x" * 2500,), ("short",), ("",)], "t string").withColumn("k", F.monotonically_increasing_id())
    rows = text.character_chunks(df, "t").orderBy("k", "chunk_index").collect()
    assert [(r["start_offset"], r["end_offset"]) for r in rows] == [(0, 1200), (1080, 2280), (2160, 2500), (0, 5), (0, 0)]
    nodes = spark.createDataFrame([("n", "aa\n\nbb\n\n" + "c" * 30)], "id string, content string")
    got = [r["chunk"] for r in embedding.declaration_chunks(nodes, size=10, overlap=2).orderBy("chunk_index").collect()]
    assert got[0] == "aa\n\nbb" and "".join(got[1:]).startswith("c" * 10)


def test_incremental_embeddings(spark, graph):
    inputs = embedding.embedding_inputs(graph)
    assert "Members: AuthService" in inputs.where("id = 'class:AuthService'").first()["text"]
    embed = search.hashing_embedder(8)
    stored = inputs.limit(0).select("id", "hash", embed("text").alias("embedding"))
    first = embedding.incremental_embeddings(inputs, stored, embed)
    assert first.count() == inputs.count()
    again = embedding.incremental_embeddings(inputs, first.withColumn("embedding", F.array(F.lit(9.0).cast("float"))), embed)
    assert again.where("embedding[0] = 9.0").count() == inputs.count()


# ---- analytics


def test_c3_and_mro(spark):
    assert analytics.c3({"D": ["B", "C"], "B": ["A"], "C": ["A"]}, "D") == ["B", "C", "A"]
    assert analytics.c3({"X": ["A", "B"], "Y": ["B", "A"], "Z": ["X", "Y"]}, "Z") is None
    assert analytics.c3({"A": ["B"], "B": ["A"]}, "A") is None
    h = spark.createDataFrame([("D", "B", "EXTENDS", 0), ("D", "C", "EXTENDS", 1), ("B", "A", "EXTENDS", 0), ("C", "A", "EXTENDS", 0)], "child string, parent string, kind string, seq int")
    mro = analytics.linearize(h)
    assert [r["ancestor"] for r in mro.where("child = 'D'").orderBy("pos").collect()] == ["B", "C", "A"]
    m = spark.createDataFrame([("B", "B.run", "run"), ("C", "C.run", "run"), ("A", "A.only", "only")], "owner string, id string, name string")
    assert [tuple(r)[:3] for r in analytics.mro_collisions(mro, m, h).collect()] == [("D", "run", "B.run")]
    assert analytics.mro_collisions(mro, m, h, "ruby-mixin").first()["winner"] == "C.run"
    assert analytics.mro_collisions(mro, m, h, "qualified-syntax").first()["winner"] is None
    iface = h.withColumn("kind", F.lit("IMPLEMENTS"))
    assert analytics.mro_collisions(mro, m, iface, "implements-split").where("class = 'D'").first()["winner"] is None
    sites = spark.createDataFrame([("s", "D", "only"), ("t", "B", "run")], "site string, owner string, name string")
    assert {r["site"]: r["method"] for r in analytics.lookup_with_mro(sites, mro, m).collect()} == {"s": "A.only", "t": "B.run"}


def test_c3_equals_python():
    rng = random.Random(3)
    agreed = 0
    for _ in range(300):
        parents, classes = {}, {}
        for k in range(7):
            bases = rng.sample(sorted(classes), min(len(classes), rng.randrange(3)))
            try:
                classes[f"K{k}"] = type(f"K{k}", tuple(classes[b] for b in bases), {})
                want = [c.__name__ for c in classes[f"K{k}"].__mro__[1:-1]]
                agreed += 1
            except TypeError:
                want = None
            assert analytics.c3({**parents, f"K{k}": bases}, f"K{k}") == want
            if want is not None:
                parents[f"K{k}"] = bases
    assert agreed > 1000


def test_method_implements(spark):
    mro = spark.createDataFrame([("Impl", 0, "Iface")], "child string, pos int, ancestor string")
    methods = spark.createDataFrame([("Impl", "i1", "run", ["int"], 1, False), ("Impl", "i2", "run", ["str"], 1, False), ("Iface", "f", "run", ["int"], 1, True)], "owner string, id string, name string, parameterTypes array<string>, parameterCount int, isAbstract boolean")
    got = analytics.method_implements(mro, methods, spark.createDataFrame([("Iface",)], "owner string"))
    assert [tuple(r) for r in got.collect()] == [("i1", "f", 1.0)]


def test_communities_two_cliques(spark):
    def clique(p):
        return [(f"{p}{i}", f"{p}{j}", "CALLS", 1.0) for i in range(5) for j in range(i)]

    e = spark.createDataFrame([*clique("a"), *clique("b"), ("a0", "b0", "CALLS", 1.0)], "src string, dst string, type string, confidence double")
    found = analytics.communities(e)
    got = {r["id"]: r["comm"] for r in found.collect()}
    assert len(got) == 10 and {got[f"a{i}"] for i in range(5)} == {"a0"} and {got[f"b{i}"] for i in range(5)} == {"b0"}
    assert got == {r["id"]: r["comm"] for r in analytics.communities(e).collect()}
    paths = spark.createDataFrame([(k, f"src/{'auth' if k[0] == 'a' else 'utils'}/x.ts", f"{'pay' if k[0] == 'b' else ''}{k}") for k in got], "id string, filePath string, name string")
    nodes = {r["comm"]: r for r in analytics.community_nodes(found, paths, e).collect()}
    assert nodes["a0"]["label"] == "Auth" and nodes["b0"]["label"] == "Payb" and nodes["a0"]["cohesion"] == pytest.approx(20 / 21)
    assert analytics.modularity(analytics.neighbours(e), found) > 0.3


def test_entry_points_and_processes(spark):
    nodes = spark.createDataFrame([("f1", "Function", "handleLogin", "src/a.ts", True), ("f2", "Function", "getUser", "src/a.ts", True), ("f3", "Function", "save", "src/b.ts", False), ("t", "Function", "handleX", "src/x.test.ts", True)], "id string, label string, name string, filePath string, isExported boolean")
    calls = spark.createDataFrame([("f1", "f2", "CALLS", 0.9), ("f2", "f3", "CALLS", 0.9), ("t", "f1", "CALLS", 0.9), ("f1", "f3", "CALLS", 0.3)], "src string, dst string, type string, confidence double")
    scores = {r["id"]: r["score"] for r in analytics.entry_points(nodes, calls).collect()}
    assert scores["f1"] == pytest.approx(2 / 2 * 2 * 1.5) and scores["f2"] == pytest.approx(1 / 2 * 2 * 0.3) and set(scores) == {"f1", "f2"}
    members = spark.createDataFrame([("f1", "c1"), ("f3", "c2")], "id string, comm string")
    flows, steps = analytics.processes(nodes, calls, members, 10)
    row = flows.first()
    assert (row["label"], row["processType"], row["stepCount"], row["communities"]) == ("HandleLogin → Save", "cross_community", 3, ["c1", "c2"])
    assert [(r["id"], r["step"]) for r in steps.orderBy("step").collect()] == [("f1", 1), ("f2", 2), ("f3", 3)]
    assert [analytics.max_processes(n) for n in (0, 205, 999_999)] == [20, 21, 300]


# ---- reports


def test_symbols_and_context(spark, graph):
    assert reports.resolve_symbol(graph.nodes, "login") == ("ok", ["func:login"])
    assert reports.resolve_symbol(graph.nodes, "AuthService")[1] == ["class:AuthService"]
    assert reports.resolve_symbol(graph.nodes, "nope")[0] == "not_found"
    row = reports.context(graph, frame(spark, ["func:login"])).first()
    assert row["outgoing"] == {"calls": ["func:hash", "func:validate"]} and row["incoming"]["calls"] == ["func:main", "func:test"] and row["processes"] == ["proc:login-flow"]


def test_detect_changes(spark, graph):
    hunks = spark.createDataFrame([("src/auth.ts", 14, 18), ("src/none.ts", 1, 99)], "filePath string, startLine long, endLine long")
    steps = graph.type("STEP_IN_PROCESS").selectExpr("src AS id", "dst AS process", "step")
    touched, affected, level = reports.detect_changes(hunks, graph.nodes, steps)
    assert ids(touched) == ["func:login", "func:validate"] and tuple(affected.first()) == ("proc:login-flow", 2, 1) and level.first()["risk"] == "medium"


def test_shape_check_seed(spark):
    routes = spark.createDataFrame([("r1", "/api/grants", ["data", "pagination"], ["error", "message"]), ("r2", "/api/secure", ["items", "count"], None)], "id string, name string, responseKeys array<string>, errorKeys array<string>")
    fetches = spark.createDataFrame([("r1", "GrantsList", "keys:data,pagination"), ("r1", "useGrants", "keys:items"), ("r1", "useMulti", "keys:data,meta,error fetches:2"), ("r2", "useMulti", "keys:items fetches:2")], "route string, consumer string, reason string")
    got = {(r["id"], r["consumer"]): (r["mismatched"], r["error_only"], r["confidence"]) for r in reports.shape_check(routes, fetches).collect()}
    assert got == {("r1", "GrantsList"): ([], [], "high"), ("r1", "useGrants"): (["items"], [], "high"), ("r1", "useMulti"): (["meta"], ["error"], "low"), ("r2", "useMulti"): ([], [], "low")}
    assert {r["id"]: r["risk"] for r in reports.api_impact(routes, fetches).collect()} == {"r1": "MEDIUM", "r2": "LOW"}


def test_wiki_calls_and_consistency(spark, graph):
    files = spark.createDataFrame([("src/auth.ts",)], "filePath string")
    out = reports.module_calls(graph, files)
    assert [r["to_name"] for r in out["outgoing"].collect()] == ["hash"] and out["intra"].count() == 0 and out["incoming"].count() == 3
    assert reports.consistency(graph, graph).count() == 0
    assert {r["what"] for r in reports.consistency(graph, structure.drop_derived(graph)).collect()} == {"label", "file", "edge"}


# ---- maintenance


def test_maintenance(spark, graph):
    paths = spark.createDataFrame([("src/auth.ts",)], "filePath string")
    left = structure.delete_files(graph, paths)
    assert "func:login" not in ids(left.nodes) and left.edges.where("src = 'func:login' OR dst = 'func:login'").count() == 0
    new = spark.createDataFrame([("func:hash", "NEW")], "id string, content string")
    assert structure.update_contents(graph, new).nodes.where("id = 'func:hash'").first()["content"] == "NEW"
    row = graph.nodes.where("id = 'func:hash'").withColumn("name", F.lit("renamed"))
    assert structure.insert_nodes(graph, row).nodes.where("id = 'func:hash'").first()["name"] == "hash"
    assert structure.upsert_nodes(graph, row).nodes.where("id = 'func:hash'").first()["name"] == "renamed"
    fit, dropped = structure.split_by_labels(graph.edges.select("src", "dst", "type"), ["func", "class"])
    assert fit.count() == 4 and fit.count() + dropped.count() == graph.edges.count()


def test_incremental(spark):
    diff = spark.createDataFrame([("a", "changed"), ("b", "unchanged"), ("c", "unchanged"), ("d", "deleted")], "path string, status string")
    imports = spark.createDataFrame([("b", "a"), ("c", "d")], "src string, dst string")
    paths, why = incremental.write_set(diff, imports)
    assert ids(paths, "path") == ["a", "b", "c"] and why == "ok"
    assert incremental.plan(diff) == ("incremental", "changed") and incremental.plan(diff, forced=True) == ("full", "forced") and incremental.plan(diff.where("status = 'unchanged'")) == ("none", "unchanged")
    deep = spark.createDataFrame([(f"f{i + 1}", f"f{i}") for i in range(6)], "src string, dst string")
    assert incremental.write_set(spark.createDataFrame([("f0", "changed")], "path string, status string"), deep)[0] is None
    many = spark.createDataFrame([(f"p{i}", "changed" if i < 15 else "unchanged") for i in range(30)], "path string, status string")
    assert incremental.write_set(many, imports)[0] is None
    changes = spark.createDataFrame([("a", "f(x)\ny", "f(x)\nz"), ("b", "f(x)", "g(x)"), ("c", "a", "a\nb")], "path string, old string, new string")
    assert [r["reason"] for r in incremental.body_only(changes).orderBy("path").collect()] == [None, "calls", "line-count"]
    overlays = spark.createDataFrame([("a", "h1", "new"), ("b", "old", "new")], "path string, hash string, content string")
    hashes = spark.createDataFrame([("a", "h1"), ("b", "h2")], "path string, hash string")
    files = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    assert sorted((r["path"], r["content"]) for r in incremental.apply_overlays(files, incremental.fresh_overlays(overlays, hashes)).collect()) == [("a", "new"), ("b", "y")]
    assert incremental.rebuild_equals(files, files) and not incremental.rebuild_equals(files, files.unionAll(files))


# ---- resolution


def test_tiered_resolution(spark):
    defs = spark.createDataFrame([("d1", "a.ts", "foo", "Function", None, 1, 2, "int"), ("d2", "b.ts", "bar", "Function", None, 0, 0, None), ("d3", "c.ts", "baz", "Function", None, 0, 1, None), ("d4", "z.ts", "lone", "Function", None, 0, 1, None)], "id string, file string, name string, kind string, owner string, required int, total int, return_type string")
    imports = spark.createDataFrame([("a.ts", "index.ts", "bar", "bar"), ("index.ts", "b.ts", "bar", "bar"), ("a.ts", "c.ts", "ns", "*")], "file string, source string, local string, exported string")
    sites = spark.createDataFrame([("s1", "a.ts", "foo", "free", 1), ("s2", "a.ts", "bar", "free", 0), ("s3", "a.ts", "baz", "free", 0), ("s4", "a.ts", "lone", "free", 0), ("s5", "a.ts", "none", "free", 0)], "site string, file string, name string, form string, arg_count int")
    got = {r["site"]: (r["id"], r["tier"], r["confidence"]) for r in resolution.resolve_tiers(sites, defs, imports).collect()}
    assert got == {"s1": ("d1", "same-file", 0.95), "s2": ("d2", "import-scoped", 0.9), "s3": ("d3", "import-scoped", 0.9), "s4": ("d4", "global", 0.5)}
    many = spark.createDataFrame([("s1", "d1"), ("s1", "d2")], "site string, id string")
    assert [r["id"] for r in resolution.narrow_overloads(many, defs, sites).collect()] == ["d1"]


def test_suffix_imports_and_scopes(spark):
    files = spark.createDataFrame([("src/a/util.ts",), ("src/util/index.ts",), ("src/main.ts",)], "path string")
    imports = spark.createDataFrame([("src/main.ts", "./a/util"), ("src/main.ts", "./util"), ("src/main.ts", "./nope")], "file string, spec string")
    got = {r["spec"]: r["target"] for r in resolution.suffix_imports(imports, files, ["", ".ts", "/index.ts"]).collect()}
    assert got == {"./a/util": "src/a/util.ts", "./util": "src/a/util.ts"}
    scopes = spark.createDataFrame([("inner", "outer"), ("outer", None)], "scope string, parent string")
    bindings = spark.createDataFrame([("outer", "x", "x0"), ("inner", "y", "y1"), ("outer", "y", "y0")], "scope string, name string, id string")
    sites = spark.createDataFrame([("s1", "inner", "x"), ("s2", "inner", "y"), ("s3", "inner", "z")], "site string, scope string, name string")
    assert {r["site"]: (r["id"], r["hops"]) for r in resolution.scope_lookup(sites, scopes, bindings).collect()} == {"s1": ("x0", 1), "s2": ("y1", 0)}


def test_evidence_and_ties(spark):
    e = lambda *a: spark.range(1).select(F.round(resolution.evidence(*[F.lit(x).cast(t) for x, t in zip(a, ("string", "int", "int", "boolean", "boolean", "boolean"))]), 4).alias("e")).first()["e"]
    assert e("local", 2, None, False, True, True) == 0.61 and e("import", 0, 0, True, True, True) == 1.0 and e("wildcard", 0, None, False, None, False) == 0.15
    c = spark.createDataFrame([("s", "b", 0.9, 0, 0, "import"), ("s", "a", 0.9, 0, 0, "import"), ("s", "c", 0.9004, 0, 0, "wildcard")], "site string, id string, confidence double, scope_depth int, mro_depth int, origin string")
    assert resolution.tie_break(c).first()["id"] == "a"


def test_dispatch_and_passes(spark):
    methods = spark.createDataFrame([("i.run", "I", "run"), ("a.run", "A", "run"), ("b.run", "B", "run")], "id string, owner string, name string")
    heritage = spark.createDataFrame([("A", "I", "IMPLEMENTS"), ("B", "I", "EXTENDS")], "child string, parent string, kind string")
    calls = spark.createDataFrame([("s", "i.run")], "site string, id string")
    assert [tuple(r) for r in resolution.interface_dispatch(calls, methods, heritage).collect()] == [("s", "a.run", 0.7)]
    sites = spark.createDataFrame([("s", "m"), ("t", "m")], "site string, caller string")
    one = spark.createDataFrame([("s", "x", 0.9)], "site string, id string, confidence double")
    two = spark.createDataFrame([("s", "y", 0.5), ("t", "z", 0.5)], "site string, id string, confidence double")
    assert sorted((r["dst"], r["pass"]) for r in resolution.call_edges(sites, [one, two]).collect()) == [("x", 0), ("z", 1)]
