"""Sources, sinks, front ends and streaming."""

import os
import time

import pytest

from codeloom.functions import extract
from codeloom.model import Graph
from codeloom.plans import sql, views
from codeloom.sources import parsers, repo, sinks
from codeloom.streaming import events


def write(root, files):
    for name, content in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())


def test_scan_and_contents(spark, tmp_path):
    write(str(tmp_path), {"src/a.py": "x = 1\n", "src/logo.png": b"\x89", "node_modules/x/i.js": "no", "docs/big.md": "y" * 700_000, "gen/out.ts": "t", "gen/keep.ts": "t", "Rakefile": "r", "src/bad.py": b"\xff\xfe\x00"})
    got = sorted(r["path"] for r in repo.scan(spark, str(tmp_path), ["gen/*", "!gen/keep.ts"]).collect())
    assert got == ["Rakefile", "gen/keep.ts", "src/a.py", "src/bad.py"]
    rows = {r["path"]: r for r in repo.contents(spark, str(tmp_path)).collect()}
    assert rows["src/a.py"]["content"] == "x = 1\n" and rows["src/a.py"]["language"] == "python" and rows["Rakefile"]["language"] == "ruby" and "src/bad.py" not in rows
    assert [repo.max_file_bytes(v) for v in (None, "x", 10, 10**9, -1)] == [524288, 524288, 10240, 32 << 20, 524288]


DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x.ts\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +12 @@\n@@ -20,3 +30,0 @@\n+++ b/y.ts\n@@ -1 +1,2 @@ fn"


def test_diff_hunks(spark):
    lines = repo.diff_lines(spark.createDataFrame([(1, DIFF), (2, "")], "diff_id int, text string"))
    got = [(r["filePath"], r["startLine"], r["endLine"]) for r in repo.diff_hunks(lines).orderBy("filePath", "startLine").collect()]
    assert got == [("x.ts", 3, 6), ("x.ts", 12, 12), ("y.ts", 1, 2)]


def test_markdown(spark):
    text = "# A\r\ntext\n## B\n```\n# no\n```\n### C\n# D #\nsee [x](./sub/y.md#a) and [z](../out.md) [w](http://h/q.md)"
    files = spark.createDataFrame([("docs/i.md", text), ("docs/sub/y.md", ""), ("out.md", "none")], "path string, content string")
    got = [(r["title"], r["level"], r["startLine"], r["endLine"], r["parentLine"]) for r in repo.markdown_sections(files).orderBy("startLine").collect()]
    assert got == [("A", 1, 1, 7, None), ("B", 2, 3, 7, 1), ("C", 3, 7, 7, 3), ("D", 1, 8, 9, None)]
    assert sorted(map(tuple, repo.markdown_links(files).collect())) == [("docs/i.md", "docs/sub/y.md"), ("docs/i.md", "out.md")]


def test_python_parser(spark):
    source = "import os.path as p\nfrom .m import f as g\nclass A(B, c.D):\n    def run(self, x) -> int:\n        return self.go(g(x))\nX = 1\n"
    rows = parsers.parse_python(spark.createDataFrame([("a.py", source), ("bad.py", "def ("), ("none.py", None)], "path string, content string")).collect()
    facts = {(r["kind"], r["name"], r["owner"]) for r in rows if r["path"] == "a.py"}
    assert {("Class", "A", None), ("Method", "run", "A"), ("heritage", "B", "A"), ("heritage", "c.D", "A"), ("import", "os.path", "p"), ("import", ".m", "g"), ("call", "self.go", "A.run"), ("call", "g", "A.run"), ("Variable", "X", None)} <= facts
    assert [r["kind"] for r in rows if r["path"] == "bad.py"] == ["error"]


def test_cobol_and_jcl(spark):
    source = "\n".join(
        [
            "000100 IDENTIFICATION DIVISION.",
            "000200 PROGRAM-ID. PAYROLL.",
            "000300 DATA DIVISION.",
            "000400 WORKING-STORAGE SECTION.",
            "000500 01  WS-TOTAL PIC 9(5).",
            "000600 COPY RATES.",
            "000700 PROCEDURE DIVISION.",
            "000800 MAIN-PARA.",
            "000900     PERFORM CALC-PARA THRU END-PARA",
            "001000     CALL 'TAXMOD' USING WS-TOTAL.",
            "001100* CALL 'COMMENT'",
            "001200 CALC-PARA.",
            "001300     EXEC SQL SELECT 1 END-EXEC.",
        ]
    )
    files = spark.createDataFrame([("p.cbl", source)], "path string, content string")
    books = spark.createDataFrame([("RATES", "000100 01  RATE-A PIC 9.")], "name string, content string")
    facts = {(r["kind"], r["name"], r["owner"], r["detail"]) for r in parsers.parse_cobol(files).collect()}
    assert {("Module", "PAYROLL", None, None), ("Function", "MAIN-PARA", "PAYROLL", None), ("perform", "CALC-PARA", "MAIN-PARA", "END-PARA"), ("call", "TAXMOD", "MAIN-PARA", None), ("copy", "RATES", "WORKING-STORAGE", None), ("exec", "SQL", "CALC-PARA", "SELECT"), ("Property", "WS-TOTAL", "PAYROLL", "9(5)")} <= facts
    assert not any(f[1] == "COMMENT" for f in facts)
    assert parsers.parse_cobol(files, books).count() > 0
    assert parsers.expand_copies("COPY A.", {"A": "COPY B. x", "B": "COPY A. y"}) == "COPY A. y x"
    assert parsers.expand_copies("COPY A REPLACING ==X== BY ==Z==.", {"A": "X XY"}) == "Z XY"
    jcl = "//JOB1 JOB (A)\n//* note\n//S1 EXEC PGM=PAYROLL\n//IN DD DSN=A.B,\n//   DISP=SHR\n//S2 EXEC MYPROC\n"
    got = [(r["kind"], r["name"], r["owner"], r["detail"]) for r in parsers.parse_jcl(spark.createDataFrame([("j", jcl)], "path string, content string")).collect()]
    assert got == [("job", "JOB1", None, None), ("step", "S1", "JOB1", "PAYROLL"), ("dataset", "A.B", "S1", "SHR"), ("step", "S2", "JOB1", "MYPROC")]


def test_extractors(spark):
    def files(**named):
        return spark.createDataFrame([(k.replace("__", "."), v) for k, v in named.items()], "path string, content string")

    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(extract.orm_queries(files(a__ts="x\nawait prisma.user.findMany({})\nsupabase.from('posts').select('*')"))) == [("a.ts", 2, "prisma", "user", "findMany"), ("a.ts", 3, "supabase", "posts", "select")]
    assert rows(extract.code_routes(files(a__js="app.get('/x', h)\n@app.route('/py')\n@GetMapping(\"/j\")"))) == [("a.js", 1, "GET", "/x"), ("a.js", 2, "ROUTE", "/py"), ("a.js", 3, "GET", "/j")]
    assert rows(extract.grpc_contracts(files(a__proto="package p.q;\nservice Svc {\n rpc Do (A) returns (B);\n}\nservice T { rpc X (A) returns (B); }"))) == [("a.proto", "grpc::p.q.svc/Do"), ("a.proto", "grpc::p.q.t/X")]
    assert rows(extract.thrift_contracts(files(a__thrift="namespace java com.acme\nservice User {\n  string get(1: i32 id)\n}"))) == [("a.thrift", "thrift::com.acme.user/get")]
    assert rows(extract.topic_contracts(files(a__ts="bus.publish('Orders', x); c.subscribe('orders')"))) == [("a.ts", "consumer", "topic::orders"), ("a.ts", "provider", "topic::orders")]
    assert rows(extract.include_contracts(spark.createDataFrame([("src/a.cpp", '#include "lib/x.h"\n#include "b.h"\n#include <vector>'), ("src/b.h", "")], "path string, content string"))) == [("src/a.cpp", "include::lib/x.h")]
    tree = spark.createDataFrame([("svc/auth/package.json",), ("svc/auth/Dockerfile",), ("svc/auth/src/a.ts",), ("svc/empty/go.mod",)], "path string")
    assert rows(extract.service_boundaries(tree)) == [("svc/auth", 2, 0.9)]
    deps = files(package__json='{"name": "web", "dependencies": {"react": "1", "@x/y": "2"}}')
    assert {r["dependency"] for r in extract.workspace_dependencies(deps).collect()} == {"react", "@x/y"}
    one = files(a__ts="const { data, meta: m } = await res.json(); data.items.map(x); return Response.json({ ok, total: 3 })")
    assert one.select(extract.consumer_keys("content")).first()[0] == ["data", "meta", "items"] and one.select(extract.json_keys("content")).first()[0] == ["ok", "total"]
    vue = files(a__vue="<template><MyCard/><my-item></my-item><div/></template><script setup>let a</script>")
    assert vue.select(extract.vue_components("content")).first()[0] == ["MyCard", "my-item"] and vue.select(extract.vue_script("content")).first()[0] == "let a"
    chain = files(a__ts="export const GET = withAuth(withLog(handler))")
    assert chain.select(extract.middleware_chain("content")).first()[0] == ["withAuth", "withLog"]
    tools = files(t__ts="{ name: 'query', description: `Find things`, inputSchema: {} }")
    assert rows(extract.tool_definitions(tools)) == [("t.ts", "query", "Find things")]


@pytest.fixture(scope="module")
def graph(spark):
    n = spark.createDataFrame([("f:login", "Function", "login", "src/auth.ts"), ("f:validate", "Function", "validate", "src/auth.ts"), ("f:hash", "Function", "hash", "src/utils.ts"), ("c:A", "Class", "A", "src/auth.ts"), ("m:auth", "Community", "auth", "")], "id string, label string, name string, filePath string")
    e = spark.createDataFrame([("f:login", "f:validate", "CALLS", 1.0, "direct", None), ("f:login", "f:hash", "CALLS", 0.9, "import", None), ("f:login", "m:auth", "MEMBER_OF", 1.0, "", None)], "src string, dst string, type string, confidence double, reason string, step int")
    return Graph(n, e)


def test_sinks(spark, graph, tmp_path):
    assert sinks.bulk_load(graph, ["f", "Function", "Class"], str(tmp_path / "g")) == {"inserted": 2, "skipped": 1}
    sinks.write_graph(graph, str(tmp_path / "h"))
    back = sinks.read_graph(spark, str(tmp_path / "h"))
    assert back.nodes.count() == 5 and back.edges.where("type = 'CALLS'").count() == 2
    assert sinks.ndjson(graph).count() == 8
    write(str(tmp_path), {"r/x.json": '{"repo":"a","contractId":"http::GET::/x","meta":{"k":"v"}}\n{broken\n{"repo":"b"}\n'})
    good, bad = sinks.read_registry(spark, str(tmp_path / "r"))
    assert [r["contractId"] for r in good.collect()] == ["http::GET::/x"] and bad.count() == 2
    config = sinks.parse_group_config("name: shop\nrepos:\n  app/web: web\n  app/api: api\nlinks:\n  - from: app/web\n    to: app/api\n  - from: x\nmatching:\n  exclude_links_paths: [/health, /ping]\ndetect:\n  http: false\n")
    assert config["repos"] == {"app/web": "web", "app/api": "api"} and config["links"][0] == {"from": "app/web", "to": "app/api"} and config["matching"]["exclude_links_paths"] == ["/health", "/ping"] and config["detect"]["http"] is False and config["detect"]["grpc"] is True


CYPHER = [
    ("MATCH (a:Function)-[r:CodeRelation {type:'CALLS'}]->(b) WHERE r.confidence >= 0.95 RETURN a.name AS x, b.name AS y", [("login", "validate")]),
    ("MATCH (n) RETURN labels(n)[0] AS l, count(*) AS n ORDER BY n DESC, l", [("Function", 3), ("Class", 1), ("Community", 1)]),
    ("MATCH (b:Function)<-[r:CALLS]-(a) RETURN b.name, count(DISTINCT a.id) AS callers ORDER BY b.name LIMIT 1", [("hash", 1)]),
    ("MATCH (f:Function) OPTIONAL MATCH (f)-[r:MEMBER_OF]->(c:Community) RETURN f.name AS f, c.name AS c ORDER BY f", [("hash", None), ("login", "auth"), ("validate", None)]),
    ("MATCH (a)-[:CALLS]->(b) WITH a, count(b) AS n WHERE n > 1 MATCH (a)-[:MEMBER_OF]->(c) RETURN a.name AS a, n, c.name AS c", [("login", 2, "auth")]),
    ("MATCH (n:Function) WHERE n.name IN $names AND n.filePath ENDS WITH 'auth.ts' RETURN n.name AS n UNION ALL MATCH (c:Class) RETURN c.name AS n", [("A",), ("login",)]),
    ("MATCH (a)-[:CALLS]->(b), (a)-[:MEMBER_OF]->(c) RETURN c.id AS c, min(b.name) AS b", [("m:auth", "hash")]),
    ("MATCH (n:CREATE) RETURN n.id AS i", []),
    ("MATCH ()-[r]->() WHERE r.type <> 'MEMBER_OF' AND NOT r.reason IS NULL RETURN count(r) AS n", [(2,)]),
]


@pytest.mark.parametrize(("text", "want"), CYPHER)
def test_cypher(graph, text, want):
    assert sorted(map(tuple, sql.cypher(graph, text, {"names": ["login", "hash"]}).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["CREATE (n:X)", "MATCH (n) DELETE n", "MATCH (n) SET n.a = 1 RETURN n.id", "MATCH (a)-[*1..3]->(b) RETURN a.id", "MATCH (a), (b) RETURN a.id", "RETURN nonsense("])
def test_cypher_refuses(graph, text):
    with pytest.raises(sql.QueryError):
        sql.cypher(graph, text)


def test_sql_guard(spark, graph):
    assert sql.sql(spark, graph, "SELECT count(*) AS n FROM edges WHERE type = :t", {"t": "CALLS"}).first()["n"] == 2
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "  create view v as select 1"):
        with pytest.raises(sql.QueryError):
            sql.sql(spark, graph, bad)
    assert not sql.is_write_query("MATCH (n) WHERE n.name = 'DROP it' RETURN n")


def test_views(spark, graph, tmp_path):
    table, n = views.markdown_table(graph.nodes.select("id", "name").orderBy("id"))
    assert n == 5 and table.splitlines()[0] == "| id | name |" and "| f:login | login |" in table
    views.register(spark, [("1", "web", "/w", "git@x", "c1", "c2", 3, None)], str(tmp_path / "reg"))
    views.register(spark, [("2", "api", "/a", "git@x", "c1", "c1", 0, None)], str(tmp_path / "reg"))
    repos = spark.read.parquet(str(tmp_path / "reg"))
    assert views.resolve_repo(repos, "web") == "1" and views.resolve_repo(repos, "AP") == "2"
    with pytest.raises(LookupError):
        views.resolve_repo(repos, None)
    assert {r["id"]: r["stale"] for r in views.staleness(repos).collect()} == {"1": True, "2": False}
    assert views.resource(graph, "stats").count() == 5


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    folder = str(tmp_path / "in")
    batch.repartition(3).write.parquet(folder)
    progress = events.Progress()
    spark.streams.addListener(progress)
    try:
        stream = events.session_windows(events.stream(spark, folder, files_per_trigger=10), late="3650 days")
        q = stream.writeStream.outputMode("complete").format("memory").queryName("sessions_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = spark.sql("SELECT count(*) AS n, sum(n) AS e FROM sessions_out").first()
        assert got["e"] == batch.count() and got["n"] > 1
        out = str(tmp_path / "out")
        q = events.upsert_sink(events.distinct_events(events.stream(spark, folder), late="3650 days"), out, str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.read.parquet(out).count() == batch.count()
        for _ in range(50):
            if progress.batches:
                break
            time.sleep(0.1)
        assert progress.batches
    finally:
        spark.streams.removeListener(progress)
