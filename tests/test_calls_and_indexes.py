"""Call resolution by types, indexes, build state, and operators that run to their fixpoint."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions.urls import route_matches
from codeloom.operators import analytics, calls, embedding, relational, reports, resolution, search, traverse, vector_index
from codeloom.sources import parsers, state
from codeloom.sources.brace_parsers import brace_facts


def test_receiver_calls(spark):
    facts = spark.createDataFrame([("a.ts", "f", "x", "Dog", "construction"), ("a.ts", "f", "x", "Cat", "annotation"), ("a.ts", None, "y", "Dog", "construction"), ("b.ts", "g", "z", None, "return")], "file string, scope string, name string, type string, origin string")
    env = calls.type_environment(facts, spark.createDataFrame([("a.ts", "f", "w", "x")], "file string, scope string, name string, source string"))
    assert {(r["scope"], r["name"]): r["type"] for r in env.collect()} == {("f", "x"): "Cat", (None, "y"): "Dog", ("f", "w"): "Cat"}
    sites = spark.createDataFrame([(1, "a.ts", "f", "x", "purr"), (2, "a.ts", "f", "y", "run"), (3, "a.ts", "f", "w", "run"), (4, "a.ts", "f", "q", "run"), (5, "b.ts", "g", "y", "run")], "site int, file string, scope string, receiver string, name string").withColumn("arg_count", F.lit(None).cast("int"))
    classes = spark.createDataFrame([("Cat", "c"), ("Dog", "d"), ("Twin", "t1"), ("Twin", "t2")], "name string, id string")
    methods = spark.createDataFrame([("c", "purr", "c.purr"), ("animal", "run", "animal.run"), ("d", "run", "d.run")], "owner string, name string, id string")
    mro = spark.createDataFrame([("c", 0, "animal"), ("d", 0, "animal")], "child string, pos int, ancestor string")
    got = calls.receiver_calls(sites, env, classes, methods, mro).collect()
    assert {r["site"]: r["id"] for r in got} == {1: "c.purr", 2: "d.run", 3: "animal.run"}
    defs = spark.createDataFrame([("one", "helper", "Function"), ("two", "both", "Function"), ("three", "both", "Function"), ("four", "field", "Property")], "id string, name string, kind string")
    free = spark.createDataFrame([(7, "helper", None), (8, "both", None), (9, "helper", "x"), (10, "field", None)], "site int, name string, receiver string")
    assert [tuple(r) for r in calls.free_call_fallback(free, free.limit(0), defs).collect()] == [(7, "one", 0.5)]


def test_vector_index(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(i % 4, 0.3) * (1 if d % 4 == i % 4 else 0.2) for d in range(8)]) for i in range(400)] + [(1000, None), (1001, [1.0, 2.0]), (1002, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = vector_index.build(vectors, "vec_id", cells=8)
    assert index.rows.count() == len(rows) and {r["vec_id"] for r in index.rows.where("cell = -1").collect()} == {1000, 1001}
    queries = {i: rows[i][1] for i in range(0, 400, 50)}
    exact = search.vector_topk(vectors, queries[50], 5, "vec_id", max_distance=2.5).select("vec_id").collect()
    assert index.search(queries[50], 5, None).select("vec_id").collect() == exact
    asked = spark.createDataFrame([*queries.items(), (999, [1.0])], "query long, vector array<float>")
    probes = vector_index.enough_probes(index, asked)
    assert vector_index.recall(index, asked, probes=probes) >= 0.9 and vector_index.recall(index, asked, probes=8) == 1.0
    every = index.search_all(asked, 5, None).where("query = 50").orderBy("rank").select(F.col("key").alias("vec_id")).collect()
    assert every == exact
    assert "cell" in index.search(queries[50], 5, 1)._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert vector_index.build(vectors.limit(0), "vec_id").search([1.0], 3).count() == 0


def test_text_index_is_made_and_dropped(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, None)], "doc_id long, text string")
    search.drop_index(spark, "codeloom_fts")
    index = search.create_index(docs, "codeloom_fts")
    try:
        with pytest.raises(ValueError):
            search.create_index(docs, "codeloom_fts")
        assert [r["doc_id"] for r in search.bm25_index(index, ["cat"]).collect()] == [1]
    finally:
        assert search.drop_index(spark, "codeloom_fts")
    assert not search.drop_index(spark, "codeloom_fts") and search.open_index(spark, "codeloom_fts") is None


def test_build_state(spark, tmp_path):
    path = str(tmp_path)
    assert not state.is_dirty(spark, path)
    state.mark_dirty(spark, path)
    assert state.is_dirty(spark, path)
    state.clear_dirty(spark, path)
    assert not state.is_dirty(spark, path)
    made = []

    def make(rows):
        made.append(rows.count())
        return rows.withColumn("out", F.upper("hash"))

    for rows in ([("a", "x"), ("b", "y")], [("a", "x"), ("b", "z"), ("c", "w")], [("c", "w")]):
        out = state.finalized(spark.createDataFrame(rows, "key string, hash string"), f"{path}/cache", make)
        assert sorted((r["key"], r["out"]) for r in out.collect()) == [(k, h.upper()) for k, h in rows]
    assert made == [2, 2, 0]


def test_far_ancestors_types_and_scopes(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}", 0) for i in range(40)], "child string, parent string, seq int")
    assert traverse.ancestors(chain).where("child = 'c0'").count() == 40
    assert analytics.linearize(chain).where("child = 'c0'").count() == 40
    links = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(40)], "name string, source string")
    assert resolution.propagate_types(spark.createDataFrame([("v40", "T")], "name string, type string"), links).where("name = 'v0'").first()["type"] == "T"
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "scope string, parent string")
    with pytest.raises(RuntimeError):
        resolution.scope_lookup(spark.createDataFrame([(1, "a", "x")], "site int, scope string, name string"), ring, spark.createDataFrame([], "scope string, name string, id string"), max_depth=3)


def test_nothing_is_left_out_in_silence(spark):
    files = spark.createDataFrame([("a.cbl", "       COPY X.")], "path string, content string")
    with pytest.raises(ValueError):
        parsers.parse_cobol(files, spark.createDataFrame([("X", "y" * 100)], "name string, content string"), max_copybook_bytes=10)
    body = "class A { m(a) { if (x) { for (y) { while (z) { if (w) { q } } } } } n(): T { r } }"
    assert spark.createDataFrame([(body,)], "t string").select(embedding.declarations_only("t")).first()[0] == "class A { m(a) { … } n(a) { … } }".replace("n(a)", "n()")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    assert {r["id"] for r in analytics.communities(edges).collect()} == {"a", "b", "c", "d"}


def test_contained_paths_and_routes(spark):
    paths = spark.createDataFrame([(["a", "b", "c"],), (["b", "c"],), (["a", "c"],), (["c"],), (["x"],), (["a", "b", "c"],)], "path array<string>")
    assert sorted(r["path"] for r in traverse.drop_contained(paths).collect()) == [["a", "b", "c"], ["a", "c"], ["x"]]
    rng = random.Random(5)
    segment = lambda: rng.choice(["a", "b", "[id]", "[x]"])
    urls = ["/" + "/".join(segment() for _ in range(rng.randrange(4))) for _ in range(60)]
    known = sorted({"/" + "/".join([segment() for _ in range(rng.randrange(4))] + rng.choice([[], ["[...rest]"], ["[[...all]]"]])) for _ in range(40)})
    fetches, routes = spark.createDataFrame([(u,) for u in urls], "fetch string"), spark.createDataFrame([(r, i % 7) for i, r in enumerate(known)], "route string, seq int")
    every = fetches.distinct().crossJoin(routes).where(route_matches(F.col("fetch"), F.col("route"))).collect()
    want = {}
    for r in every:
        want[r["fetch"]] = min(want.get(r["fetch"], (99, "")), (r["seq"], r["route"]))
    got = {r["fetch"]: (r["seq"], r["route"]) for r in relational.first_route_match(fetches, routes, route_matches).collect()}
    assert got == want and got


def test_siblings_without_pairs(spark):
    repos = spark.createDataFrame([("/a", "u"), ("/b", "u"), ("/c", "v"), ("/d", None)], "path string, remoteUrl string")
    assert {r["path"]: r["siblings"] for r in reports.list_repos(repos).collect()} == {"/a": ["/b"], "/b": ["/a"], "/c": None, "/d": None}


TS = """import { a as b, type C } from './x';
import D, * as E from "y";
// class Ghost {}
export abstract class Dog<T> extends Animal<T> implements Pet, Loud {
  constructor(name: string, private m: Map<string, number>) { super(name); }
  async bark(n: number): Promise<void> {
    if (n > 0) { this.say(n, "x(1)"); }
  }
}
interface Pet { feed(x: Food): void; }
const arrow = async (x) => { helper(x); };
"""


def test_typescript_and_java_facts():
    facts = [f[:3] + f[5:] for f in brace_facts(TS, "typescript")]
    assert [f[1:4] for f in facts if f[0] == "import"] == [("./x", "b", "a"), ("./x", "C", "C"), ("y", "D", "default"), ("y", "E", "*")]
    assert [f[1:3] for f in facts if f[0] == "heritage"] == [("Animal", "Dog"), ("Pet", "Dog"), ("Loud", "Dog")]
    assert [(f[0], f[1], f[2], f[4]) for f in facts if f[0] in ("Constructor", "Method", "Function")] == [("Constructor", "constructor", "Dog", 2), ("Method", "bark", "Dog", 1), ("Method", "feed", "Pet", 1), ("Function", "arrow", None, 1)]
    assert [(f[1], f[2], f[3], f[4]) for f in facts if f[0] == "call"] == [("this.say", "Dog.bark", "member", 2), ("helper", "arrow", "free", 1)]
    java = brace_facts("class A<T> extends B<T> {\n @X(1)\n public A(int a) { super(a); }\n List<T> run(Map<K, V> m) throws E { return this.go(m, new C()); }\n abstract void none();\n}", "java")
    assert [(f[0], f[1], f[2]) for f in java if f[0] != "call"] == [("Class", "A", None), ("heritage", "B", "A"), ("Constructor", "A", "A"), ("Method", "run", "A"), ("Method", "none", "A")]
    assert [(f[1], f[5]) for f in java if f[0] == "call"] == [("this.go", "member"), ("C", "constructor")]
    assert brace_facts("", "java") == [] and brace_facts("class {", "typescript") == []
    assert len(brace_facts("class A {" * 200, "java")) > 0


MORE = """function k(cb: (x: number) => void, m: Map<string, number>): { a: number } { cb(1, f(2, 3)); return `x ${h(1)} ${`in ${g({a: 1})}`}`; }
const q = x => z(x);
const r = async (a, b = d()): Promise<void> => { w(); };
class C {
  handle = (e: Event): void => { this.run(e); };
  run(cb: (x: number) => void = () => {}, ...rest: [number, string][]): Promise<{ ok: boolean }> {
    return go(a, (b) => { deep(b, `y(1)`); });
  }
  last(a: string,): void { end(
    1); }
}
interface P { area(): number; named?(a: string): void }
function tail() {}
"""


def test_callbacks_templates_and_short_arrows():
    facts = brace_facts(MORE, "typescript")
    declared = [(f[0], f[1], f[2], f[3], f[4], f[5], f[6]) for f in facts if f[0] in ("Function", "Method")]
    assert declared == [
        ("Function", "k", None, 1, 1, "{ a: number }", 2), ("Function", "q", None, 2, 2, None, 1), ("Function", "r", None, 3, 3, "Promise<void>", 2), ("Method", "handle", "C", 5, 5, "void", 1),
        ("Method", "run", "C", 6, 8, "Promise<{ ok: boolean }>", 2), ("Method", "last", "C", 9, 10, "void", 1), ("Method", "area", "P", 12, 12, "number", 0), ("Method", "named", "P", 12, 12, "void", 1), ("Function", "tail", None, 13, 13, None, 0),
    ]
    calls = [(f[1], f[2], f[6]) for f in facts if f[0] == "call"]
    assert calls == [("cb", "k", 2), ("f", "k", 2), ("h", "k", 1), ("g", "k", 1), ("z", "q", 1), ("d", "r", 0), ("w", "r", 0), ("this.run", "C.handle", 1), ("go", "C.run", 2), ("deep", "C.run", 2), ("end", "C.last", 1)]


def test_files_are_read_in_time_linear_in_their_length():
    import time

    method = "  m{0}(a: number, cb: (x: number) => void): void {{ this.x{0}(a); }}\n"
    shapes = {
        "methods": lambda n: "class A {\n" + "".join(method.format(i) for i in range(n)) + "}", "calls": lambda n: "f(" * n + ")" * n, "open": lambda n: "class A { m() { " * n,
        "arrows": lambda n: "const a = (b) => " * n, "templates": lambda n: "`${" * n + "}`" * n, "generics": lambda n: "a<b," * n, "quotes": lambda n: "x = '" * n, "types": lambda n: "f(): (" * n,
    }
    for name, shape in shapes.items():
        took = []
        for n in (2_500, 10_000):
            began = time.perf_counter()
            brace_facts(shape(n), "typescript")
            brace_facts(shape(n), "java")
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.5, (name, took)
    facts = brace_facts(shapes["methods"](10_000), "typescript")
    assert sum(f[0] == "Method" for f in facts) == 10_000 == sum(f[0] == "call" for f in facts)


def test_vector_index_blocks(spark, monkeypatch):
    """Blocks, slices and files smaller than the data change nothing; ties of rounded distances go by the key; recall agrees with real searches."""
    monkeypatch.setattr(vector_index, "BLOCK_ROWS", 20)
    monkeypatch.setattr(vector_index, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(vector_index, "FILE_ROWS", 10)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    rows += [(100 + i, [x * (1 + 1e-9 * (30 - i)) for x in rows[0][1][:-1]] + [rows[0][1][-1]]) for i in range(30)]
    rows += [(200, None), (201, [1.0, 2.0]), (202, [0.0] * 6), (203, []), (204, [None, 1.0, 0.0, 0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(vectors, "vec_id", cells=6)
    asked = vectors.where("vec_id % 9 = 0 OR vec_id > 200").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    pairs = vectors.crossJoin(asked).select("query", F.col("vec_id").alias("key"), F.round(search.cosine_distance(F.col("embedding"), F.col("vector")), 6).alias("distance")).where("distance IS NOT NULL")
    want = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["query"], r["distance"], r["key"])):
        want.setdefault(r["query"], []).append((r["key"], r["distance"]))
    got = {}
    for r in index.search_all(asked, 7, None, digits=6).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["key"], round(r["distance"], 6)))
    assert {q: [k for k, _ in v] for q, v in got.items()} == {q: [k for k, _ in v[:7]] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-6 for q, v in got.items() for a, b in zip(v, want[q], strict=False))
    exact = {(r["query"], r["key"]) for r in index.search_all(asked, 7, None).collect()}
    tried = vector_index.steps(index)
    assert tried == [4, 6]
    for probes, share in zip([1, *tried], vector_index.recalls(index, asked, [1, *tried], 7), strict=True):
        found = {(r["query"], r["key"]) for r in index.search_all(asked, 7, probes).collect()}
        assert abs(len(exact & found) / len(exact) - share) < 1e-12
    plan = index.search_all(asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.replace("FlatMapCoGroupsInArrow", "") and "FlatMapCoGroupsInArrow" in plan
