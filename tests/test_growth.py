"""What must hold at every size: joins that don't multiply, and nothing large sent to all tasks."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from codeloom import model
from codeloom.operators import analytics, calls, graph_update, imports, relational, reports, resolution, traverse, vector_index
from codeloom.plans import code_graph, cypher_queries, derived
from codeloom.plans.sql import Update, update
from codeloom.sources import brace_parsers, parsers


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _walk(edges: dict, root: str) -> list[str]:
    found, queue = [], list(edges.get(root, []))
    while queue:
        x = queue.pop(0)
        if x not in found and x != root:
            found.append(x)
            queue.extend(edges.get(x, []))
    return found


@pytest.mark.parametrize("circles", [False, True])
def test_orders_are_merged_from_parents(spark, circles):
    rng, parents = random.Random(7), {}
    for k in range(1, 30):
        parents[f"K{k}"] = [f"K{p}" for p in rng.sample(range(max(0, k - 6), k), min(k, rng.choice([1, 2, 3])))]
    if circles:
        parents |= {"K3": ["K5", *parents["K3"]], "K20": ["K20", "K1"], "Alone": ["Alone"]}
    rows = [(c, p, n, "EXTENDS") for c, ps in parents.items() for n, p in enumerate(dict.fromkeys(ps))]
    heritage = spark.createDataFrame(rows, "child string, parent string, seq int, kind string")
    got = {r["child"]: (r["order"], r["exact"]) for r in analytics.linear_orders(heritage).collect()}
    for name in parents:
        want = analytics.c3(parents, name)
        assert (name not in got and name == "Alone") or got[name] == ((want, True) if want is not None else (_walk(parents, name), False))
    near = {(r["child"], r["ancestor"]) for r in traverse.ancestors(heritage).collect()}
    assert near == {(c, a) for c in parents for a in [*_walk(parents, c), *([c] if c in parents[c] else [])]}


def test_tiers_do_not_meet_all_definitions_of_a_name(spark):
    schema = "id string, file string, name string, kind string, required int, total int"
    defs = spark.createDataFrame([("a1", "a", "f", "Function", 0, 1), ("b1", "b", "f", "Function", 2, 2), ("b2", "b", "f", "Function", 2, 2), ("c1", "c", "g", "Class", 0, 0), ("d1", "d", "g", "Function", 1, 1), ("e1", "e", "h", "Class", 0, 0)], schema)
    sites = spark.createDataFrame([("1", "a", "f", 9), ("2", "b", "f", 2), ("3", "x", "f", 1), ("4", "x", "f", 2), ("5", "x", "f", None), ("6", "c", "g", 1), ("7", "x", "g", 1), ("8", "x", "h", 0), ("9", "i", "f", 1)], "site string, file string, name string, arg_count int")
    named = spark.createDataFrame([("i", "a", "*", "*")], "file string, source string, local string, exported string")
    found = calls.tiered_calls(sites, defs, named)
    slow = resolution.narrow_overloads(resolution.resolve_tiers(sites, defs, named), defs, sites).collect()
    alone = {r["site"]: (r["id"], r["confidence"]) for r in slow if [x["site"] for x in slow].count(r["site"]) == 1}
    assert {r["site"]: (r["id"], r["confidence"]) for r in found.collect()} == alone == {"1": ("a1", 0.95), "3": ("a1", 0.5), "7": ("d1", 0.5), "9": ("a1", 0.9)}


def test_import_candidates_are_not_sent_to_all_tasks(spark):
    files = spark.createDataFrame([("app/m/P1.php",), ("lib/m1/P2.php",)], "path string")
    rules = spark.createDataFrame([("php", "App\\", "app"), ("php", "App\\m1", "lib/m1"), ("php", "", "no")], "language string, prefix string, target string")
    wanted = spark.createDataFrame([("w.php", "php", "App\\m\\P1"), ("w.php", "php", "App\\m1\\P2")], "file string, language string, spec string")
    found = imports.resolve_imports(wanted, files, rules)
    assert {(r["spec"], r["target"]) for r in found.collect()} == {("App\\m\\P1", "app/m/P1.php"), ("App\\m1\\P2", "lib/m1/P2.php")}
    assert _plan(found).count("BroadcastExchange") <= 1  # the lengths of the rules


def test_two_hop_counts_equal_the_distinct_triples(spark):
    rng = random.Random(3)
    rows = list({(f"a{rng.randrange(5)}", f"b{rng.randrange(8)}", "X") for _ in range(30)} | {(f"b{rng.randrange(8)}", f"c{rng.randrange(9)}", "Y") for _ in range(30)})
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    want = {r["a"]: r["n"] for r in relational.two_hop(edges, "X", "Y").select("a", "c").distinct().groupBy("a").count().withColumnRenamed("count", "n").collect()}
    for wide in (2, 1_000):
        assert {r["a"]: r["n"] for r in relational.two_hop_counts(edges, "X", "Y", wide).collect()} == want


def test_two_hop_counts_send_numbers_through_the_graphs_tasks(spark):
    """Lists of numbers and not of ids go to the graph's tasks; edges without a middle that may go on aren't shuffled; nulls are no ends."""
    rng = random.Random(6)
    rows = [(f"a{rng.randrange(6)}", f"b{rng.randrange(8)}", "X") for _ in range(60)] + [(f"b{rng.randrange(8)}", f"c{rng.randrange(40)}", "X") for _ in range(90)]
    rows += [("a0", None, "X"), (None, "b1", "X"), ("b2", None, "X"), ("a7", "b9", "X"), ("b9", None, "X"), ("c1", "d1", "Y"), ("a8", "b-none", "X")]
    out = {}
    for src, dst, kind in rows:
        if kind == "X":
            out.setdefault(src, set()).add(dst)
    want = {a: len({c for b in bs if b is not None and b in out for c in out[b] if c is not None}) for a, bs in out.items() if any(b is not None and b in out for b in bs)}
    edges = spark.createDataFrame(rows, "src string, dst string, type string")
    for wide in (2, 1_000):
        counts = relational.two_hop_counts(edges, "X", "X", wide, tasks=3, middle=F.col("b").startswith("b"))
        assert {r["a"]: r["n"] for r in counts.collect()} == want and want["a7"] == 0 and None in want and "a8" not in want
    by_graph = [line for line in _plan(counts).splitlines() if "REPARTITION_BY_NUM" in line]
    assert all(", 3)" in line for line in by_graph) and "collect_list(c#" not in _plan(counts) and "collect_list(cs#" not in _plan(counts)
    assert _plan(counts).count("Exchange") == len(by_graph) == 5  # x by a and by b, y by c and by b, the lists by a; the hubs, of which there are none here, share the first


def test_clones_of_one_remote_are_dealt_to_tasks(spark):
    repos = spark.createDataFrame([(f"/p{i}", "same") for i in range(50)] + [("/q", "one"), ("/r", None)], "path string, remoteUrl string")
    listed = reports.list_repos(repos)
    got = {r["path"]: r["siblings"] for r in listed.collect()}
    assert got["/q"] is None and got["/r"] is None and all(got[f"/p{i}"] == sorted(f"/p{k}" for k in range(50) if k != i) for i in range(50))
    assert "BroadcastHashJoin" not in _plan(listed)


def test_lists_of_clones_are_built_in_as_many_tasks_as_asked_for(spark):
    """However many shuffle partitions there are; remotes without a name and clones without siblings stay."""
    repos = spark.createDataFrame([(f"/p{i:02}", "same") for i in range(40)] + [("/q", "one"), ("/r", None), ("/s", None)], "path string, remoteUrl string")
    listed = reports.list_repos(repos, tasks=9)
    got = {r["path"]: r["siblings"] for r in listed.collect()}
    assert len(got) == 43 and got["/q"] is None and got["/r"] is None and got["/s"] is None
    assert all(got[f"/p{i:02}"] == [f"/p{k:02}" for k in range(40) if k != i] for i in range(40))
    exchanges = [line for line in _plan(listed).splitlines() if "Exchange" in line]
    assert len(exchanges) == 3 and all(", 9), REPARTITION_BY_NUM" in line for line in exchanges)


def test_overlapped_makes_no_pairs_and_no_bins_of_ranges(spark):
    """A range as long as the whole file is one row, however narrow the bins; the rows met are those of the pairs."""
    rng = random.Random(9)
    left = [(f"f{rng.randrange(3)}", a, a + rng.randrange(-2, 30)) for a in (rng.randrange(400) for _ in range(25))] + [("long", 0, 10**12), (None, 0, 400)]
    right = [(i, f"f{rng.randrange(4)}", a, a + rng.randrange(-1, 12)) for i, a in enumerate(rng.randrange(400) for _ in range(200))] + [(900, "long", 10**12 - 1, 10**12 + 5), (901, "long", 10**12 + 1, 10**12 + 5), (902, None, 1, 2)]
    x = spark.createDataFrame(left, "file string, start long, end long")
    y = spark.createDataFrame(right, "id int, file string, r_start long, r_end long")
    want = sorted({r[0] for r in right for s in left if r[1] is not None and r[1] == s[0] and s[1] <= s[2] and r[2] <= r[3] and s[1] <= r[3] and s[2] >= r[2]})
    for width in (7, 1000):
        met = relational.overlapped(x, y, "file", width)
        assert met.columns == y.columns and sorted(r["id"] for r in met.collect()) == want and 900 in want and 901 not in want
    touched = reports.detect_changes(x.toDF("filePath", "startLine", "endLine"), y.toDF("id", "filePath", "startLine", "endLine"), spark.createDataFrame([], "id int, process string, step int"))[0]
    assert "Generate" not in touched._jdf.queryExecution().executedPlan().toString()


def test_diamonds_join_only_ends_with_two_paths(spark):
    """Ends that one path joins take no part in the joins of paths; the diamonds are those of all pairs of middles."""
    rng = random.Random(4)
    pairs = sorted({(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(120)} | {(f"c{i}", f"c{i + 1}") for i in range(50)})
    edges = spark.createDataFrame([(a, b, "CALLS") for a, b in pairs] + [(pairs[0][0], pairs[0][1], "CALLS"), ("n0", None, "CALLS"), (None, "n0", "CALLS"), ("n1", "c1", "USES")], "src string, dst string, type string")
    out = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    want = sorted((t, x, y, a) for a in out for x in out[a] for y in out[a] if x < y for t in out.get(x, []) if t in out.get(y, []))
    got = relational.diamonds(edges, "CALLS")
    assert want and sorted(map(tuple, got.collect())) == want
    assert "diamond-ends" in "".join(got.inputFiles())


def test_files_of_one_split_are_parsed_by_all_cores(spark):
    files = spark.range(200).coalesce(1).selectExpr("concat('m', id, '.py') AS path", "concat('def f', id, '(): pass') AS content")
    found = parsers.parse_python(files)
    tasks = found.select(F.spark_partition_id().alias("task"), "name").collect()
    assert sorted(r["name"] for r in tasks) == sorted(f"f{i}" for i in range(200))
    assert len({r["task"] for r in tasks}) >= spark.sparkContext.defaultParallelism
    typescript = brace_parsers.parse_typescript(files.withColumn("content", F.lit("function g() {}")))
    assert typescript.select(F.spark_partition_id().alias("task")).distinct().count() >= spark.sparkContext.defaultParallelism


def test_types_spread_without_broadcasts(spark):
    """Chains, circles, two types for a name in one round, null names: as in a walk round by round; nothing goes to all tasks."""
    known = [("a", "A"), ("b", "B"), ("z", "Z"), (None, "N")]
    links = [("c", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("d", "e"), ("a", "b"), ("x", "y"), ("y", "x"), ("e", "z"), (None, "a"), ("q", None)] + [(f"k{i + 1}", f"k{i}") for i in range(12)] + [("k0", "a")]
    kn, ln = spark.createDataFrame(known, "name string, type string"), spark.createDataFrame(links, "name string, source string")
    want, last = dict(known), dict(known)
    while last:
        step = {}
        for name, source in links:
            if source is not None and name is not None and source in last and name not in want:
                step[name] = min(step.get(name, last[source]), last[source])
        want.update(step)
        last = step
    sent = []
    real = resolution.cut
    resolution.cut = lambda df: (sent.append(_plan(df)), real(df))[1]
    try:
        got = {r["name"]: r["type"] for r in resolution.propagate_types(kn, ln).where("name IS NOT NULL").collect()}
    finally:
        resolution.cut = real
    assert got == {k: v for k, v in want.items() if k is not None}
    assert len(sent) > 10 and not any("Broadcast" in p for p in sent)


def test_recall_is_measured_when_a_search_asks(spark):
    """A search that says which cells it reads pays for no exact search; rows with nulls or other lengths are in the odd cell."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)] + [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [1.0]), (303, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    real, asked = vector_index.enough_probes, []
    vector_index.enough_probes = lambda *a, **b: (asked.append(1), real(*a, **b))[1]
    try:
        index = vector_index.build(vectors, "vec_id", cells=8)
        odd = {r["vec_id"] for r in index.rows.where("cell = -1").collect()}
        exact = [r["vec_id"] for r in index.search(rows[0][1], 5, None).collect()]
        assert odd == {300, 301, 302, 303} and exact[0] == 0 and not asked
        assert 0 < index.probes <= 8 and index.probes >= vector_index.MIN_PROBES and len(asked) == 1
    finally:
        vector_index.enough_probes = real


def test_tasks_of_a_graph_follow_its_rows(spark, sf_dir, monkeypatch):
    """Whatever the shuffle settings are, no task of the large exchanges gets more than its share of the rows."""
    monkeypatch.setattr(model, "TASK_ROWS", 100)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for g in (code_graph.code_graph(spark, sf_dir), derived.trade_graph(spark, sf_dir)):
        assert g.tasks == -(-lines // 100) > spark.sparkContext.defaultParallelism
        assert _plan(g.edges).count(f", {g.tasks}), REPARTITION_BY_NUM") >= 2


def test_references_and_calls_are_counted_where_they_are_dealt(spark):
    rng = random.Random(8)
    nodes = spark.createDataFrame([(f"n{i}", f"f{i % 4}", f"name{i % 9}", "Function") for i in range(40)], "id string, filePath string, name string, label string")
    rows = sorted({(f"n{rng.randrange(40)}", f"n{rng.choice([0, rng.randrange(40)])}", rng.choice(["CALLS", "USES"])) for _ in range(400)})
    g = model.Graph(nodes, spark.createDataFrame(rows, "src string, dst string, type string"), 7)
    want = {}
    for a, b, kind in rows:
        for key in ((b, "incoming", kind.lower()), (a, "outgoing", kind.lower())):
            want[key] = want.get(key, 0) + 1
    counts = relational.reference_counts(g, 3)
    assert {(r["id"], r["side"], r["rel"]): r["n"] for r in counts.collect()} == want
    pairs = reports.inter_file_calls(g)
    of = {f"n{i}": (f"f{i % 4}", f"name{i % 9}") for i in range(40)}
    assert sorted(map(tuple, pairs.collect())) == sorted({(*of[a], *of[b]) for a, b, kind in rows if kind == "CALLS" and of[a][0] != of[b][0]})
    left = graph_update.detach_delete(g, nodes.where("filePath = 'f1'"))
    assert left.tasks == 7 and sorted(map(tuple, left.edges.select("src", "dst", "type").collect())) == sorted(r for r in rows if "f1" not in (of[r[0]][0], of[r[1]][0]))
    around = {r["id"]: r for r in reports.context(g, nodes.select("id"), 5).collect()}
    assert around["n0"]["incoming"]["calls"] == sorted(a for a, b, kind in rows if (b, kind) == ("n0", "CALLS"))[:5]
    for df in (counts, pairs, left.edges):
        assert ", 7), REPARTITION_BY_NUM" in _plan(df)


def test_giant_component_is_not_coloured(spark, monkeypatch):
    """What is strongly connected with the busiest node is found by two searches; only the rest is coloured."""
    rng = random.Random(2)
    giant = [(f"g{i}", f"g{(i + 1) % 9}") for i in range(9)] + [(f"g{rng.randrange(9)}", f"g{rng.randrange(9)}") for _ in range(20)]
    rest = [("u", "v"), ("v", "u"), ("v", "g0"), ("g1", "w")]
    sent, real = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: (sent.append(df.columns), real(df))[1])
    found = lambda rows: {r["id"]: r["scc"] for r in traverse.strongly_connected(spark.createDataFrame(rows, "src string, dst string")).collect()}
    assert found(giant) == {f"g{i}": "g0" for i in range(9)}
    assert ["id", "c"] not in sent and ["id", "next"] in sent
    assert found(giant + rest) == {f"g{i}": "g0" for i in range(9)} | {"u": "u", "v": "u", "w": "w"}


def test_only_nodes_that_may_move_look_at_their_links(spark, monkeypatch):
    rows = [(f"{k}{i}", f"{k}{j}") for k in "abc" for i in range(5) for j in range(i)] + [("a0", "b0"), ("b1", "c1")]
    edges = spark.createDataFrame(rows, "src string, dst string")
    sent, real = [], analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df: (sent.append(_plan(df)), real(df))[1])
    found = analytics.communities(edges)
    of = {r["id"]: r["comm"] for r in found.collect()}
    assert set(of) == {x for r in rows for x in r}
    assert sum("pmod(xxhash64(a#" in p for p in sent) >= 2
    degree = {x: sum(x in r for r in rows) for x in of}
    shares = [sum(d for x, d in degree.items() if of[x] == c) / (2 * len(rows)) for c in set(of.values())]
    want = sum(of[a] == of[b] for a, b in rows) / len(rows) - sum(x * x for x in shares)
    near = analytics.neighbours(edges)
    with_d = found.join(near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id")
    assert analytics.modularity(near, found) == pytest.approx(want) == analytics.modularity(near, with_d)


def test_merged_pairs_are_shuffled_once(spark, sf_dir):
    """What a pattern finds isn't looked up among the nodes again, and both statements read one shuffle of the pairs."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a plan that isn't adaptive shows what is used again
    try:
        plan = _plan(cypher_queries.cypher_merge_edges(spark, sf_dir)).splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    pairs = [line.split("Exchange", 1) for line in plan if "Exchange" in line and "hashpartitioning(src#" in line]
    assert sorted(before.endswith("Reused") for before, _ in pairs) == [False, True, True]
    assert not any("LeftSemi" in line or "SortAggregate" in line for line in plan)


def test_merged_edges_keep_what_exists(spark):
    rng = random.Random(5)
    nodes = [(f"k{i}", "Class") for i in range(4)] + [(f"f{i}", "Function") for i in range(12)] + [(None, "Class")]
    edges = sorted({(f"k{rng.randrange(4)}", f"f{rng.randrange(12)}", "HAS_METHOD") for _ in range(30)} | {(f"f{rng.randrange(12)}", f"f{rng.randrange(12)}", "CALLS") for _ in range(30)})
    paths = {(a, c) for a, b, m in edges if m == "HAS_METHOD" for x, c, n in edges if n == "CALLS" and x == b}
    old = (*min(paths), "USES")
    made = spark.createDataFrame([(*e, 0.25) for e in [*edges, old]] + [("k0", None, "USES", 0.25)], "src string, dst string, type string, confidence double")
    g = model.Graph(spark.createDataFrame(nodes, "id string, label string"), made.selectExpr("*", "CAST(NULL AS string) AS reason", "CAST(NULL AS int) AS step"), 7)
    text = "MATCH (k:Class)-[m:HAS_METHOD]->(f:Function)-[c:CALLS]->(g:Function) MERGE (k)-[:USES {confidence: %s, reason: 'a__b', step: 3}]->(g)"
    for value, want in (("0.5", 0.5), ("c.confidence + 0.25", 0.5)):
        once = update(g, text % value)
        twice = update(once, text % "0.75")
        assert once.tasks == twice.tasks == 7 and ", 7), REPARTITION_BY_NUM" in _plan(once.edges)
        for merged in (once, twice):
            rows = [tuple(r) for r in merged.type("USES").where("dst IS NOT NULL").collect()]
            assert sorted(rows) == sorted([(*old, 0.25, None, None)] + [(a, c, "USES", want, "a__b", 3) for a, c in paths - {old[:2]}])
            assert merged.edges.count() == len(edges) + len(paths) + 1
    alone = Update(g)
    linked = alone.change("MATCH (k:Class) MERGE (k)-[:USES {confidence: 1.0}]->(k)")
    assert linked.edges.count() == len(edges) + 2 + 4 and [tuple(r) for r in alone.refused.collect()] == [(None, None, "USES", 1.0, None, None)]
