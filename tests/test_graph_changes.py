"""CALL statements on stored indexes, writing statements, and versions of a graph."""

import pytest

from codeloom.model import Graph
from codeloom.operators import graph_update
from codeloom.operators.indexes import GraphIndexes, IndexMissing
from codeloom.plans.sql import QueryError, cypher, is_write_query, update

NODES = [("f1", "Function", "parse input", "a.ts", 1), ("f2", "Function", "parse parse tokens", "b.ts", 5), ("f3", "Function", "render", "b.ts", 9), ("c1", "Class", "parse", "c.ts", 2)]
EDGES = [("f1", "f2", "CALLS", 0.9), ("f2", "f3", "CALLS", 0.8), ("c1", "f1", "HAS_METHOD", 1.0)]


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame([(*e, None, None) for e in EDGES], "src string, dst string, type string, confidence double, reason string, step int")
    return Graph(spark.createDataFrame(NODES, "id string, label string, name string, filePath string, startLine long"), edges)


@pytest.fixture(scope="module")
def indexes(spark, graph):
    chunks = spark.createDataFrame([("f1", 0, [1.0, 0.0]), ("f2", 0, [0.8, 0.6]), ("f3", 0, [0.0, 1.0]), ("f3", 1, None)], "nodeId string, chunkIndex int, embedding array<float>")
    return GraphIndexes(graph, {"CodeEmbedding": chunks})


def ids(graph, what="nodes"):
    return sorted(r["id"] if what == "nodes" else (r["src"], r["dst"], r["type"]) for r in getattr(graph, what).collect())


def test_text_calls(spark, graph, indexes):
    run = lambda text, **params: [tuple(r) for r in cypher(graph, text, params, indexes).collect()]
    with pytest.raises(IndexMissing):
        run("CALL QUERY_FTS_INDEX('Function', 'words', 'parse') RETURN node, score")
    assert run("CALL CREATE_FTS_INDEX('Function', 'words', ['name'], stemmer := 'porter')") == [("Function", "words", "created")]
    with pytest.raises(IndexMissing):
        run("CALL CREATE_FTS_INDEX('Function', 'words', ['name'])")
    found = run("CALL QUERY_FTS_INDEX('Function', 'words', 'Parsing tokens', conjunctive := false) RETURN node.id AS id, score ORDER BY score DESC LIMIT 5")
    assert [r[0] for r in found] == ["f2", "f1"] and found[0][1] > found[1][1] > 0
    assert [r[0] for r in run("CALL QUERY_FTS_INDEX('Function', 'words', $q, conjunctive := true) RETURN node.id AS id, score", q="parse tokens")] == ["f2"]
    assert run("CALL QUERY_FTS_INDEX('Function', 'words', 'parse') YIELD node AS hit, score MATCH (hit)-[r:CALLS]->(g:Function) WHERE g.name = 'render' RETURN hit.id AS hit, g.id AS g") == [("f2", "f3")]
    assert run("CALL QUERY_FTS_INDEX('Function', 'words', '?!') YIELD node RETURN node.id AS id") == []
    assert run("CALL DROP_FTS_INDEX('Function', 'words')") == [("Function", "words", "dropped")]
    with pytest.raises(IndexMissing):
        run("CALL DROP_FTS_INDEX('Function', 'words')")


def test_vector_calls(spark, graph, indexes):
    run = lambda text, **params: [tuple(r) for r in cypher(graph, text, params, indexes).collect()]
    run("CALL CREATE_VECTOR_INDEX('CodeEmbedding', 'near', 'embedding', metric := 'cosine')")
    text = "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', CAST([1.0, 0] AS FLOAT[2]), 3) YIELD node AS emb, distance WITH emb, distance WHERE distance < 0.6 RETURN emb.nodeId AS id, distance ORDER BY distance"
    assert [r[0] for r in run(text)] == ["f1", "f2"]
    joined = "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', $v, 2) YIELD node AS emb, distance MATCH (f:Function) WHERE f.id = emb.nodeId RETURN f.name AS name ORDER BY name"
    assert run(joined, v=[0.0, 1.0]) == [("parse parse tokens",), ("render",)]
    for wrong in (
        "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', CAST([1.0] AS FLOAT[2]), 3) RETURN node", "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', [1, 0], 3) YIELD node AS e MATCH (f:Function) RETURN f.id AS id",
        "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', [1, 0], 3) YIELD score RETURN score", "CALL SOMETHING('x') RETURN node", "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'near', [1, 0], 3) YIELD node AS e MATCH (f:Function) WHERE f.startLine = 1 RETURN f.id AS id",
    ):
        with pytest.raises(QueryError):
            run(wrong)
    with pytest.raises(QueryError):
        cypher(graph, text)


def test_changes(spark, graph):
    made = update(graph, "CREATE (n:Function {id: 'f4', name: $name, startLine: 3})", {"name": "it's"})
    assert ids(made) == ["c1", "f1", "f2", "f3", "f4"] and made.nodes.where("id = 'f4'").select("label", "name", "startLine", "filePath").first() == ("Function", "it's", 3, None)
    assert ids(update(graph, "CREATE (n:Function {id: 'f1', name: 'again'})")) == ids(graph)
    merged = update(graph, "MERGE (n:Function {id: 'f1'}) ON CREATE SET n.name = 'new' ON MATCH SET n.name = 'seen' SET n.startLine = 7")
    assert merged.nodes.where("id = 'f1'").select("name", "startLine", "filePath").first() == ("seen", 7, "a.ts") and ids(merged) == ids(graph)
    fresh = update(graph, "MERGE (n:Class {id: 'c2'}) ON CREATE SET n.name = 'new' ON MATCH SET n.name = 'seen' SET n.startLine = 7")
    assert fresh.nodes.where("id = 'c2'").select("label", "name", "startLine").first() == ("Class", "new", 7)
    changed = update(graph, "MATCH (f:Function)-[r:CALLS]->(g:Function) WHERE r.confidence > 0.85 SET g.name = f.name, g.startLine = f.startLine + 100")
    assert {r["id"]: (r["name"], r["startLine"]) for r in changed.nodes.collect()} == {"f1": ("parse input", 1), "f2": ("parse input", 101), "f3": ("render", 9), "c1": ("parse", 2)}
    gone = update(graph, "MATCH (f:Function) WHERE f.filePath = 'b.ts' DETACH DELETE f")
    assert ids(gone) == ["c1", "f1"] and ids(gone, "edges") == [("c1", "f1", "HAS_METHOD")]
    linked = update(graph, "MATCH (c:Class)-[r:HAS_METHOD]->(f:Function)-[s:CALLS]->(g:Function) CREATE (c)-[:CodeRelation {type: 'USES', confidence: 0.5}]->(g)")
    assert ("c1", "f2", "USES") in ids(linked, "edges") and len(ids(linked, "edges")) == 4
    assert ids(update(graph, "MATCH (a:Function)-[r:CALLS]->(b:Function) MERGE (a)-[:CALLS]->(b)"), "edges") == ids(graph, "edges")
    for wrong in ("MATCH (a:Function) RETURN a.id AS id", "CREATE (n:Function {name: 'x'})", "MATCH (a:Function) SET a.id = 'x'", "MATCH (a:Function) SET a.none = 1", "DROP x", "MATCH (a:Function) DETACH DELETE a x"):
        with pytest.raises(QueryError):
            update(graph, wrong)
    with pytest.raises(QueryError):
        cypher(graph, "MATCH (n) DETACH DELETE n")
    assert not is_write_query("MATCH (n:Set) WHERE n.name = 'create' RETURN n.id AS id") and is_write_query("match (n) set n.x = 1")


def test_copy_and_versions(spark, graph, tmp_path):
    spark.createDataFrame([("s1", "one"), ("f1", "clash"), ("s2", "two"), (None, "none")], "id string, name string").write.parquet(f"{tmp_path}/sections")
    copied, refused = graph_update.copy_from(graph, "Section", f"{tmp_path}/sections")
    assert ids(copied) == ["c1", "f1", "f2", "f3", "s1", "s2"] and {r["name"] for r in refused.collect()} == {"clash", "none"}
    assert ids(update(graph, f"COPY Section FROM '{tmp_path}/sections'")) == ids(copied)
    root = f"{tmp_path}/versions"
    assert graph_update.latest_version(spark, root) is None
    graph_update.save_version(graph, root)
    assert ids(graph_update.latest_version(spark, root)) == ids(graph)
    graph_update.save_version(copied, root)
    (tmp_path / "versions" / "broken" / "nodes").mkdir(parents=True)
    last = graph_update.latest_version(spark, root)
    assert ids(last) == ids(copied) and ids(last, "edges") == ids(graph, "edges")


def test_edges_need_both_ends(spark, graph):
    rows = spark.createDataFrame([("f1", "f3", "CALLS"), ("f1", "nowhere", "CALLS"), ("nowhere", "f1", "CALLS"), (None, "f1", "CALLS")], "src string, dst string, type string")
    out, bad = graph_update.create_edges(graph, rows)
    assert ("f1", "f3", "CALLS") in ids(out, "edges") and bad.count() == 3
