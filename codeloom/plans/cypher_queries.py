"""One query for each clause of the Cypher subset, over the whole code graph, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates
from ..model import Graph
from ..operators import graph_update
from ..operators.indexes import GraphIndexes
from ..session import ensure_checkpoint_dir
from ..sources.tables import table
from .code_graph import CODE_SQL, code_graph
from .registry import Registry
from .sql import cypher, sql, update

REGISTRY = Registry()

#: name: (Cypher, parameters, SQL over n and e)
CASES: dict[str, tuple[str, dict, str]] = {
    "cypher_match_label": ("MATCH (c:Class) RETURN c.id AS id, c.name AS name", {}, "SELECT id, name FROM n WHERE label = 'Class'"),
    "cypher_match_any": ("MATCH (x) RETURN label(x) AS label, count(*) AS c", {}, "SELECT label, count(*)::BIGINT AS c FROM n GROUP BY label"),
    "cypher_inline_map": ("MATCH (f:Function {name: $name})-[r:CALLS]->(g) RETURN f.id AS f, g.id AS g", {"name": "economy_7"}, "SELECT f.id AS f, g.id AS g FROM n f JOIN e ON e.src = f.id AND e.type = 'CALLS' JOIN n g ON g.id = e.dst WHERE f.label = 'Function' AND f.name = 'economy_7'"),
    "cypher_typed_expand": ("MATCH (a:Function)-[r:CodeRelation {type: 'CALLS'}]->(b:Function) WHERE r.confidence >= 0.99 RETURN a.id AS a, b.id AS b", {}, "SELECT src AS a, dst AS b FROM e WHERE type = 'CALLS' AND confidence >= 0.99"),
    "cypher_reverse": ("MATCH (b:Class)<-[r:EXTENDS]-(a:Class) RETURN b.id AS base, a.id AS child", {}, "SELECT dst AS base, src AS child FROM e WHERE type = 'EXTENDS'"),
    "cypher_anonymous": ("MATCH ()-[r:HAS_METHOD]->() RETURN r.src AS src, count(r) AS c", {}, "SELECT src, count(*)::BIGINT AS c FROM e WHERE type = 'HAS_METHOD' GROUP BY src"),
    "cypher_two_patterns": ("MATCH (a:Function)-[r:MEMBER_OF]->(c:Community), (a)-[s:STEP_IN_PROCESS]->(p:Process) RETURN c.name AS community, p.name AS process, count(*) AS c", {}, "SELECT c.name AS community, p.name AS process, count(*)::BIGINT AS c FROM e r JOIN e s ON r.src = s.src JOIN n c ON c.id = r.dst JOIN n p ON p.id = s.dst WHERE r.type = 'MEMBER_OF' AND s.type = 'STEP_IN_PROCESS' GROUP BY ALL"),
    "cypher_chained": ("MATCH (k:Class)-[m:HAS_METHOD]->(f:Function) MATCH (f)-[c:CALLS]->(g:Function) WHERE k.name CONTAINS '07' RETURN k.id AS k, count(DISTINCT g.id) AS callees", {}, "SELECT k.id AS k, count(DISTINCT c.dst)::BIGINT AS callees FROM n k JOIN e m ON m.src = k.id AND m.type = 'HAS_METHOD' JOIN e c ON c.src = m.dst AND c.type = 'CALLS' WHERE k.label = 'Class' AND contains(k.name, '07') GROUP BY k.id"),
    "cypher_optional": ("MATCH (k:Class) OPTIONAL MATCH (k)-[r:EXTENDS]->(b:Class) RETURN k.id AS k, b.id AS base", {}, "SELECT k.id AS k, e.dst AS base FROM n k LEFT JOIN e ON e.src = k.id AND e.type = 'EXTENDS' WHERE k.label = 'Class'"),
    "cypher_boolean": ("MATCH (f:Function) WHERE (f.startLine < 100 OR f.endLine > 400) AND NOT f.isExported = true AND f.startLine <> 1 RETURN f.id AS id", {}, "SELECT id FROM n WHERE label = 'Function' AND (\"startLine\" < 100 OR \"endLine\" > 400) AND NOT \"isExported\" AND \"startLine\" <> 1"),
    "cypher_in_list": ("MATCH (p:Process)<-[r:STEP_IN_PROCESS]-(f) WHERE p.name IN $names AND r.step <= 3 RETURN p.name AS process, r.step AS step, f.id AS f", {"names": ["Brand_1", "Brand_2", "Brand_13", "Brand_25"]}, "SELECT p.name AS process, e.step, e.src AS f FROM e JOIN n p ON p.id = e.dst WHERE e.type = 'STEP_IN_PROCESS' AND p.name IN ('Brand_1', 'Brand_2', 'Brand_13', 'Brand_25') AND e.step <= 3"),
    "cypher_string_tests": ("MATCH (f:Function) WHERE f.name STARTS WITH 'eco' AND f.filePath ENDS WITH 'f7.ts' AND f.content CONTAINS 'l' RETURN f.id AS id, f.filePath AS path", {}, "SELECT id, \"filePath\" AS path FROM n WHERE label = 'Function' AND starts_with(name, 'eco') AND ends_with(\"filePath\", 'f7.ts') AND contains(content, 'l')"),
    "cypher_null_tests": ("MATCH (x) WHERE x.filePath IS NULL AND x.heuristicLabel IS NOT NULL RETURN x.id AS id", {}, "SELECT id FROM n WHERE \"filePath\" IS NULL AND \"heuristicLabel\" IS NOT NULL"),
    "cypher_list_contains": ("MATCH (c:Community) WHERE list_contains($regions, c.heuristicLabel) RETURN c.id AS id", {"regions": ["region_0", "region_3"]}, "SELECT id FROM n WHERE label = 'Community' AND \"heuristicLabel\" IN ('region_0', 'region_3')"),
    "cypher_labels": ("MATCH (x)-[r:DEFINES]->(y) RETURN labels(y)[0] AS label, count(*) AS c", {}, "SELECT label, count(*)::BIGINT AS c FROM e JOIN n ON id = dst WHERE type = 'DEFINES' GROUP BY label"),
    "cypher_with": ("MATCH (f:Function)-[r:CALLS]->(g:Function) WITH f, count(g) AS callees WHERE callees > 40 RETURN f.id AS id, callees", {}, "SELECT src AS id, count(*)::BIGINT AS callees FROM e WHERE type = 'CALLS' GROUP BY src HAVING count(*) > 40"),
    "cypher_distinct": ("MATCH (f:Function)-[r:MEMBER_OF]->(c:Community) RETURN DISTINCT f.filePath AS path, c.name AS community", {}, "SELECT DISTINCT f.\"filePath\" AS path, c.name AS community FROM e JOIN n f ON f.id = src JOIN n c ON c.id = dst WHERE e.type = 'MEMBER_OF'"),
    "cypher_counts": ("MATCH (f:Function)-[r:CALLS]->(g:Function) RETURN f.filePath AS path, count(*) AS calls, count(r) AS rels, count(DISTINCT g.filePath) AS files", {}, "SELECT f.\"filePath\" AS path, count(*)::BIGINT AS calls, count(*)::BIGINT AS rels, count(DISTINCT g.\"filePath\")::BIGINT AS files FROM e JOIN n f ON f.id = src JOIN n g ON g.id = dst WHERE e.type = 'CALLS' GROUP BY ALL"),
    "cypher_min": ("MATCH (f:Function)-[r:STEP_IN_PROCESS]->(p:Process) RETURN p.name AS process, min(f.name) AS first, max(r.step) AS steps", {}, "SELECT p.name AS process, min(f.name) AS first, max(step)::INT AS steps FROM e JOIN n f ON f.id = src JOIN n p ON p.id = dst WHERE e.type = 'STEP_IN_PROCESS' GROUP BY ALL"),
    "cypher_collect": ("MATCH (k:Class)<-[r:EXTENDS]-(c:Class) RETURN k.id AS id, size(collect(DISTINCT c.name)) AS children", {}, "SELECT dst AS id, count(DISTINCT c.name)::INT AS children FROM e JOIN n c ON c.id = src WHERE e.type = 'EXTENDS' GROUP BY dst"),
    "cypher_implicit_group": ("MATCH (f:Function) RETURN f.filePath AS path, f.isExported AS exported, count(*) AS c, avg(f.startLine) AS mean", {}, "SELECT \"filePath\" AS path, \"isExported\" AS exported, count(*)::BIGINT AS c, avg(\"startLine\") AS mean FROM n WHERE label = 'Function' GROUP BY ALL"),
    "cypher_order_limit": ("MATCH (f:Function)<-[r:CALLS]-(g) RETURN f.id AS id, count(*) AS callers ORDER BY callers DESC, id LIMIT 25", {}, "SELECT dst AS id, count(*)::BIGINT AS callers FROM e WHERE type = 'CALLS' GROUP BY dst ORDER BY callers DESC, id LIMIT 25"),
    "cypher_union_all": ("MATCH (c:Class) RETURN c.id AS id, 'class' AS kind UNION ALL MATCH (p:Process) RETURN p.id AS id, 'process' AS kind", {}, "SELECT id, lower(label) AS kind FROM n WHERE label IN ('Class', 'Process')"),
    "cypher_parameter": ("MATCH (f:Function)-[r:CALLS]->(g:Function) WHERE r.confidence > $floor AND f.startLine > $line RETURN f.id AS f, g.id AS g", {"floor": 0.97, "line": 450}, "SELECT src AS f, dst AS g FROM e JOIN n ON id = src WHERE type = 'CALLS' AND e.confidence > 0.97 AND \"startLine\" > 450"),
}


def _register(name: str, text: str, params: dict, sql_text: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cypher(code_graph(spark, sf_dir), text, params)

    run.__doc__ = text
    REGISTRY.query(name, f"WITH {CODE_SQL} {sql_text}")(run)


for _name, _case in CASES.items():
    _register(_name, *_case)


@REGISTRY.query("adhoc_sql", f"WITH {CODE_SQL} SELECT c.name AS community, count(*)::BIGINT AS calls FROM e JOIN e m ON m.src = e.src AND m.type = 'MEMBER_OF' JOIN n c ON c.id = m.dst WHERE e.type = 'CALLS' GROUP BY c.name")
def adhoc_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read-only SQL over the views of the graph."""
    text = "SELECT c.name AS community, count(*) AS calls FROM edges e JOIN edges m ON m.src = e.src AND m.type = 'MEMBER_OF' JOIN community_nodes c ON c.id = m.dst WHERE e.type = :kind GROUP BY c.name"
    return sql(spark, code_graph(spark, sf_dir), text, {"kind": "CALLS"})


# ---- searches inside queries, and changes

_WORDS_SQL = """, tk AS (SELECT id, regexp_extract_all(lower(name || ' ' || content), '[a-z0-9_]+') AS w FROM n WHERE label = 'Function'),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tk WHERE len(w) > 0),
tf AS (SELECT id, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term))::DOUBLE AS f FROM tk, (SELECT unnest(['steel', 'small']) AS term) t),
df AS (SELECT term, count(*) AS df FROM tf WHERE f > 0 GROUP BY term),
bm AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS terms FROM tf JOIN df USING (term), st WHERE f > 0 GROUP BY id)"""


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[Graph, GraphIndexes]:
    """The code graph with a text index over its functions, and the embeddings with a vector index."""
    g = code_graph(spark, sf_dir)
    chunks = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("Function:"), F.col("vec_id").cast("string")).alias("nodeId"), F.col("label").alias("chunkIndex"), "embedding")
    return g, GraphIndexes(g, {"CodeEmbedding": chunks})


def _call_fts(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    g, indexes = _indexed(spark, sf_dir)
    cypher(g, "CALL CREATE_FTS_INDEX('Function', 'function_fts', ['name', 'content'])", indexes=indexes)
    return cypher(g, text, {"words": "steel small"}, indexes)


@REGISTRY.query("cypher_call_fts", f"WITH {CODE_SQL}{_WORDS_SQL} SELECT id, round(score, 6) AS score FROM bm")
def cypher_call_fts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text search inside a query: functions with either word."""
    found = _call_fts(spark, sf_dir, "CALL QUERY_FTS_INDEX('Function', 'function_fts', $words, conjunctive := false) RETURN node.id AS id, score")
    return found.select("id", F.round("score", 6).alias("score"))


@REGISTRY.query("cypher_call_fts_match", f"WITH {CODE_SQL}{_WORDS_SQL} SELECT bm.id AS f, e.dst AS g, c.name AS community FROM bm JOIN e ON e.src = bm.id AND e.type = 'CALLS' AND e.confidence >= 0.99 JOIN e m ON m.src = e.dst AND m.type = 'MEMBER_OF' JOIN n c ON c.id = m.dst")
def cypher_call_fts_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search yields goes on in a pattern."""
    return _call_fts(spark, sf_dir, "CALL QUERY_FTS_INDEX('Function', 'function_fts', $words) YIELD node AS hit, score MATCH (hit)-[r:CALLS]->(g:Function)-[m:MEMBER_OF]->(c:Community) WHERE r.confidence >= 0.99 AND score > 0 RETURN hit.id AS f, g.id AS g, c.name AS community")


@REGISTRY.query("cypher_call_vector", f"WITH {CODE_SQL}, q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS distance FROM embeddings, q), k AS (SELECT * FROM v ORDER BY distance, 'Function:' || vec_id LIMIT 200) SELECT n.id AS id, n.name AS name, round(distance, 6) AS distance FROM k JOIN n ON n.id = 'Function:' || vec_id WHERE distance < 0.9")
def cypher_call_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest chunks, met with their functions; all cells are read, so the answer is the exact one."""
    g, indexes = _indexed(spark, sf_dir)
    cypher(g, "CALL CREATE_VECTOR_INDEX('CodeEmbedding', 'code_embedding_idx', 'embedding', metric := 'cosine')", indexes=indexes)
    index = indexes.vectors["CodeEmbedding", "code_embedding_idx"]
    index.least_probes = len(index.centroids)
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    text = "CALL QUERY_VECTOR_INDEX('CodeEmbedding', 'code_embedding_idx', $vector, 200) YIELD node AS emb, distance MATCH (f:Function) WHERE f.id = emb.nodeId WITH f, distance WHERE distance < 0.9 RETURN f.id AS id, f.name AS name, distance"
    return cypher(g, text, {"vector": list(row["embedding"])}, indexes).select("id", "name", F.round("distance", 6).alias("distance"))


@REGISTRY.query("cypher_create", f"WITH {CODE_SQL} SELECT label, count(*)::BIGINT AS c, count(name)::BIGINT AS named FROM (SELECT id, label, name FROM n UNION ALL SELECT 'Function:new', 'Function', 'made') GROUP BY label")
def cypher_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new node is there; one whose id exists changes nothing."""
    g = update(code_graph(spark, sf_dir), "CREATE (f:Function {id: 'Function:new', name: $name})", {"name": "made"})
    g = update(g, "CREATE (f:Function {id: 'Function:1', name: 'refused'})")
    return g.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("c"), F.count("name").alias("named"))


@REGISTRY.query("cypher_merge_set", f"WITH {CODE_SQL} SELECT id, CASE WHEN id = 'Class:1' THEN 'matched' ELSE name END AS name, CASE WHEN id = 'Class:1' THEN 99 ELSE \"startLine\" END::BIGINT AS line FROM n WHERE label = 'Class' UNION ALL SELECT 'Class:none', 'created', 99")
def cypher_merge_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE of a node that is there and of one that isn't."""
    g = code_graph(spark, sf_dir)
    for node in ("Class:1", "Class:none"):
        g = update(g, "MERGE (c:Class {id: $id}) ON CREATE SET c.name = 'created' ON MATCH SET c.name = 'matched' SET c.startLine = 99", {"id": node})
    return g.label("Class").select("id", "name", F.col("startLine").alias("line"))


@REGISTRY.query("cypher_set", f"WITH {CODE_SQL}, h AS (SELECT dst AS id, min(src) AS by_class FROM e WHERE type = 'HAS_METHOD' GROUP BY dst) SELECT n.id, coalesce(by_class, \"heuristicLabel\") AS owner, \"startLine\" + CASE WHEN by_class IS NOT NULL THEN 1000 ELSE 0 END AS line FROM n LEFT JOIN h USING (id) WHERE label = 'Function'")
def cypher_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET from a pattern; of several matches of a node the smallest values count."""
    g = update(code_graph(spark, sf_dir), "MATCH (k:Class)-[r:HAS_METHOD]->(f:Function) SET f.heuristicLabel = k.id, f.startLine = f.startLine + 1000")
    return g.label("Function").select("id", F.col("heuristicLabel").alias("owner"), F.col("startLine").alias("line"))


@REGISTRY.query("cypher_detach_delete", f"WITH {CODE_SQL}, gone AS (SELECT id FROM n WHERE label = 'Function' AND ends_with(\"filePath\", 'f7.ts')), kn AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM gone)), ke AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) SELECT 'node' AS what, label AS kind, count(*)::BIGINT AS c FROM kn GROUP BY label UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM ke GROUP BY type")
def cypher_detach_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted nodes take the edges at both of their ends along; the new version is written and read again."""
    g = update(code_graph(spark, sf_dir), "MATCH (f:Function) WHERE f.filePath ENDS WITH 'f7.ts' DETACH DELETE f")
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/graph-versions-{uuid.uuid4().hex}"
    graph_update.save_version(g, root)
    g = graph_update.latest_version(spark, root)
    count = F.count(F.lit(1)).alias("c")
    return g.nodes.groupBy(F.lit("node").alias("what"), F.col("label").alias("kind")).agg(count).unionByName(g.edges.groupBy(F.lit("edge").alias("what"), F.col("type").alias("kind")).agg(count))


@REGISTRY.query("cypher_merge_edges", f"WITH {CODE_SQL}, x AS (SELECT DISTINCT m.src, c.dst FROM e m JOIN e c ON c.src = m.dst AND c.type = 'CALLS' AND c.confidence >= 0.99 WHERE m.type = 'HAS_METHOD') SELECT src, dst, 0.5::DOUBLE AS confidence FROM x")
def cypher_merge_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge for each pair that a pattern finds, once."""
    text = "MATCH (k:Class)-[m:HAS_METHOD]->(f:Function)-[c:CALLS]->(g:Function) WHERE c.confidence >= 0.99 MERGE (k)-[:USES {confidence: 0.5}]->(g)"
    return update(update(code_graph(spark, sf_dir), text), text).type("USES").select("src", "dst", "confidence")


@REGISTRY.query("cypher_copy", "SELECT 'Section:' || s_suppkey AS id, 'Section' AS label, s_name AS name FROM supplier")
def cypher_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files become nodes of a label; rows whose id exists are refused."""
    g = code_graph(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/copied-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier")
    new = s.select(F.concat(F.lit("Section:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"))
    new.unionByName(s.select(F.concat(F.lit("Class:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("refused").alias("name"))).write.parquet(path)
    return update(g, f"COPY Section FROM '{path}'").label("Section").select("id", "label", "name")


@REGISTRY.query("write_guard", "SELECT p_partkey, p_partkey % 6 IN (1, 2, 5) AS writes FROM part")
def write_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements made of names: which of them would write. Words in strings, labels and parts of words don't count."""
    name = F.replace("p_name", F.lit("'"), F.lit(""))
    made = [
        F.concat(F.lit("MATCH (n:Function) WHERE n.name = 'create "), name, F.lit("' RETURN n.id AS id")), F.concat(F.lit("MATCH (n) SET n.name = '"), name, F.lit("'")), F.concat(F.lit("match (n {name: '"), name, F.lit("'}) detach\ndelete n")),
        F.concat(F.lit("MATCH (n:Set)-[:CREATE]->(m) RETURN n.id AS `"), name, F.lit("`")), F.lit("MATCH (n) RETURN n.offset AS reset, n.created AS x"), F.concat(F.lit("COPY File FROM '"), name, F.lit("'")),
    ]
    text = F.element_at(F.array(*made), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", predicates.writes(text).alias("writes"))
