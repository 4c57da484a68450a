"""Reports, composite searches and maintenance of the whole code graph, each by its library function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frameworks, predicates, risk
from ..model import Graph, first_writer_wins
from ..operators import analytics, composite, embedding, impact, incremental, reports, structure, traverse
from .code_graph import CODE_SQL, code_graph
from .registry import Registry

REGISTRY = Registry()


def query(name: str, sql: str):
    return REGISTRY.query(name, f"WITH {CODE_SQL} {sql}")


_EDGE_COUNTS = "SELECT 'node' AS kind, label AS name, count(*)::BIGINT AS n FROM {nodes} GROUP BY label UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM {edges} GROUP BY type"


# ---- symbols and their surroundings

_SCORE = "least(1.0, 0.5 + CASE WHEN contains(lower(\"filePath\"), 'src/m1') THEN 0.4 ELSE 0 END + {kind})::DOUBLE"


@query("symbol_candidates", f"SELECT id, round({_SCORE.format(kind='0.06')}, 6) AS score FROM n WHERE label = 'Function' AND name = 'economy_7'")
def symbol_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates for a name with a path hint, by their kind's priority."""
    return reports.symbol_candidates(code_graph(spark, sf_dir).nodes, "economy_7", file_path="src/m1").select("id", F.round("score", 6).alias("score"))


@query("symbol_candidates_of_kind", f"SELECT id, round({_SCORE.format(kind='0.2')}, 6) AS score FROM n WHERE label = 'Function' AND name = 'economy_7'")
def symbol_candidates_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.symbol_candidates(code_graph(spark, sf_dir).nodes, "economy_7", file_path="src/m1", kind="Function").select("id", F.round("score", 6).alias("score"))


def _side(near: str, far: str, name: str) -> str:
    return f"SELECT id, '{name}' AS side, rel, string_agg(other, ',' ORDER BY other) AS refs FROM (SELECT {near} AS id, lower(type) AS rel, {far} AS other FROM e WHERE type NOT IN ('STEP_IN_PROCESS', 'MEMBER_OF') AND {near} IN (SELECT id FROM n WHERE label = 'Function') QUALIFY row_number() OVER (PARTITION BY {near}, type ORDER BY {far}) <= 30) GROUP BY id, rel"


@query("symbol_context", f"{_side('dst', 'src', 'incoming')} UNION ALL {_side('src', 'dst', 'outgoing')} UNION ALL SELECT src, 'process', 'step', string_agg(DISTINCT dst, ',' ORDER BY dst) FROM e WHERE type = 'STEP_IN_PROCESS' GROUP BY src")
def symbol_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of every function in both directions, and its processes."""
    g = code_graph(spark, sf_dir)
    found = reports.context(g, g.label("Function").select("id"))
    side = lambda c: found.select("id", F.lit(c).alias("side"), F.explode(c).alias("rel", "refs")).select("id", "side", "rel", F.array_join("refs", ",").alias("refs"))
    flows = found.where("processes IS NOT NULL").select("id", F.lit("process").alias("side"), F.lit("step").alias("rel"), F.array_join("processes", ",").alias("refs"))
    return side("incoming").unionByName(side("outgoing")).unionByName(flows)


@query("cluster_members", "SELECT DISTINCT f.id, f.name FROM e JOIN n c ON c.id = e.dst JOIN n f ON f.id = e.src WHERE e.type = 'MEMBER_OF' AND c.\"heuristicLabel\" = 'region_2' ORDER BY f.id LIMIT 30")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cluster_detail(code_graph(spark, sf_dir), "region_2").select("id", "name")


@query("process_detail", "SELECT e.dst AS process, e.step, f.name, f.\"filePath\" FROM e JOIN n f ON f.id = e.src WHERE e.type = 'STEP_IN_PROCESS' AND e.dst = 'proc_Brand_13'")
def process_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.process_detail(code_graph(spark, sf_dir), "Brand_13").select(F.col("dst").alias("process"), "step", "name", "filePath")


@query("files_with_exports", "SELECT \"filePath\", count(*)::INT AS symbols, string_agg(name || ':' || label, ',' ORDER BY name, label) AS names FROM n WHERE \"isExported\" GROUP BY \"filePath\"")
def files_with_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.files_with_exports(code_graph(spark, sf_dir).nodes)
    return found.select("filePath", F.size("symbols").alias("symbols"), F.array_join(F.transform("symbols", lambda s: F.concat_ws(":", s["name"], s["label"])), ",").alias("names"))


_CALLS = 'SELECT DISTINCT a."filePath" AS from_file, a.name AS from_name, b."filePath" AS to_file, b.name AS to_name FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE e.type = \'CALLS\' AND a."filePath" <> b."filePath"'


@query("inter_file_calls", _CALLS)
def inter_file_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.inter_file_calls(code_graph(spark, sf_dir))


_IN_M3 = "{c} LIKE 'src/m3/%'"


@query(
    "module_calls",
    f", c AS ({_CALLS}), o AS (SELECT 'incoming' AS kind, * FROM c WHERE to_file LIKE 'src/m3/%' AND from_file NOT LIKE 'src/m3/%' ORDER BY from_file, from_name, to_file, to_name LIMIT 30), u AS (SELECT 'outgoing' AS kind, * FROM c WHERE from_file LIKE 'src/m3/%' AND to_file NOT LIKE 'src/m3/%' ORDER BY from_file, from_name, to_file, to_name LIMIT 30) SELECT 'intra' AS kind, * FROM c WHERE from_file LIKE 'src/m3/%' AND to_file LIKE 'src/m3/%' UNION ALL SELECT * FROM o UNION ALL SELECT * FROM u",
)
def module_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls inside, into and out of one folder."""
    g = code_graph(spark, sf_dir)
    parts = reports.module_calls(g, g.label("File").where("filePath LIKE 'src/m3/%'"))
    out = [df.withColumn("kind", F.lit(kind)).select("kind", "from_file", "from_name", "to_file", "to_name") for kind, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("tool_map", "SELECT c.id, c.content AS description, h.handlers, f.flows FROM n c LEFT JOIN (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS handlers FROM e WHERE type = 'HAS_METHOD' GROUP BY src) h ON h.src = c.id LEFT JOIN (SELECT m.src, string_agg(DISTINCT s.dst, ',' ORDER BY s.dst) AS flows FROM e m JOIN e s ON s.src = m.dst AND s.type = 'STEP_IN_PROCESS' WHERE m.type = 'HAS_METHOD' GROUP BY m.src) f ON f.src = c.id WHERE c.label = 'Class'")
def tool_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes as tools, their methods as handlers."""
    g = code_graph(spark, sf_dir)
    tools = g.label("Class").select("id", "name", "filePath", F.col("content").alias("description"))
    handlers = g.type("HAS_METHOD").select(F.col("src").alias("id"), F.col("dst").alias("handler"))
    flows = handlers.join(g.type("STEP_IN_PROCESS").select(F.col("src").alias("handler"), F.col("dst").alias("process")), "handler").select("id", "process")
    return reports.tool_map(tools, handlers, flows).select("id", "description", F.array_join("handlers", ",").alias("handlers"), F.array_join("flows", ",").alias("flows"))


@query("route_map", "SELECT p.id, coalesce(count(s.src), 0)::INT AS n_consumers, string_agg(s.src, ',' ORDER BY s.src) AS consumers FROM n p LEFT JOIN e s ON s.dst = p.id AND s.type = 'STEP_IN_PROCESS' WHERE p.label = 'Process' GROUP BY p.id")
def route_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes as routes, their steps as consumers."""
    g = code_graph(spark, sf_dir)
    fetches = g.type("STEP_IN_PROCESS").select(F.col("dst").alias("route"), F.col("src").alias("consumer"), F.lit("keys:a").alias("reason"))
    found = reports.route_map(g.label("Process").select("id", "name"), fetches)
    return found.select("id", F.col("n_consumers").cast("int").alias("n_consumers"), F.array_join(F.transform("consumers", lambda c: c["consumer"]), ",").alias("consumers"))


@query("graph_consistency", ", k AS (SELECT 'label' AS what, label AS key, count(*)::BIGINT AS n FROM n WHERE label IN ('Community', 'Process') GROUP BY label UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM e WHERE type IN ('MEMBER_OF', 'STEP_IN_PROCESS') GROUP BY type) SELECT what, key, n AS left_n, 0::BIGINT AS right_n FROM k")
def graph_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph against itself without what is derived."""
    g = code_graph(spark, sf_dir)
    return reports.consistency(g, structure.drop_derived(g)).where("key IS NOT NULL")


@query("list_repos", "SELECT a.id AS path, string_agg(b.id, ',' ORDER BY b.id) AS siblings FROM n a LEFT JOIN n b ON a.name = b.name AND a.id <> b.id AND b.label = 'Function' WHERE a.label = 'Function' GROUP BY a.id")
def list_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions as clones, their names as remotes."""
    g = code_graph(spark, sf_dir)
    f = g.label("Function").select(F.col("id").alias("path"), F.col("name").alias("remoteUrl"))
    return reports.list_repos(f, g.tasks).select("path", F.array_join("siblings", ",").alias("siblings"))


# ---- search over the graph

_TERMS = ["cold", "economy"]
_HITS = r""", tk AS (SELECT id, label, "filePath", regexp_extract_all(lower(concat_ws(' ', name, content)), '[a-z0-9_]+') AS w FROM n WHERE label IN ('File', 'Function', 'Class')),
st AS (SELECT label, count(*) AS c, avg(len(w)) AS a FROM tk GROUP BY label),
tf AS (SELECT id, tk.label, "filePath", len(w) AS dl, t, len(list_filter(w, lambda x: x = t))::DOUBLE AS f FROM tk, (SELECT unnest(['cold', 'economy']) AS t)),
df AS (SELECT label, t, count(*) FILTER (f > 0) AS d FROM tf GROUP BY ALL),
hit AS (SELECT id, tf.label, "filePath", sum(ln(1 + (c - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))) AS score FROM tf JOIN df USING (label, t) JOIN st USING (label) GROUP BY ALL HAVING count(*) FILTER (f > 0) > 0),
fh AS (SELECT "filePath", round(sum(score), 9) AS score, string_agg(id, ',' ORDER BY id) AS node_ids FROM (SELECT *, row_number() OVER (PARTITION BY "filePath" ORDER BY score DESC, id) AS k FROM hit) WHERE k <= 3 GROUP BY "filePath")"""
_ALL = 1_000_000


@query("node_hits", f"{_HITS} SELECT id, label, round(score, 9) AS score FROM hit")
def node_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with an index for each label."""
    return composite.node_hits(code_graph(spark, sf_dir), _TERMS, _ALL).select("id", "label", F.round("score", 9).alias("score"))


@query("file_hits", f'{_HITS} SELECT "filePath", score, node_ids, row_number() OVER (ORDER BY score DESC, "filePath")::INT AS rank FROM fh')
def file_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the sum of their three best nodes."""
    found = composite.file_hits(composite.node_hits(code_graph(spark, sf_dir), _TERMS, _ALL), _ALL)
    return found.select("filePath", "score", F.array_join("node_ids", ",").alias("node_ids"), "rank")


@query("symbol_hits", f'{_HITS}, s AS (SELECT unnest(string_split(node_ids, \',\')) AS id, "filePath", score FROM fh) SELECT id, "filePath", score FROM s JOIN n USING (id, "filePath") WHERE label <> \'File\' ORDER BY score DESC, id LIMIT 1000')
def symbol_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    return composite.symbol_hits(g, composite.file_hits(composite.node_hits(g, _TERMS, _ALL), _ALL)).select("id", "filePath", "score")


@query("symbol_search", f'{_HITS}, s AS (SELECT unnest(string_split(node_ids, \',\')) AS id, score FROM fh), r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s JOIN n USING (id) WHERE label <> \'File\') SELECT id, round(1.0 / (59 + rank), 9) AS score, \'bm25\' AS sources FROM r WHERE rank <= 50')
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text list alone, fused at symbol level."""
    g = code_graph(spark, sf_dir)
    files = composite.file_hits(composite.node_hits(g, _TERMS, _ALL), _ALL)
    ranked = composite.symbol_hits(g, files).select("id", "rank")
    return composite.rrf({"bm25": ranked}, "id", 0, 50).select("id", F.round("score", 9).alias("score"), "sources")


_SOME = """, h AS (SELECT id, round(("startLine" % 97) / 97.0 + 0.01, 6) AS score FROM n WHERE label IN ('Function', 'Class')),
co AS (SELECT src AS id, max(cohesion) AS cohesion FROM e JOIN n ON n.id = dst WHERE type = 'MEMBER_OF' GROUP BY src), sp AS (SELECT src AS id, dst AS process, step FROM e WHERE type = 'STEP_IN_PROCESS'),
pr AS (SELECT process, round(sum(score) + 0.1 * coalesce(max(cohesion), 0), 6) AS priority, count(DISTINCT h.id)::BIGINT AS n_symbols FROM h JOIN sp USING (id) LEFT JOIN co USING (id) GROUP BY process)"""


def _process_query(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = code_graph(spark, sf_dir)
    hits = g.label("Function", "Class").select("id", F.round((F.col("startLine") % 97) / 97 + 0.01, 6).alias("score"))
    return composite.process_query(g, hits, 1_000)


@query("process_query", f"{_SOME} SELECT * FROM pr")
def process_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes by the summed score of their hits and a tenth of the best cohesion."""
    return _process_query(spark, sf_dir)[0].select("process", F.round("priority", 6).alias("priority"), "n_symbols")


@query("process_symbols", f"{_SOME} SELECT id, process, step, score FROM h JOIN sp USING (id) QUALIFY row_number() OVER (PARTITION BY process ORDER BY score DESC, id) <= 10")
def process_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ten hits of each process."""
    return _process_query(spark, sf_dir)[1].select("id", "process", "step", "score")


@query("standalone_definitions", f"{_SOME} SELECT id, label, h.score FROM h JOIN n USING (id) WHERE id NOT IN (SELECT id FROM sp) ORDER BY h.score DESC, id LIMIT 20")
def standalone_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits without a process: at most twenty."""
    return _process_query(spark, sf_dir)[2].select("id", "label", "score")


def _near(near: str, far: str, name: str, k: int) -> str:
    return f"(SELECT id, string_agg(other, ',' ORDER BY other) AS {name} FROM (SELECT {near} AS id, {far} AS other FROM e WHERE type = 'CALLS' QUALIFY row_number() OVER (PARTITION BY {near} ORDER BY {far}) <= {k}) GROUP BY id)"


@query("semantic_context", f"SELECT f.id, r.callers, c.callees, m.cluster, p.processes FROM n f LEFT JOIN {_near('dst', 'src', 'callers', 5)} r USING (id) LEFT JOIN {_near('src', 'dst', 'callees', 5)} c USING (id) LEFT JOIN (SELECT src AS id, min(dst) AS cluster FROM e WHERE type = 'MEMBER_OF' GROUP BY src) m USING (id) LEFT JOIN (SELECT src AS id, string_agg(DISTINCT dst, ',' ORDER BY dst) AS processes FROM e WHERE type = 'STEP_IN_PROCESS' GROUP BY src) p USING (id) WHERE f.label = 'Function'")
def semantic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with up to five callers and callees, their cluster and their processes."""
    g = code_graph(spark, sf_dir)
    found = composite.enrich(g, g.label("Function").select("id"))
    return found.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), "cluster", F.array_join("processes", ",").alias("processes"))


@query("pattern_augmentation", f"""{_HITS}, t AS (SELECT * FROM (SELECT id, label, "filePath", score, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS k FROM hit) WHERE k <= 10),
f AS (SELECT "filePath", round(sum(score), 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY "filePath" ORDER BY score DESC, id) AS j FROM t) WHERE j <= 3 GROUP BY "filePath" ORDER BY 2 DESC, 1 LIMIT 5),
s AS (SELECT id, name, f.score FROM n JOIN f USING ("filePath") WHERE contains(lower(name), 'economy') AND label = 'Function' QUALIFY row_number() OVER (PARTITION BY "filePath" ORDER BY id) <= 3)
SELECT s.id, s.name, s.score, r.callers, c.callees, cohesion FROM s LEFT JOIN {_near('dst', 'src', 'callers', 3)} r USING (id) LEFT JOIN {_near('src', 'dst', 'callees', 3)} c USING (id) LEFT JOIN (SELECT src AS id, max(cohesion) AS cohesion FROM e JOIN n ON n.id = dst WHERE type = 'MEMBER_OF' GROUP BY src) k USING (id)""")
def pattern_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that a search pattern most likely means, with their surroundings."""
    found = composite.augment(code_graph(spark, sf_dir), "Economy cold")
    return found.select("id", "name", "score", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"), "cohesion")


# ---- impact with a graph's own types

_REACH = """RECURSIVE {code}, s AS (SELECT id FROM n WHERE label = 'Class' AND name = 'Supplier#000000003'),
x AS (SELECT id FROM s UNION SELECT src FROM e WHERE type = 'DEFINES' AND dst IN (SELECT id FROM s)),
g AS (SELECT src, dst FROM e WHERE type IN ('CALLS', 'EXTENDS', 'HAS_METHOD') AND confidence >= 0.9), r AS (SELECT id, 0 AS depth FROM x UNION SELECT {far}, depth + 1 FROM r JOIN g ON {near} = id WHERE depth < 2)
SELECT id, min(depth)::INT AS depth FROM r GROUP BY id HAVING min(depth) > 0"""


def _uid_impact(spark: SparkSession, sf_dir: str, direction: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    seeds = impact.class_seeds(g, g.label("Class").where("name = 'Supplier#000000003'").select("id"))
    return impact.impact(g, seeds, direction, 2, ["CALLS", "EXTENDS", "HAS_METHOD"], confidence=0.9, default_types=impact.DEFAULT_BY_UID).select("id", "depth")


@REGISTRY.query("impact_by_uid", f"WITH {_REACH.format(code=CODE_SQL, near='src', far='dst')}")
def impact_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a class, its file and its properties depend on, two steps far."""
    return _uid_impact(spark, sf_dir, "downstream")


# ---- maintenance

_KEEP = "n.label IN ('Class', 'Community', 'Process')"


@query("insert_nodes", "SELECT id, name, label FROM n UNION ALL SELECT DISTINCT 'Route:' || name, name, 'Route' FROM n WHERE label = 'Function'")
def insert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New routes beside old classes that stay as they are."""
    g = code_graph(spark, sf_dir)
    routes = g.label("Function").select(F.concat(F.lit("Route:"), "name").alias("id"), "name", F.lit("Route").alias("label"))
    stale = g.label("Class").select("id", F.lit("never").alias("name"), F.lit("Class").alias("label"))
    return structure.insert_nodes(g, routes.unionByName(stale)).nodes.select("id", "name", "label")


@query("upsert_nodes", "SELECT id, CASE WHEN label = 'Class' THEN upper(name) ELSE name END AS name, label FROM n UNION ALL SELECT 'Class:new', 'new', 'Class'")
def upsert_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    rows = g.label("Class").select("id", F.upper("name").alias("name"), "label").unionByName(spark.createDataFrame([("Class:new", "new", "Class")], "id string, name string, label string"))
    return structure.upsert_nodes(g, rows).nodes.select("id", "name", "label")


@query("delete_files", ", gone AS (SELECT id FROM n WHERE \"filePath\" LIKE 'src/m1%'), n2 AS (SELECT * FROM n WHERE id NOT IN (SELECT id FROM gone)), e2 AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)) " + _EDGE_COUNTS.format(nodes="n2", edges="e2"))
def delete_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    return structure.stats(structure.delete_files(g, g.label("File").where("filePath LIKE 'src/m1%'").select("filePath")))


@query("drop_derived", _EDGE_COUNTS.format(nodes="(SELECT * FROM n WHERE label NOT IN ('Community', 'Process'))", edges="(SELECT * FROM e WHERE type NOT IN ('MEMBER_OF', 'STEP_IN_PROCESS'))"))
def drop_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.stats(structure.drop_derived(code_graph(spark, sf_dir)))


@query("update_contents", "SELECT id, CASE WHEN label = 'Class' THEN 'new ' || content ELSE content END AS content FROM n")
def update_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    return structure.update_contents(g, g.label("Class").select("id", F.concat(F.lit("new "), "content").alias("content"))).nodes.select("id", "content")


@query("split_by_labels", "SELECT a.label AS from_label, b.label AS to_label, (a.label <> 'Class' AND b.label <> 'Class') AS kept, count(*)::BIGINT AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY ALL")
def split_by_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by their label pair; those of a label without a table are set apart."""
    kept, left = structure.split_by_labels(code_graph(spark, sf_dir).edges, ["File", "Function", "Community", "Process"])
    return kept.withColumn("kept", F.lit(True)).unionByName(left.withColumn("kept", F.lit(False))).groupBy("from_label", "to_label", "kept").agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_edges", "SELECT a.\"filePath\" AS src, b.\"filePath\" AS dst, e.type, max(e.confidence) AS confidence FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type = 'CALLS' GROUP BY ALL")
def dedupe_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls lifted to files: one edge a pair, the most confident."""
    g = code_graph(spark, sf_dir)
    a, b = (g.nodes.select(F.col("id").alias(c), F.col("filePath").alias(f"{c}_file")) for c in ("src", "dst"))
    lifted = g.type("CALLS").join(a, "src").join(b, "dst").select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), "type", "confidence", "reason", "step")
    return structure.dedupe_edges(lifted).select("src", "dst", "type", "confidence")


@query("first_writer", "SELECT name, min(\"startLine\" * 1000000 + substr(id, 10)::BIGINT) AS seq FROM n WHERE label = 'Function' GROUP BY name")
def first_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of functions of one name the one inserted first stays."""
    f = code_graph(spark, sf_dir).label("Function").select("name", (F.col("startLine") * 1_000_000 + F.substr("id", F.lit(10)).cast("long")).alias("seq"))
    return first_writer_wins(f, "name", "seq")


@query("changed_subgraph", ", p AS (SELECT \"filePath\" AS path FROM n WHERE label = 'File' AND \"filePath\" LIKE 'src/m7/%'), own AS (SELECT id FROM n WHERE \"filePath\" IN (SELECT path FROM p)), n2 AS (SELECT * FROM n WHERE id IN (SELECT id FROM own) OR label IN ('Community', 'Process')), e2 AS (SELECT DISTINCT src, dst, type FROM e WHERE (src IN (SELECT id FROM own) OR dst IN (SELECT id FROM own)) AND src IN (SELECT id FROM n2) AND dst IN (SELECT id FROM n2)) " + _EDGE_COUNTS.format(nodes="n2", edges="e2"))
def changed_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    return structure.stats(incremental.changed_subgraph(g, g.label("File").where("filePath LIKE 'src/m7/%'").select(F.col("filePath").alias("path"))))


# ---- predicates over every edge and path


@query("relation_filter", "SELECT type, count(*)::BIGINT AS n FROM e WHERE type IN ('CALLS', 'EXTENDS') GROUP BY type")
def relation_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = predicates.relation_filter(code_graph(spark, sf_dir).edges, ["CALLS", "EXTENDS", "SECRET"], impact.ALLOWED, impact.DEFAULT_BY_NAME)
    return e.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("confidence_floor", "SELECT src, dst FROM e WHERE confidence >= 0.95 AND type = 'CALLS'")
def confidence_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.min_confidence(code_graph(spark, sf_dir).type("CALLS"), 0.95).select("src", "dst")


@query("path_predicates", "SELECT \"filePath\" AS path, (\"filePath\" LIKE 'src/m4/%') AS in_m4, regexp_matches(\"filePath\", '^src/m12/[^/]*$') AS in_package, 1.0::DOUBLE AS framework FROM n WHERE label = 'File'")
def path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Service prefix, package directory and framework rules for every file."""
    f = code_graph(spark, sf_dir).label("File").select(F.col("filePath").alias("path"))
    return f.select("path", predicates.in_subgroup("path", "src/m4").alias("in_m4"), predicates.in_package_dir("path", "m12").alias("in_package"), frameworks.path_multiplier("path").alias("framework"))


@query("callable_candidates", "SELECT a.id FROM n a WHERE a.label = 'Function' AND (\"startLine\" % 7 BETWEEN 2 AND 4 OR \"startLine\" % 5 = 0)")
def callable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with an arity between two and four, or a target of unknown arity."""
    f = code_graph(spark, sf_dir).label("Function", "File")
    total = F.when(F.col("startLine") % 5 != 0, F.lit(4))
    return f.where(predicates.callable_candidate(F.col("label"), ["Function", "Method"], F.lit(2), total, (F.col("startLine") % 7).cast("int"))).select("id")


@query("change_risk_classes", ", t AS (SELECT src AS id, count(DISTINCT dst) AS c FROM e WHERE type = 'CALLS' GROUP BY src) SELECT id, CASE WHEN c <= 5 THEN 'medium' WHEN c <= 15 THEN 'high' ELSE 'critical' END AS risk FROM t")
def change_risk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of a change by the number of processes it reaches, here of callees."""
    t = code_graph(spark, sf_dir).type("CALLS").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("c"))
    return t.select("id", risk.change_risk(F.col("c")).alias("risk"))


@query("merged_risk_classes", ", t AS (SELECT src AS id, count(*) AS c, max(confidence) AS best FROM e WHERE type = 'CALLS' GROUP BY src) SELECT id, CASE WHEN c >= 3 THEN 'CRITICAL' WHEN best >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS risk FROM t")
def merged_risk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = code_graph(spark, sf_dir).type("CALLS").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("c"), F.max("confidence").alias("best"))
    return t.select("id", risk.merged_risk(F.lit("LOW"), F.col("c"), F.col("best")).alias("risk"))


# ---- entry points, communities, embeddings

_ENTRY = """, o AS (SELECT src AS id, count(*) AS callees FROM e WHERE type = 'CALLS' GROUP BY src), i AS (SELECT dst AS id, count(*) AS callers FROM e WHERE type = 'CALLS' GROUP BY dst),
en AS (SELECT id, round(callees / (coalesce(callers, 0) + 1.0) * CASE WHEN "isExported" THEN 2.0 ELSE 1.0 END, 6) AS score, callees, coalesce(callers, 0) AS callers FROM n JOIN o USING (id) LEFT JOIN i USING (id))"""


@query("entry_points_top", f"{_ENTRY} SELECT id, score, callees, callers FROM en ORDER BY score DESC, id LIMIT 200")
def entry_points_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred best entry points of all functions."""
    g = code_graph(spark, sf_dir)
    return analytics.entry_points(g.nodes, g.type("CALLS"), 200).select("id", F.round("score", 6).alias("score"), "callees", "callers")


@query("community_nodes", ", m AS (SELECT src AS id, dst AS comm FROM e WHERE type = 'MEMBER_OF'), b AS (SELECT src AS a, dst AS b FROM e WHERE type = 'CALLS' UNION SELECT dst, src FROM e WHERE type = 'CALLS'), c AS (SELECT x.comm, avg((x.comm = y.comm)::INT) AS c FROM b JOIN m x ON b.a = x.id JOIN m y ON b.b = y.id GROUP BY x.comm), s AS (SELECT comm, count(*)::BIGINT AS symbols FROM m GROUP BY comm), f0 AS (SELECT comm, string_split(\"filePath\", '/')[2] AS folder, count(*) AS k FROM m JOIN n USING (id) GROUP BY ALL), f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY comm ORDER BY k DESC, folder) = 1) SELECT comm, symbols, 'M' || substr(folder, 2) AS label FROM s JOIN f USING (comm) WHERE symbols >= 2")
def community_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities named by their most frequent folder."""
    g = code_graph(spark, sf_dir)
    members = g.type("MEMBER_OF").select(F.col("src").alias("id"), F.col("dst").alias("comm"))
    return analytics.community_nodes(members, g.label("Function").select("id", "filePath", "name"), g.type("CALLS")).select("comm", "symbols", "label")


@query("embedding_inputs", "SELECT id, md5(label || ': ' || name || chr(10) || 'Path: ' || \"filePath\" || chr(10) || CASE WHEN label = 'Class' AND members IS NOT NULL THEN 'Members: ' || members || chr(10) ELSE '' END || chr(10) || content) AS text_md5, sha1('v1' || content) AS hash FROM n LEFT JOIN (SELECT src AS id, string_agg(DISTINCT name, ', ' ORDER BY name) AS members FROM (SELECT e.src, f.name FROM e JOIN n f ON f.id = e.dst WHERE e.type = 'HAS_METHOD') GROUP BY src) USING (id) WHERE label IN ('Function', 'Class') AND content IS NOT NULL")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and hash that each symbol is embedded by, members of classes included."""
    return embedding.embedding_inputs(code_graph(spark, sf_dir)).select("id", F.md5("text").alias("text_md5"), "hash")


@query("embeddable_nodes", "SELECT label, count(*)::BIGINT AS n FROM n WHERE label IN ('Function', 'Class') AND content IS NOT NULL GROUP BY label")
def embeddable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embeddable(code_graph(spark, sf_dir)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_embeddings", "SELECT id, sha1('v1' || content) AS hash, CASE WHEN \"startLine\" % 3 = 1 THEN 'kept' ELSE 'new' END AS origin FROM n WHERE label = 'Function'")
def incremental_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the stored rows still has its hash; changed and missing ones are embedded anew."""
    inputs = embedding.embedding_inputs(code_graph(spark, sf_dir)).where("id LIKE 'Function:%'")
    lines = code_graph(spark, sf_dir).label("Function").select("id", "startLine")
    stored = inputs.join(lines, "id").where("startLine % 3 <> 2").select("id", F.when(F.col("startLine") % 3 == 1, F.col("hash")).otherwise("stale").alias("hash"), F.lit("kept").alias("embedding"))
    return embedding.incremental_embeddings(inputs, stored, lambda _: F.lit("new")).select("id", "hash", F.col("embedding").alias("origin"))


@query("include_closure", "SELECT src AS seed, dst AS id, 1 AS depth, 1 AS position FROM e WHERE type = 'EXTENDS'")
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class with all that its base chain includes."""
    e = code_graph(spark, sf_dir).type("EXTENDS")
    return traverse.include_closure(e, e.select(F.col("src").alias("id")))
