"""Resolution, maintenance of incremental state, scanners and parsers as queries over whole tables.

Scanner queries write each row of a table as a small source text and compare what is found with the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import extract, predicates, text
from ..model import Graph
from ..operators import analytics, composite, contracts, embedding, incremental, resolution
from ..session import ensure_checkpoint_dir
from ..sources import brace_parsers, parsers, repo, sinks
from ..sources.tables import table
from .code_graph import CODE_SQL, code_graph
from .registry import Registry
from .report_queries import CONTRACTS_SQL, page_contracts

REGISTRY = Registry()
plain = REGISTRY.query


def query(name: str, sql: str, recursive: bool = False):
    return REGISTRY.query(name, f"WITH {'RECURSIVE ' if recursive else ''}{CODE_SQL} {sql}")


def _s(*parts) -> Column:
    """Literals and columns put together as a text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- resolution


@plain(
    "reexport_chain",
    """WITH RECURSIVE b AS (SELECT p_brand AS file, row_number() OVER (ORDER BY p_brand) AS k, lead(p_brand) OVER (ORDER BY p_brand) AS nxt FROM (SELECT DISTINCT p_brand FROM part)), t AS (SELECT DISTINCT p_type AS name FROM part),
d AS (SELECT p_brand AS file, p_type AS name, min(p_partkey) AS id FROM part JOIN b ON file = p_brand WHERE k % 4 = 0 GROUP BY ALL),
r AS (SELECT file AS origin, name, nxt AS place, 1 AS hops FROM b, t WHERE nxt IS NOT NULL UNION ALL SELECT origin, name, b.nxt, hops + 1 FROM r JOIN b ON b.file = place WHERE hops < 5 AND b.nxt IS NOT NULL),
h AS (SELECT origin AS file, r.name AS local, id, hops FROM r JOIN d ON d.file = place AND d.name = r.name) SELECT * FROM h QUALIFY rank() OVER (PARTITION BY file, local ORDER BY hops) = 1""",
)
def reexport_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand re-exports the next one's types; every fourth defines its own."""
    p = table(spark, sf_dir, "part")
    w = Window.orderBy("file")  # the brands, a handful
    b = p.select(F.col("p_brand").alias("file")).distinct().withColumn("k", F.row_number().over(w)).withColumn("source", F.lead("file").over(w))
    t = p.select(F.col("p_type").alias("local")).distinct()
    imports = b.where("source IS NOT NULL").select("file", "source").join(F.broadcast(t)).withColumn("exported", F.col("local"))  # a handful of types
    defs = p.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).join(b.where("k % 4 = 0").select("file"), "file", "left_semi")
    return resolution.reexport_chain(imports, defs)


@query("suffix_imports", """, f AS (SELECT DISTINCT path FROM fn), c AS (SELECT a.path AS file, 'f3' AS spec, b.path AS target FROM f a JOIN f b ON a.path <> b.path AND b.path LIKE '%/f3.ts' UNION ALL SELECT a.path, '../m12/f4', b.path FROM f a JOIN f b ON a.path <> b.path AND b.path = 'src/m12/f4.ts')
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY file, spec ORDER BY length(target), target) = 1""")
def suffix_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file imports an ambiguous and a full suffix: the shortest path wins."""
    files = code_graph(spark, sf_dir).label("Function").select(F.col("filePath").alias("path")).distinct()
    imports = files.select(F.col("path").alias("file"), F.explode(F.array(F.lit("f3"), F.lit("../m12/f4"))).alias("spec"))
    return resolution.suffix_imports(imports, files, [".js", ".ts", "/index.ts"])


@query("interface_dispatch", """, m AS (SELECT e.dst AS id, e.src AS owner, n.name FROM e JOIN n ON n.id = e.dst WHERE e.type = 'HAS_METHOD'), h AS (SELECT src AS child, dst AS parent FROM e WHERE type = 'EXTENDS'),
c AS (SELECT DISTINCT dst AS id FROM e WHERE type = 'CALLS') SELECT c.id AS site, x.id, 0.7::DOUBLE AS confidence FROM c JOIN m USING (id) JOIN h ON h.parent = m.owner JOIN m x ON x.owner = h.child AND x.name = m.name WHERE x.id <> c.id GROUP BY ALL""")
def interface_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of a base class's method also reach that name in the classes that implement it."""
    g = code_graph(spark, sf_dir)
    methods = g.type("HAS_METHOD").select(F.col("dst").alias("id"), F.col("src").alias("owner")).join(g.nodes.select("id", "name"), "id")
    calls = g.type("CALLS").select(F.col("dst").alias("site"), F.col("dst").alias("id")).distinct()
    heritage = g.type("EXTENDS").select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit("IMPLEMENTS").alias("kind"))
    return resolution.interface_dispatch(calls, methods, heritage)


_CANDIDATES_SQL = """, k AS (SELECT src AS site, dst AS id, confidence, "startLine" % 3 AS scope_depth, "endLine" % 2 AS mro_depth, CASE WHEN "isExported" THEN 'import' ELSE 'local' END AS origin, "startLine" % 4 AS required FROM e JOIN n ON n.id = e.dst WHERE e.type = 'CALLS')"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir)
    target = g.nodes.select("id", (F.col("startLine") % 3).alias("scope_depth"), (F.col("endLine") % 2).alias("mro_depth"), F.when(F.col("isExported"), "import").otherwise("local").alias("origin"), (F.col("startLine") % 4).alias("required"))
    return g.type("CALLS").select(F.col("src").alias("site"), F.col("dst").alias("id"), "confidence").join(target, "id")


@query("resolution_tie_break", f"{_CANDIDATES_SQL} SELECT site, id FROM k QUALIFY row_number() OVER (PARTITION BY site ORDER BY round(confidence, 3) DESC, scope_depth, mro_depth, CASE origin WHEN 'local' THEN 0 ELSE 1 END, id) = 1")
def resolution_tie_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolution.tie_break(_candidates(spark, sf_dir)).select("site", "id")


@query("overload_narrowing", f"{_CANDIDATES_SQL}, j AS (SELECT *, substr(site, 10)::BIGINT % 6 AS args FROM k), f AS (SELECT *, (args BETWEEN required AND 4)::INT AS fits FROM j) SELECT site, id FROM f QUALIFY fits = max(fits) OVER (PARTITION BY site)")
def overload_narrowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose arity fits the call; all of them where none does."""
    k = _candidates(spark, sf_dir)
    defs = k.select("id", F.lit("Function").alias("kind"), "required", F.lit(4).alias("total")).distinct()
    sites = k.select("site", (F.substr("site", F.lit(10)).cast("long") % 6).alias("arg_count")).distinct()
    return resolution.narrow_overloads(k.select("site", "id"), defs, sites)


@query("resolution_evidence", f"""{_CANDIDATES_SQL} SELECT site, id, round(greatest(0, least(1, CASE origin WHEN 'local' THEN 0.55 ELSE 0.45 END * CASE WHEN required = 3 THEN 0.5 ELSE 1.0 END - 0.02 * scope_depth + CASE mro_depth WHEN 0 THEN 0.5 ELSE 0.42 END + CASE WHEN required > 1 THEN 0.2 ELSE 0 END + CASE WHEN required = 0 THEN 0 WHEN required = 1 THEN 0.1 ELSE -0.15 END)), 6)::DOUBLE AS confidence FROM k""")
def resolution_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence out of origin, distance, MRO depth, owner, arity and link state of every candidate."""
    c, k = F.col, _candidates(spark, sf_dir)
    arity = F.when(c("required") == 1, True).when(c("required") > 1, False)
    score = resolution.evidence(c("origin"), c("scope_depth").cast("int"), c("mro_depth").cast("int"), c("required") > 1, arity, c("required") != 3)
    return k.select("site", "id", F.round(score, 6).alias("confidence"))


@plain("scope_lookup", "WITH RECURSIVE p AS (SELECT p_partkey AS k, p_type AS name FROM part), r AS (SELECT k AS site, k AS scope, name, 0 AS hops FROM p UNION ALL SELECT site, scope // 3, name, hops + 1 FROM r WHERE scope > 0), h AS (SELECT r.site, 'b' || r.scope AS id, hops FROM r JOIN p ON p.k = r.scope AND p.k % 5 = 0 AND p.name = r.name) SELECT site, id, hops FROM h QUALIFY row_number() OVER (PARTITION BY site ORDER BY hops) = 1")
def scope_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as nested scopes (k inside k // 3); every fifth binds its type as a name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("scope"), F.col("p_type").alias("name"))
    scopes = p.select("scope", F.when(F.col("scope") > 0, F.floor(F.col("scope") / 3)).alias("parent"))
    bindings = p.where("scope % 5 = 0").select("scope", "name", _s("b", F.col("scope")).alias("id"))
    return resolution.scope_lookup(p.withColumn("site", F.col("scope")), scopes, bindings)


@plain("type_propagation", "WITH RECURSIVE p AS (SELECT p_partkey AS k FROM part), r AS (SELECT k AS name, k AS place FROM p UNION ALL SELECT name, place // 2 FROM r WHERE place >= 8) SELECT 'v' || name AS name, 'T' || place AS type FROM r WHERE place < 8")
def type_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables take the type of what they are assigned from, up to a fixpoint."""
    k = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    known = k.where("k < 8").select(_s("v", F.col("k")).alias("name"), _s("T", F.col("k")).alias("type"))
    links = k.where("k >= 8").select(_s("v", F.col("k")).alias("name"), _s("v", F.floor(F.col("k") / 2)).alias("source"))
    return resolution.propagate_types(known, links)


@query("call_emission", """, a AS (SELECT src AS site, dst AS id FROM e WHERE type = 'CALLS' AND confidence >= 0.98), b AS (SELECT src AS site, dst AS id FROM e WHERE type = 'CALLS' AND confidence < 0.98 AND src NOT IN (SELECT site FROM a))
SELECT 'file' || (substr(site, 10)::BIGINT % 40) AS src, id AS dst, max(c) AS confidence, min(p)::INT AS pass FROM (SELECT site, id, 0.9 AS c, 0 AS p FROM a UNION ALL SELECT site, id, 0.5, 1 FROM b) GROUP BY ALL""")
def call_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes in order: a site that one pass resolved is closed to the later ones."""
    e = code_graph(spark, sf_dir).type("CALLS")
    sites = e.select(F.col("src").alias("site")).distinct().withColumn("caller", _s("file", F.substr("site", F.lit(10)).cast("long") % 40))
    first = e.where("confidence >= 0.98").select(F.col("src").alias("site"), F.col("dst").alias("id"), F.lit(0.9).alias("confidence"))
    second = e.where("confidence < 0.98").select(F.col("src").alias("site"), F.col("dst").alias("id"), F.lit(0.5).alias("confidence"))
    return resolution.call_edges(sites, [first, second])


@query("heritage_edges", "SELECT src, dst, CASE WHEN substr(dst, 7)::BIGINT % 20 = 0 THEN 'IMPLEMENTS' ELSE 'EXTENDS' END AS type FROM e WHERE type = 'EXTENDS'")
def heritage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second base class is an interface: it is implemented, whatever the source says."""
    g = code_graph(spark, sf_dir)
    kinds = g.label("Class").select("id", F.when(F.substr("id", F.lit(7)).cast("long") % 20 == 0, "Interface").otherwise("Class").alias("label"))
    e = g.type("EXTENDS").withColumn("site", F.concat("src", F.lit(">"), "dst"))
    parents = e.select("site", F.col("src").alias("child"), F.lit("EXTENDS").alias("kind"))
    return composite.heritage_edges(parents, e.select("site", F.col("dst").alias("id"), "confidence"), kinds).select("src", "dst", "type")


@query("import_strategies", ", f AS (SELECT DISTINCT path FROM fn) SELECT path AS file, 'x' AS spec, CASE WHEN path LIKE '%/f1%' THEN 'first' WHEN path LIKE 'src/m2%' THEN 'second' END AS target FROM f")
def import_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first strategy that knows an import decides."""
    f = code_graph(spark, sf_dir).label("Function").select(F.col("filePath").alias("file")).distinct().withColumn("spec", F.lit("x"))
    by = lambda like, target: f.where(f"file LIKE '{like}'").withColumn("target", F.lit(target))
    return composite.first_strategy(f, [by("%/f1%", "first"), by("src/m2%", "second")])


@query("process_links", """, p AS (SELECT dst AS process, src AS entry FROM e WHERE type = 'STEP_IN_PROCESS' AND step = 1), x AS (SELECT process, entry, "filePath" AS path FROM p JOIN n ON n.id = entry),
r AS (SELECT id, name, "filePath" AS path FROM n WHERE label = 'Function') SELECT DISTINCT 'Route:' || r.id AS src, process AS dst FROM r JOIN x ON x.path = r.path""")
def process_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes without a known handler are linked by the file that a process starts in."""
    g = code_graph(spark, sf_dir)
    flows = g.type("STEP_IN_PROCESS").where("step = 1").select(F.col("dst").alias("id"), F.col("src").alias("entryPointId"))
    routes = g.label("Function").select(_s("Route:", F.col("id")).alias("id"), F.lit(None).cast("string").alias("handler"), "filePath")
    return composite.link_processes(flows, routes, routes.limit(0), g.nodes).select("src", "dst")


@query("class_dispatch_index", "SELECT src AS child, string_agg(dst, ',' ORDER BY dst) AS mro, 1::INT AS n FROM e WHERE type = 'EXTENDS' GROUP BY src")
def class_dispatch_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir).type("EXTENDS").select(F.col("src").alias("child"), F.col("dst").alias("parent"))
    order, _ = composite.dispatch_index(g.select("child", F.lit(0).alias("pos"), F.col("parent").alias("ancestor")), g.withColumn("kind", F.lit("IMPLEMENTS")))
    return order.select("child", F.array_join("mro", ",").alias("mro"), F.size("mro").alias("n"))


@query("implementors", "SELECT dst AS interface, string_agg(src, ',' ORDER BY src) AS implementors FROM e WHERE type = 'EXTENDS' GROUP BY dst")
def implementors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_graph(spark, sf_dir).type("EXTENDS").select(F.col("src").alias("child"), F.col("dst").alias("parent"), F.lit("IMPLEMENTS").alias("kind"))
    _, found = composite.dispatch_index(g.select("child", F.lit(0).alias("pos"), F.col("parent").alias("ancestor")), g)
    return found.select("interface", F.array_join("implementors", ",").alias("implementors"))


_METHODS_SQL = ", me AS (SELECT e.src AS owner, e.dst AS id, n.name FROM e JOIN n ON n.id = e.dst WHERE e.type = 'HAS_METHOD'), mr AS (SELECT src AS child, dst AS ancestor FROM e WHERE type = 'EXTENDS')"


def _methods(g: Graph) -> tuple[DataFrame, DataFrame]:
    methods = g.type("HAS_METHOD").select(F.col("src").alias("owner"), F.col("dst").alias("id")).join(g.nodes.select("id", "name"), "id")
    return methods, g.type("EXTENDS").select(F.col("src").alias("child"), F.lit(0).alias("pos"), F.col("dst").alias("ancestor"))


@query("method_implements", f"{_METHODS_SQL} SELECT DISTINCT a.id AS src, b.id AS dst, 0.7::DOUBLE AS confidence FROM me a JOIN mr ON mr.child = a.owner JOIN me b ON b.owner = mr.ancestor AND b.name = a.name WHERE a.owner NOT IN (SELECT ancestor FROM mr)")
def method_implements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of classes that fulfil those of their bases of the same name."""
    methods, mro = _methods(code_graph(spark, sf_dir))
    typed = methods.withColumn("parameterTypes", F.lit(None).cast("array<string>")).withColumn("parameterCount", F.lit(None).cast("int")).withColumn("isAbstract", F.lit(False))
    return analytics.method_implements(mro, typed, mro.select(F.col("ancestor").alias("owner")).distinct())


@query("mro_lookup", f"{_METHODS_SQL}, s AS (SELECT c.id AS owner, n.name, c.id || '#' || n.name AS site FROM (SELECT DISTINCT name FROM fn) n, cl c), d AS (SELECT site, me.id AS method, -1 AS pos FROM s JOIN me USING (owner, name) UNION ALL SELECT site, me.id, 0 FROM s JOIN mr ON mr.child = s.owner JOIN me ON me.owner = mr.ancestor AND me.name = s.name) SELECT site, method, pos FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos, method) = 1")
def mro_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every method name on every class: its own, else the base's."""
    g = code_graph(spark, sf_dir)
    methods, mro = _methods(g)
    names = g.label("Function").select("name").distinct()
    sites = g.label("Class").select(F.col("id").alias("owner")).join(F.broadcast(names)).withColumn("site", F.concat_ws("#", "owner", "name"))  # a few hundred names
    return analytics.lookup_with_mro(sites, mro, methods)


# ---- contracts of groups


@plain("contract_links", f"WITH {CONTRACTS_SQL}, l AS (SELECT x.c, x.p FROM (SELECT * FROM exact UNION ALL SELECT * FROM anym UNION ALL SELECT * FROM suf UNION ALL SELECT c, p FROM wl) x JOIN ok ON x.c = ok.c AND x.p = ok.p) SELECT c AS from_symbol_uid, p AS to_symbol_uid, count(*)::BIGINT AS n FROM l GROUP BY ALL")
def contract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of matches together, de-duplicated by their ends."""
    links = contracts.match(page_contracts(spark, sf_dir))
    return links.groupBy("from_symbol_uid", "to_symbol_uid").agg(F.count(F.lit(1)).alias("n"))


@plain("graph_http_contracts", "WITH p AS (SELECT page_id, string_split(string_split(regexp_replace(url, '^https?://[^/?#]*', ''), '#')[1], '?')[1] AS path FROM pages) SELECT 'Page:' || page_id AS symbol_uid, 'http::*::/' || array_to_string(list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{param}' ELSE s END), '/') AS contract_id FROM p")
def graph_http_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as fetches of a graph: consumer contracts of any method."""
    fetches = table(spark, sf_dir, "pages").select(F.lit("r").alias("repo"), _s("Page:", F.col("page_id")).alias("uid"), "url", F.lit(None).cast("string").alias("method"), F.lit("a.ts").alias("filePath"))
    return composite.http_contracts(fetches.limit(0), fetches).select("symbol_uid", "contract_id")


@plain("manifest_links", "SELECT DISTINCT 'manifest::c' || c_nationkey || '::http::GET::/' || c_mktsegment AS from_symbol_uid, 'manifest::p' || c_mktsegment || '::http::GET::/' || c_mktsegment AS to_symbol_uid FROM customer")
def manifest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared links get synthetic ends."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    declared = c.select(_s("c", F.col("c_nationkey")).alias("from_repo"), _s("p", F.col("c_mktsegment")).alias("to_repo"), _s("http::GET::/", F.col("c_mktsegment")).alias("contract_id"), F.lit("http").alias("type"))
    return composite.manifest_links(declared)[1].select("from_symbol_uid", "to_symbol_uid")


@plain("export_rules", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 3 = 0 WHEN 1 THEN c_custkey % 3 <> 0 WHEN 2 THEN c_custkey % 3 = 0 ELSE c_custkey % 3 = 0 END AS exported FROM customer")
def export_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility by language: a keyword, an underscore, a capital."""
    k, third = F.col("c_custkey"), F.col("c_custkey") % 3 == 0
    language = F.element_at(F.array(*[F.lit(x) for x in ("typescript", "python", "go", "rust")]), (k % 4 + 1).cast("int"))
    name = F.when(k % 4 == 1, F.when(third, "_hidden").otherwise("shown")).when(k % 4 == 2, F.when(third, "Shown").otherwise("hidden")).otherwise("name")
    header = F.when(third, F.when(k % 4 == 0, "export function name()").otherwise("pub fn name()")).otherwise("function name()")
    return table(spark, sf_dir, "customer").select("c_custkey", composite.is_exported(language, name, header).alias("exported"))


# ---- incremental state


@plain("shadow_candidates", "SELECT 'src/m' || p_partkey || '.ts' AS path, unnest(['src/m' || p_partkey || '.js', 'src/m' || p_partkey || '/index.ts', 'src/m' || p_partkey || '/index.js']) AS shadowed FROM part")
def shadow_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other spellings that a new file may win over."""
    return incremental.shadow_candidates(table(spark, sf_dir, "part").select(_s("src/m", F.col("p_partkey"), ".ts").alias("path")), [".ts", ".js"])


@plain("fresh_overlays", "SELECT doc_id AS path, md5(text || '!') AS content_md5 FROM documents WHERE text IS NOT NULL AND doc_id % 3 = 0 UNION ALL SELECT doc_id, md5(text) FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0")
def fresh_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of all documents, of which a third is still of the file's state, laid over the files."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.md5("text").alias("hash"))
    edits = d.select("path", F.when(F.col("path") % 3 == 0, F.col("hash")).otherwise("old").alias("hash"), F.concat("content", F.lit("!")).alias("content"))
    fresh = incremental.fresh_overlays(edits, d.select("path", "hash")).dropDuplicates(["path"])
    return incremental.apply_overlays(d.select("path", "content"), fresh).select("path", F.md5("content").alias("content_md5"))


@plain("incremental_write_set", "WITH i AS (SELECT DISTINCT p_partkey AS src, p_partkey // 7 AS dst FROM part WHERE p_partkey > 0), c AS (SELECT p_partkey AS k FROM part WHERE p_name LIKE 'cold%' AND p_partkey > (SELECT max(p_partkey) // 7 FROM part)) SELECT k AS path FROM c")
def incremental_write_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed leaves of an import tree that nothing imports: they alone are written again."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_name")
    top = p.agg(F.max("path")).first()[0]
    diff = p.select("path", F.when(F.col("p_name").startswith("cold") & (F.col("path") > top // 7), "changed").otherwise("unchanged").alias("status"))
    imports = p.where("path > 0").select(F.col("path").alias("src"), F.floor(F.col("path") / 7).alias("dst"))
    paths, reason = incremental.write_set(diff, imports)
    return paths if paths is not None else p.limit(0).select("path").withColumn("reason", F.lit(reason))


@plain("reusable_cache", "SELECT doc_id AS path, CASE WHEN doc_id % 4 = 1 THEN 'reused' ELSE 'made' END AS origin FROM documents WHERE text IS NOT NULL")
def reusable_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored results of files whose hash is still the same; all others are made again."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"))
    cache = d.select("path", F.when(F.col("path") % 4 == 1, F.col("hash")).otherwise("old").alias("hash"))
    hit, miss = sinks.reusable(d, cache)
    return hit.select("path", F.lit("reused").alias("origin")).unionByName(miss.select("path", F.lit("made").alias("origin")))


# ---- texts


@plain("text_scalars", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\r\n', chr(10), 'g'), '\r', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS clean_md5, (length(text) > 0 AND (length(left(text, 1000)) - length(regexp_replace(left(text, 1000), '[\x00-\x08\x0E-\x1F\x7F]', '', 'g'))) / length(left(text, 1000)) > 0.1) AS is_binary, length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) AS line FROM documents WHERE text IS NOT NULL")
def text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters out, the binary test, and the line of an offset, for every text."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.md5(text.sanitize("text")).alias("clean_md5"), text.is_binary("text").alias("is_binary"), text.line_number("text", F.least(F.length("text"), F.lit(500))).cast("long").alias("line"))


@plain("snippets", "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL AND n_chars < 4000) SELECT doc_id, md5(array_to_string(l[greatest(1, 3 - 2 + 1):least(len(l), 5 + 2 + 1)], chr(10))) AS snippet_md5 FROM l")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 3 to 5 with two around them, of all texts below the size of a stored snippet."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL AND n_chars < 4000")
    return d.select("doc_id", F.md5(text.snippet("text", F.lit(3), F.lit(5))).alias("snippet_md5"))


@plain("chunk_hashes", "SELECT source, sha256(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id || ':' || md5(text))) AS chunk_hash FROM documents WHERE text IS NOT NULL GROUP BY source")
def chunk_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address of each source's files by their paths and hashes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", F.col("doc_id").cast("string").alias("path"), F.md5("text").alias("hash"))
    return text.chunk_hash(d, "source")


@plain("declaration_chunks", "SELECT p_partkey AS id, i::INT AS chunk_index, 'void f' || i || '() { ' || p_name || repeat('x', 1150) || ' }' AS chunk FROM part, (SELECT unnest([0, 1, 2]) AS i)")
def declaration_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three declarations a file, each nearly as long as a chunk: they are not cut apart."""
    body = [F.concat(F.lit(f"void f{i}() {{ "), "p_name", F.lit("x" * 1150 + " }")) for i in range(3)]
    files = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws("\n\n", *body).alias("content"))
    return embedding.declaration_chunks(files).select("id", F.col("chunk_index").cast("int").alias("chunk_index"), "chunk")


# ---- scanners


def _files(spark: SparkSession, sf_dir: str, ending: str, *lines) -> DataFrame:
    """A source file for each part, of lines put together from the part's columns."""
    rows = [line if isinstance(line, Column) else F.lit(line) for line in lines]
    return table(spark, sf_dir, "part").select(_s("m", F.col("p_size"), "/p", F.col("p_partkey"), ending).alias("path"), F.concat_ws("\n", *rows).alias("content"))


_PATH = "'m' || p_size || '/p' || p_partkey || '{}'"


def _key() -> Column:
    return F.col("p_partkey")


def _type() -> Column:
    return F.lower(F.col("p_type"))


@plain("markdown_sections", f"SELECT {_PATH.format('.md')} AS path, unnest([1, 2, 2]) AS level, unnest([p_type, 'a', 'b' || p_partkey]) AS title, unnest([1, 3, 8]) AS \"startLine\", unnest([9, 7, 9]) AS \"endLine\" FROM part")
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings outside code fences with the lines they span."""
    f = _files(spark, sf_dir, ".md", _s("# ", F.col("p_type")), "text", "## a", "```", "# no heading", "```", "more", _s("## b", _key()), "end")
    return repo.markdown_sections(f).select("path", F.col("level").cast("int").alias("level"), "title", F.col("startLine").cast("int").alias("startLine"), F.col("endLine").cast("int").alias("endLine"))


@plain("markdown_links", f"SELECT {_PATH.format('.md')} AS src, 'm' || p_size || '/p' || q || '.md' AS dst FROM (SELECT a.p_size, a.p_partkey, b.p_partkey AS q FROM part a JOIN part b ON b.p_partkey = a.p_partkey // 2 AND b.p_size = a.p_size)")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative links, of which only those to files that exist count."""
    return repo.markdown_links(_files(spark, sf_dir, ".md", _s("see [half](./p", F.floor(_key() / 2), ".md) and [web](https://x/y.md)")))


@plain("python_facts", f"SELECT {_PATH.format('.py')} AS path, unnest(['import', 'Class', 'heritage', 'Method', 'call', 'Function']) AS kind, unnest(['os', 'C' || p_partkey, 'Base', 'run', 'helper', 'main']) AS name, unnest([1, 2, 2, 3, 4, 5]) AS \"startLine\" FROM part")
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".py", "import os", _s("class C", _key(), "(Base):"), "    def run(self, a):", "        return helper(a)", "def main(): pass")
    return parsers.parse_python(f).select("path", "kind", "name", "startLine")


@plain("typescript_facts", f"SELECT {_PATH.format('.ts')} AS path, unnest(['import', 'Class', 'heritage', 'Constructor', 'Method', 'call', 'Function', 'call']) AS kind, unnest(['./m' || p_size, 'C' || p_partkey, 'Base', 'constructor', 'run', 'this.helper', 'main', 'C' || p_partkey]) AS name, unnest([NULL, NULL, 'C' || p_partkey, 'C' || p_partkey, 'C' || p_partkey, 'C' || p_partkey || '.run', NULL, 'main']) AS own, unnest([1, 2, 2, 3, 4, 5, 8, 8]) AS \"startLine\" FROM part")
def typescript_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".ts", _s("import { a } from './m", F.col("p_size"), "';"), _s("export class C", _key(), " extends Base {"), "  constructor(x: Map<string, number>) { super(x); }", "  run(a: number): void {", "    this.helper(a, 'fake(1)'); // other(2)", "  }", "}", _s("function main() { return new C", _key(), "(1); }"))
    return brace_parsers.parse_typescript(f).select("path", "kind", "name", F.when(F.col("kind") != "import", F.col("owner")).alias("own"), "startLine")


@plain("typescript_shapes", f"""WITH s AS (SELECT *, {_PATH.format('.ts')} AS path, p_partkey % 4 AS k FROM part),
f AS (SELECT path, unnest(['Function', 'call', 'call']) AS kind, unnest(['k' || p_partkey, 'cb', 'h' || p_size]) AS name, unnest([NULL, 'k' || p_partkey, 'k' || p_partkey]) AS own, unnest([2, 1, 1]) AS n FROM s WHERE k = 0
  UNION ALL SELECT path, unnest(['Function', 'call']), unnest(['q' || p_partkey, 'z']), unnest([NULL, 'q' || p_partkey]), unnest([1, 2]) FROM s WHERE k = 1
  UNION ALL SELECT path, unnest(['Class', 'Method', 'call', 'Method']), unnest(['C' || p_partkey, 'on', 'this.run', 'run']), unnest([NULL, 'C' || p_partkey, 'C' || p_partkey || '.on', 'C' || p_partkey]), unnest([NULL, 1, 1, 2]) FROM s WHERE k = 2
  UNION ALL SELECT path, unnest(['Interface', 'Method', 'Function', 'call', 'call']), unnest(['P', 'area', 'r' || p_size, 'd', 'w']), unnest([NULL, 'P', NULL, 'r' || p_size, 'r' || p_size]), unnest([NULL, 0, 2, 0, 0]) FROM s WHERE k = 3)
SELECT path, kind, name, own, n FROM f""")
def typescript_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four shapes: callbacks and templates, bare arrows, arrows and results of object types in classes, defaults."""
    key, size = _key(), F.col("p_size")
    shape = [
        _s("function k", key, "(cb: (x: number) => void, m: Map<string, number>): void {\n  cb(1); return `a ${h", size, "('x(1)')} b(2)`; }"),
        _s("const q", key, " = x => z(x, '", F.replace("p_name", F.lit("'"), F.lit("")), "');"),
        _s("class C", key, " {\n  on = (e: Event): void => { this.run(e); };\n  run(a: [number, string], b?: () => void): Promise<{ ok: boolean }> { }\n}"),
        _s("interface P { area(): number; }\nconst r", size, " = async (a, b = d()): Promise<void> => { w(/* v(1) */); };"),
    ]
    f = _files(spark, sf_dir, ".ts", F.element_at(F.array(*shape), (key % 4 + 1).cast("int")))
    return brace_parsers.parse_typescript(f).select("path", "kind", "name", F.col("owner").alias("own"), F.col("count").alias("n"))


@plain("java_facts", f"SELECT {_PATH.format('.java')} AS path, unnest(['import', 'Class', 'heritage', 'heritage', 'Method', 'call']) AS kind, unnest(['java.util', 'C' || p_partkey, 'Base', 'Pet', 'run', 'helper']) AS name, unnest([1, 2, 2, 2, 3, 4]) AS \"startLine\", unnest([0, NULL, 0, 0, 2, p_size % 2 + 1]) AS n FROM part")
def java_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".java", "import java.util.List;", _s("public class C", _key(), " extends Base implements Pet {"), "  public List<String> run(int a, Map<String, Integer> b) {", F.concat(F.lit("    if (a > 0) helper(a"), F.when(F.col("p_size") % 2 == 1, ", b").otherwise(""), F.lit(");")), "  }", "}")
    return brace_parsers.parse_java(f).select("path", "kind", "name", "startLine", F.col("count").alias("n"))


@plain("cobol_facts", f"SELECT {_PATH.format('.cbl')} AS path, unnest(['Module', 'Function', 'perform', 'call']) AS kind, unnest(['PROG' || p_partkey, 'MAIN-PARA', 'NEXT-PARA', 'SUB' || (p_partkey % 10)]) AS name FROM part")
def cobol_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".cbl", "       IDENTIFICATION DIVISION.", _s("       PROGRAM-ID. PROG", _key(), "."), "       PROCEDURE DIVISION.", "       MAIN-PARA.", "           PERFORM NEXT-PARA.", _s("           CALL 'SUB", _key() % 10, "'."))
    return parsers.parse_cobol(f).where("kind <> 'division'").select("path", "kind", "name")


@plain("jcl_facts", f"SELECT {_PATH.format('.jcl')} AS path, unnest(['job', 'step', 'dataset']) AS kind, unnest(['J' || (p_partkey % 1000), 'S1', 'DATA.SET' || (p_partkey % 10)]) AS name, unnest([NULL, 'PROG', 'SHR']) AS detail FROM part")
def jcl_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".jcl", _s("//J", _key() % 1000, " JOB (1),'X'"), "//S1 EXEC PGM=PROG", _s("//IN DD DSN=DATA.SET", _key() % 10, ","), "//   DISP=SHR")
    return parsers.parse_jcl(f).select("path", "kind", "name", "detail")


@plain("vue_facts", "SELECT p_partkey, 'let v = ' || p_size AS script, 'MyCard,x-' || lower(p_type) AS components FROM part")
def vue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("<template><MyCard/><x-"), _type(), F.lit("></x-"), _type(), F.lit("></template><script>let v = "), F.col("p_size").cast("string"), F.lit("</script>"))
    return table(spark, sf_dir, "part").select("p_partkey", extract.vue_script(body).alias("script"), F.array_join(extract.vue_components(body), ",").alias("components"))


@plain("consumer_keys", "SELECT p_partkey, 'a,k' || p_size || ',total' AS keys FROM part")
def consumer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _s("const { a, k", F.col("p_size"), ": renamed } = await res.json; show(data.total); data.map(x)")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.consumer_keys(body), ",").alias("keys"))


@plain("response_keys", "SELECT p_partkey, 'id,k' || p_size || ',items' AS keys FROM part")
def response_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _s("return res.json({ id: 1, 'k", F.col("p_size"), "': x, items })")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.json_keys(body), ",").alias("keys"))


@plain("orm_queries", f"SELECT {_PATH.format('.ts')} AS path, unnest([1, 2])::INT AS line, unnest(['prisma', 'supabase']) AS orm, unnest([lower(p_type), 't' || p_size]) AS model, unnest(['findMany', 'select']) AS method FROM part")
def orm_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".ts", _s("await prisma.", _type(), ".findMany()"), _s("supabase.from('t", F.col("p_size"), "').select('*')"))
    return extract.orm_queries(f).select("path", F.col("line").cast("int").alias("line"), "orm", "model", "method")


@plain("code_routes", f"SELECT {_PATH.format('.ts')} AS path, unnest([1, 2, 3])::INT AS line, unnest(['GET', 'POST', 'PUT']) AS method, unnest(['/a/' || p_size, '/b/' || p_partkey, '/c']) AS route FROM part")
def code_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".ts", _s("app.get('/a/", F.col("p_size"), "', h)"), _s("Route::post('/b/", _key(), "', h)"), "@PutMapping(\"/c\")")
    return extract.code_routes(f).select("path", F.col("line").cast("int").alias("line"), "method", "route")


@plain("tool_definitions", f"SELECT {_PATH.format('.ts')} AS path, 'tool_' || p_partkey AS name, left('does ' || p_name || repeat('y', 220), 200) AS description FROM part")
def tool_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _files(spark, sf_dir, ".ts", _s("{ name: 'tool_", _key(), "', description: 'does ", F.col("p_name"), "y" * 220, "', inputSchema: {} }"))
    return extract.tool_definitions(f)


@plain("middleware_chains", "SELECT p_partkey, 'withAuth,with' || p_size AS chain FROM part")
def middleware_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _s("export const GET = withAuth(with", F.col("p_size"), "(handler))")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(extract.middleware_chain(body), ",").alias("chain"))


@plain("rpc_contracts", f"SELECT {_PATH.format('.proto')} AS path, 'grpc::pkg.' || lower(p_type) || '/' || unnest(['Get' || p_partkey, 'Put']) AS contract_id FROM part UNION ALL SELECT {_PATH.format('.thrift')}, 'thrift::ns.a.svc' || p_size || '/ping' FROM part")
def rpc_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of Protocol Buffers and Thrift services."""
    proto = _files(spark, sf_dir, ".proto", "package pkg;", _s("service ", F.col("p_type"), " { rpc Get", _key(), "(A) returns (B); rpc Put(A) returns (B); }"))
    thrift = _files(spark, sf_dir, ".thrift", "namespace java ns.a", _s("service Svc", F.col("p_size"), " {"), "  i32 ping(1: i32 a)", "}")
    return extract.grpc_contracts(proto).unionByName(extract.thrift_contracts(thrift))


@plain("topic_contracts", f"SELECT {_PATH.format('.js')} AS path, unnest(['provider', 'consumer']) AS role, 'topic::' || unnest(['orders.' || p_size, lower(p_type)]) AS contract_id FROM part")
def topic_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.topic_contracts(_files(spark, sf_dir, ".js", _s("bus.publish('orders.", F.col("p_size"), "', x)"), _s("bus.subscribe('", F.col("p_type"), "', f)")))


@plain("include_contracts", f"SELECT {_PATH.format('.c')} AS path, 'include::ext' || p_size || '.h' AS contract_id FROM part")
def include_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers that no file of the repository provides; the file's own name is one that does."""
    return extract.include_contracts(_files(spark, sf_dir, ".c", _s('#include "ext', F.col("p_size"), '.h"'), _s('#include "p', _key(), '.c"')))


@plain("service_boundaries", "SELECT 'm' || p_size AS service, 2::BIGINT AS markers, 0.9::DOUBLE AS confidence FROM part GROUP BY p_size")
def service_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with two manifests and sources below them."""
    f = _files(spark, sf_dir, ".ts", "x").select("path")
    folder = F.split("path", "/")[0]
    marks = f.select(F.explode(F.array(F.concat(folder, F.lit("/package.json")), F.concat(folder, F.lit("/Dockerfile")))).alias("path")).distinct()
    return extract.service_boundaries(f.unionByName(marks))


@plain("workspace_dependencies", "SELECT 'm' || p_partkey || '/package.json' AS path, 'node' AS kind, '@x/' || lower(p_type) AS name, unnest(['left-' || p_size, 'right']) AS dependency FROM part")
def workspace_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _s('{"name": "@x/', _type(), '", "dependencies": {"left-', F.col("p_size"), '": "1", "right": "2"}}')
    return extract.workspace_dependencies(table(spark, sf_dir, "part").select(_s("m", _key(), "/package.json").alias("path"), body.alias("content")))


# ---- sinks


def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("graph_round_trip", "SELECT src, dst, type, confidence, step FROM e")
def graph_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph written by label and type into the shared folder, and read again."""
    g, path = code_graph(spark, sf_dir), _folder(spark, "graph")
    sinks.write_graph(g, path)
    return sinks.read_graph(spark, path).edges.select("src", "dst", "type", "confidence", "step")


@query("bulk_load_round_trip", "SELECT e.type, count(*)::BIGINT AS n FROM e WHERE type IN ('CALLS', 'HAS_METHOD', 'EXTENDS') GROUP BY type")
def bulk_load_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only edges between the labels that have a table are loaded."""
    g, path = code_graph(spark, sf_dir), _folder(spark, "bulk")
    sinks.bulk_load(g, ["Function", "Class"], path)
    return sinks.read_graph(spark, path).edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("ndjson_stream", "SELECT 'node' AS kind, id AS key FROM n UNION ALL SELECT 'relationship', src || '>' || dst || ':' || type FROM e")
def ndjson_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line for each node and edge, parsed again."""
    lines = sinks.ndjson(code_graph(spark, sf_dir))
    get = lambda p: F.get_json_object("value", p)
    return lines.select(get("$.type").alias("kind"), F.coalesce(get("$.data.id"), F.concat(get("$.data.src"), F.lit(">"), get("$.data.dst"), F.lit(":"), get("$.data.type"))).alias("key"))


@plain("registry_round_trip", f"WITH {CONTRACTS_SQL} SELECT repo, contract_id, role, symbol_uid FROM ct")
def registry_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts through the JSON registry; no line is corrupt."""
    path = _folder(spark, "registry")
    sinks.write_registry(page_contracts(spark, sf_dir).select("repo", "service", F.col("contract_id").alias("contractId"), "type", "role", F.col("symbol_uid").alias("symbolUid"), "confidence"), path)
    good, bad = sinks.read_registry(spark, path)
    return good.select("repo", F.col("contractId").alias("contract_id"), "role", F.col("symbolUid").alias("symbol_uid")).unionByName(bad.select(F.col("value").alias("repo"), F.lit("corrupt").alias("contract_id"), F.lit("").alias("role"), F.lit("").alias("symbol_uid")))


@plain("repository_scan", "SELECT DISTINCT 'lang=' || coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS folder FROM documents")
def repository_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus written as files by language, then scanned like a repository."""
    path = _folder(spark, "repository")
    table(spark, sf_dir, "documents").select(F.coalesce(F.regexp_replace("text", r"[\r\n]", " "), F.lit("")).alias("value"), "lang").write.partitionBy("lang").text(path)
    return repo.scan(spark, path, max_bytes=1 << 40).select(F.split("path", "/")[0].alias("folder")).distinct()


@query("utility_and_test_files", """SELECT DISTINCT path || x AS path, (x = '/utils/a.ts') AS utility, (x = '/__tests__/a.test.ts') AS test FROM fi, (SELECT unnest(['/utils/a.ts', '/__tests__/a.test.ts', '/main.ts']) AS x)""")
def utility_and_test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utility and test files as the indexer sees them."""
    f = code_graph(spark, sf_dir).label("File").select(F.explode(F.transform(F.array(F.lit("/utils/a.ts"), F.lit("/__tests__/a.test.ts"), F.lit("/main.ts")), lambda x: F.concat("filePath", x))).alias("path")).distinct()
    return f.select("path", predicates.is_utility_file("path").alias("utility"), predicates.is_test_file("path").alias("test"))


