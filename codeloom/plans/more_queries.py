"""Further operators as queries: closures, resolution, scopes, matchers, scalars, pivots, write sets, steps."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates, text, urls
from ..functions.porter import porter
from ..operators import analytics, impact, incremental, relational, resolution, search, traverse
from ..sources import repo
from ..sources.tables import table
from .derived import SESSIONS_SQL, TRADE_SQL, sessions, succession_edges, succession_sql, trade_graph
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

_HERITAGE_SQL = "h AS (SELECT 'C' || p_partkey AS child, 'C' || (p_partkey // d) AS parent, min(d) AS seq FROM part, (SELECT unnest([3, 5]) AS d) WHERE p_partkey > 0 GROUP BY ALL)"


def _heritage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as classes: class k extends k // 3 and k // 5, a deep hierarchy with shared bases."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0").select("p_partkey", F.explode(F.array(F.lit(3), F.lit(5))).alias("d"))
    name = lambda k: F.concat(F.lit("C"), k.cast("string"))
    e = p.groupBy(name(F.col("p_partkey")).alias("child"), name(F.floor(F.col("p_partkey") / F.col("d"))).alias("parent")).agg(F.min("d").alias("seq"))
    return e.withColumn("kind", F.lit("EXTENDS"))


_ANCESTORS_SQL = f"{_HERITAGE_SQL}, r AS (SELECT child, parent AS ancestor, 1 AS depth FROM h UNION SELECT r.child, h.parent, depth + 1 FROM r JOIN h ON h.child = ancestor), m AS (SELECT child, ancestor, min(depth)::INTEGER AS depth FROM r GROUP BY ALL)"


@query("ancestor_closure", f"WITH RECURSIVE {_ANCESTORS_SQL} SELECT * FROM m")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.ancestors(_heritage(spark, sf_dir))


@query("mro_holds", f"WITH RECURSIVE {_ANCESTORS_SQL} SELECT child, count(*)::BIGINT AS ancestors, true AS each_once, true AS parents_in_order FROM m GROUP BY child")
def mro_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has each ancestor once, in whole positions from 0; where C3 succeeds, own parents stand as written."""
    heritage = _heritage(spark, sf_dir)
    order = analytics.linear_orders(heritage).withColumn("ancestors", F.size("order").cast("long"))
    own = heritage.groupBy("child").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "parent"))), lambda p: p["parent"]).alias("parents"))
    at = F.transform("parents", lambda p: F.array_position("order", p))
    kept = ~F.col("exact") | (F.element_at(at, -1) >= F.array_max(at))
    each = F.size(F.array_distinct("order")) == F.size("order")
    return order.join(own.hint("merge"), "child").select("child", "ancestors", each.alias("each_once"), kept.alias("parents_in_order"))


@query("mro_c3")
def mro_c3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3 orders of the hierarchy; inconsistent ones fall back to breadth first (exact = false). What must hold is mro_holds."""
    return analytics.linearize(_heritage(spark, sf_dir))


@query("direct_or_inherited", f"WITH RECURSIVE {_ANCESTORS_SQL} SELECT child, count(*)::BIGINT AS ancestors, count(*) FILTER (depth = 1)::BIGINT AS direct FROM m GROUP BY child")
def direct_or_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.ancestors(_heritage(spark, sf_dir)).groupBy("child").agg(F.count(F.lit(1)).alias("ancestors"), F.count_if(F.col("depth") == 1).alias("direct"))


@query("depth_buckets", f"""WITH RECURSIVE {succession_sql()}, s AS (SELECT src AS id FROM succ GROUP BY src ORDER BY src::BIGINT LIMIT 5), r AS (SELECT id, 0 AS depth FROM s UNION SELECT src, depth + 1 FROM r JOIN succ ON dst = id WHERE depth < 3),
f AS (SELECT id, min(depth) AS depth FROM r GROUP BY id HAVING min(depth) > 0) SELECT depth::INTEGER AS depth, count(*)::BIGINT AS n, md5(string_agg(id, ',' ORDER BY id)) AS ids_md5 FROM f GROUP BY depth""")
def depth_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = succession_edges(spark, sf_dir)
    seeds = e.select(F.col("src").alias("id")).distinct().orderBy(F.col("id").cast("long")).limit(5)
    return traverse.depth_buckets(traverse.bfs(e, seeds, "up", 3)).select("depth", "n", F.md5(F.array_join("ids", ",")).alias("ids_md5"))


@query(
    "write_set",
    f"""WITH RECURSIVE {succession_sql()}, s AS (SELECT src AS id FROM succ GROUP BY src ORDER BY src::BIGINT LIMIT 3), r AS (SELECT id, 0 AS depth FROM s UNION SELECT src, depth + 1 FROM r JOIN succ ON dst = id WHERE depth < 2),
w AS (SELECT DISTINCT id FROM r) SELECT id AS path FROM w UNION SELECT src FROM succ WHERE dst IN (SELECT id FROM w)""",
)
def write_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files with importers up to two levels, and the files one import further."""
    e = succession_edges(spark, sf_dir)
    seeds = e.select(F.col("src").alias("id")).distinct().orderBy(F.col("id").cast("long")).limit(3)
    reached, _ = traverse.closure(e, seeds, "up", 2)
    return incremental.boundary(reached.select(F.col("id").alias("path")), e.select("src", "dst"))


# ---- resolution

_DEFS_SQL = """
d AS (SELECT p_partkey AS id, p_brand AS file, p_type AS name FROM part),
im AS (SELECT DISTINCT p_brand AS file, p_mfgr AS source FROM (SELECT p_brand, lead(p_brand) OVER (ORDER BY p_brand) AS p_mfgr FROM (SELECT DISTINCT p_brand FROM part)) WHERE p_mfgr IS NOT NULL),
st AS (SELECT row_number() OVER (ORDER BY f, n) AS site, f AS file, n AS name FROM (SELECT DISTINCT a.p_brand AS f, b.p_type AS n FROM part a JOIN part b ON a.p_size = b.p_size))"""


@query(
    "tiered_resolution",
    f"""WITH {_DEFS_SQL}, c AS (SELECT site, id, 1 AS r, 'same-file' AS tier FROM st JOIN d USING (file, name) UNION ALL SELECT site, id, 3, 'import-scoped' FROM st JOIN im USING (file) JOIN d ON d.file = source AND d.name = st.name UNION ALL SELECT site, id, 5, 'global' FROM st JOIN d USING (name)),
b AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY r) AS k FROM c) SELECT file, name, tier, count(DISTINCT id)::BIGINT AS candidates, CASE tier WHEN 'same-file' THEN 0.95 WHEN 'import-scoped' THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM b JOIN st USING (site) WHERE k = 1 GROUP BY ALL""",
)
def tiered_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are files that import the next brand, part types are names defined in them."""
    p = table(spark, sf_dir, "part")
    defs = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("file"), F.col("p_type").alias("name"))
    brands = p.select("p_brand").distinct()
    nxt = brands.withColumn("source", F.lead("p_brand").over(Window.orderBy("p_brand")))  # the brands, a handful
    imports = nxt.where("source IS NOT NULL").select(F.col("p_brand").alias("file"), "source", F.lit("*").alias("local"), F.lit("*").alias("exported"))
    pairs = p.select(F.col("p_brand").alias("file"), "p_size").distinct().join(p.select(F.col("p_type").alias("name"), "p_size").distinct(), "p_size").select("file", "name").distinct()
    sites = pairs.withColumn("site", F.concat_ws("|", "file", "name"))
    found = resolution.resolve_tiers(sites, defs, imports)
    return found.join(sites, "site").groupBy("file", "name", "tier", "confidence").agg(F.countDistinct("id").alias("candidates"))


@query(
    "wildcard_bindings",
    "WITH e AS (SELECT p_brand AS f, p_type AS name, min(p_partkey) AS id FROM part GROUP BY ALL), i AS (SELECT p_brand AS f, lead(p_brand) OVER (ORDER BY p_brand) AS s FROM (SELECT DISTINCT p_brand FROM part)), r AS (SELECT i.f AS file, name, e.id, row_number() OVER (PARTITION BY i.f ORDER BY e.f, name, e.id) AS n FROM i JOIN e ON e.f = i.s) SELECT file, name, id FROM r WHERE n <= 1000",
)
def wildcard_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    exports = p.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id"))
    nxt = p.select("p_brand").distinct().withColumn("source", F.lead("p_brand").over(Window.orderBy("p_brand")))  # the brands, a handful
    return resolution.wildcard_bindings(nxt.where("source IS NOT NULL").select(F.col("p_brand").alias("file"), "source"), exports)


@query(
    "methods_by_owner",
    "WITH c AS (SELECT p_brand, p_size, count(*) AS n, count(DISTINCT p_type) AS k, min(p_partkey) AS id FROM part GROUP BY ALL) SELECT p_brand AS owner, p_size AS name, id::VARCHAR AS id FROM c WHERE n = 1 OR k = 1",
)
def methods_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One definition per (owner, name), or several that agree on their return type."""
    p = table(spark, sf_dir, "part")
    defs = p.select(F.col("p_brand").alias("owner"), F.col("p_size").cast("string").alias("name"), F.format_string("%09d", "p_partkey").alias("id"), F.lit(None).cast("int").alias("required"), F.lit(None).cast("int").alias("total"), F.col("p_type").alias("return_type"))
    sites = defs.select("owner", "name").distinct().withColumn("site", F.concat_ws("|", "owner", "name")).withColumn("arg_count", F.lit(None).cast("int"))
    found = resolution.methods_by_owner(sites, defs)
    return found.join(sites, "site").select("owner", F.col("name").cast("int").alias("name"), F.col("id").cast("long").cast("string").alias("id"))


@query(
    "typed_properties",
    "WITH p AS (SELECT p_partkey AS id, p_brand || '<' || string_split(p_type, ' ')[1] || '>' AS t FROM part), n AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS name FROM part UNION SELECT DISTINCT p_brand FROM part) SELECT name, count(DISTINCT id)::BIGINT AS n FROM p JOIN n ON t = name OR starts_with(t, name || '<') OR contains(t, '<' || name || '>') GROUP BY name",
)
def typed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties typed Brand<Kind>: found by the brand and by the kind."""
    p = table(spark, sf_dir, "part")
    kind = F.split("p_type", " ")[0]
    # identifiers can't hold '#', which brands do
    brand = F.replace("p_brand", F.lit("#"), F.lit("_"))
    props = p.select(F.col("p_partkey").alias("id"), F.concat(brand, F.lit("<"), kind, F.lit(">")).alias("declaredType"))
    names = p.select(kind.alias("name")).unionByName(p.select(brand.alias("name"))).distinct()
    out = relational.typed_as(props, names).groupBy("name").agg(F.countDistinct("id").alias("n"))
    real = p.select(brand.alias("name"), F.col("p_brand").alias("shown")).distinct()
    return out.join(real, "name", "left").select(F.coalesce("shown", "name").alias("name"), "n")


@query(
    "innermost_scope",
    f"""WITH {SESSIONS_SQL}, sc AS (SELECT user_id, session, min(epoch(ts))::BIGINT AS a, max(epoch(ts))::BIGINT AS b FROM sess GROUP BY ALL UNION ALL SELECT user_id, 'file_' || user_id, 0, 9999999999 FROM events GROUP BY user_id)
SELECT event_id, session AS scope FROM (SELECT event_id, sc.session, row_number() OVER (PARTITION BY event_id ORDER BY a DESC, b, sc.session) AS n FROM events JOIN sc ON events.user_id = sc.user_id AND epoch(ts)::BIGINT BETWEEN a AND b) WHERE n = 1""",
)
def innermost_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events are positions, users files, sessions scopes nested in their file."""
    s = sessions(spark, sf_dir).withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    at = s.select(F.col("event_id").alias("site"), F.col("user_id").alias("file"), F.col("t").alias("pos"))
    inner = s.groupBy(F.col("user_id").alias("file"), F.col("session").alias("scope")).agg(F.min("t").alias("r_start"), F.max("t").alias("r_end"))
    hit = relational.innermost(at, inner, 86_400)
    outer = at.join(hit, "site", "left").select(F.col("site").alias("event_id"), F.coalesce("scope", F.concat(F.lit("file_"), "file")).alias("scope"))
    return outer


_MATCHERS = ["/en/:path*", "/fr/:id", "/de/:id", "/:lang/1:rest*"]


@query(
    "middleware_match",
    r"""WITH p AS (SELECT DISTINCT string_split(string_split(regexp_replace(url, '^https?://[^/?#]*', ''), '#')[1], '?')[1] AS route FROM pages), m(name, re) AS (VALUES ('/en/:path*', '^/en(?:/.*)?$'), ('/fr/:id', '^/fr/[^/]+$'), ('/de/:id', '^/de/[^/]+$'), ('/:lang/1:rest*', '^/[^/]+/1[^/]+*$'))
SELECT route, string_agg(name, ',' ORDER BY name) AS middleware FROM p JOIN m ON CASE WHEN name = '/:lang/1:rest*' THEN regexp_matches(route, '^/[^/]+/1[^/]*$') AND length(route) > 0 AND regexp_matches(route, '^/[^/]+/1[^/]+') ELSE regexp_matches(route, re) END GROUP BY route""",
)
def middleware_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with the matchers that cover them; the matchers are a few literals."""
    route = F.split(F.split(F.regexp_replace("url", r"^https?://[^/?#]*", ""), "#")[0], r"\?")[0]
    routes = table(spark, sf_dir, "pages").select(route.alias("route")).distinct()
    hits = F.array(*[F.when(F.col("route").rlike(_java(m)), F.lit(m)) for m in _MATCHERS])
    return routes.select("route", F.array_join(F.sort_array(F.array_compact(hits)), ",").alias("middleware")).where("middleware <> ''")


def _java(matcher: str) -> str:
    """A matcher as a regular expression, as functions.extract.matcher_regex does for a column."""
    return "^" + re.sub(r":\w+\+?", "[^/]+", re.sub(r"/:\w+\*", "(?:/.*)?", matcher.replace(":rest*", ":rest"))) + "$"


@query("string_scalars", "SELECT p_partkey, lower(left(regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g'), 20)) AS sane, upper(left(p_name, 1)) || substr(p_name, 2) AS cap, sha256(p_name) AS sha, sha1(p_name) AS sha_1, string_split(p_type, ' ')[-1] AS last_word FROM part")
def string_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.sanitize_id("p_name").alias("sane"), text.capitalize("p_name").alias("cap"), F.sha2("p_name", 256).alias("sha"), F.sha1("p_name").alias("sha_1"), F.element_at(F.split("p_type", " "), -1).alias("last_word"))


@query("parity_pivot", "SELECT lang, count(*) FILTER (n_chars >= 2000)::BIGINT AS long, count(*) FILTER (n_chars < 2000)::BIGINT AS short FROM documents GROUP BY lang")
def parity_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement counts per language, as a pivot with stated values."""
    d = table(spark, sf_dir, "documents").withColumn("kind", F.when(F.col("n_chars") >= 2000, "long").otherwise("short"))
    return d.groupBy("lang").pivot("kind", ["long", "short"]).agg(F.count(F.lit(1))).na.fill(0)


@query("run_metrics", "SELECT l_returnflag AS run, round(sum(l_extendedprice) / greatest(count(DISTINCT l_orderkey), 1), 4) AS cost_per_case, round(count(*) FILTER (l_discount > 0.05) / greatest(count(*), 1)::DOUBLE, 6) AS hit_rate, count(*)::BIGINT AS calls FROM lineitem GROUP BY l_returnflag")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a run with a guard against empty denominators."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy(F.col("l_returnflag").alias("run"))
    return g.agg(F.round(F.sum("l_extendedprice") / F.greatest(F.countDistinct("l_orderkey"), F.lit(1)), 4).alias("cost_per_case"), F.round(F.count_if(F.col("l_discount") > 0.05) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("hit_rate"), F.count(F.lit(1)).alias("calls"))


@query(
    "diff_hunks",
    "SELECT o_custkey AS diff_id, 'f' || (o_orderkey % 5) || '.ts' AS \"filePath\", o_orderkey AS \"startLine\", o_orderkey + o_orderkey % 4 - 1 AS \"endLine\" FROM orders WHERE o_orderkey % 4 > 0",
)
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a unified diff: a header line and a hunk line each."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("diff_id"), F.col("o_orderkey").alias("k"))
    pair = F.array(F.concat(F.lit("+++ b/f"), (F.col("k") % 5).cast("string"), F.lit(".ts")), F.concat(F.lit("@@ -1 +"), F.col("k").cast("string"), F.lit(","), (F.col("k") % 4).cast("string"), F.lit(" @@")))
    lines = o.select("diff_id", "k", F.posexplode(pair).alias("i", "line")).select("diff_id", (F.col("k") * 2 + F.col("i")).alias("n"), "line")
    return repo.diff_hunks(lines)


@query("process_steps", f"WITH {SESSIONS_SQL} SELECT session, string_agg(event_type, '>' ORDER BY step) AS path, max(step)::INTEGER AS steps FROM sess GROUP BY session HAVING max(step) >= 2")
def process_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered steps of every process of at least two."""
    s = sessions(spark, sf_dir)
    g = s.groupBy("session").agg(F.sort_array(F.collect_list(F.struct("step", "event_type"))).alias("x"), F.max("step").alias("steps")).where("steps >= 2")
    return g.select("session", F.array_join(F.transform("x", lambda r: r["event_type"]), ">").alias("path"), "steps")


@query("batch_flows", f"WITH {SESSIONS_SQL} SELECT user_id, count(DISTINCT session)::BIGINT AS flows, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM sess GROUP BY user_id")
def batch_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    return s.groupBy("user_id").agg(F.countDistinct("session").alias("flows"), F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"))


@query("symbol_ranking", f"WITH {TRADE_SQL} SELECT id, label, least(1.0, 0.5 + CASE WHEN label = 'Customer' THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(name), '00001') THEN 0.4 ELSE 0 END)::DOUBLE AS score FROM trade_nodes WHERE contains(lower(name), '0001') ORDER BY score DESC, length(name), id LIMIT 50")
def symbol_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by score, shorter name, id: a top-k report."""
    n = trade_graph(spark, sf_dir).nodes.where(F.lower("name").contains("0001"))
    score = F.least(F.lit(1.0), 0.5 + F.when(F.col("label") == "Customer", 0.2).otherwise(0.0) + F.when(F.lower("name").contains("00001"), 0.4).otherwise(0.0))
    return n.withColumn("score", score).orderBy(F.desc("score"), F.length("name"), "id").select("id", "label", "score").limit(50)


@query("siblings", "SELECT a.c_custkey AS repo, count(*)::BIGINT AS siblings FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey <> b.c_custkey GROUP BY a.c_custkey")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clones share a remote (nation and segment): counted per group, not by a join of all pairs."""
    c = table(spark, sf_dir, "customer")
    sizes = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return c.join(sizes, ["c_nationkey", "c_mktsegment"]).where("n > 1").select(F.col("c_custkey").alias("repo"), (F.col("n") - 1).alias("siblings"))


@query("stem_totals", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS term FROM documents) SELECT doc_id, count(*)::BIGINT AS terms FROM t GROUP BY doc_id")
def stem_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemming gathers terms, it loses none: the counts of each document's stems add up to its terms."""
    index = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text", porter)
    return index.groupBy("doc_id").agg(F.sum("tf").alias("terms"))


@query("stemmed_terms")
def stemmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of stemmed terms: the index that a stemming full-text search reads."""
    index = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text", porter)
    return index.groupBy("term").agg(F.countDistinct("doc_id").alias("df"), F.sum("tf").alias("tf"))


@query("body_only", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'line-count' WHEN doc_id % 3 = 1 THEN 'calls' END AS reason FROM documents WHERE text IS NOT NULL")
def body_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of every document: a line more, a call more, or words only."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    new = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nmore"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" extra_call(1)"))).otherwise(F.concat("text", F.lit(" plain words")))
    return incremental.body_only(d.select("doc_id", F.col("text").alias("old"), new.alias("new"))).select("doc_id", "reason")


@query("cohesion", f"""WITH {succession_sql()}, m AS (SELECT c_custkey::VARCHAR AS id, c_nationkey AS comm FROM customer), nb AS (SELECT src AS a, dst AS b FROM succ UNION SELECT dst, src FROM succ),
s AS (SELECT comm, count(*)::BIGINT AS symbols FROM m GROUP BY comm), c AS (SELECT x.comm, avg((x.comm = y.comm)::INT) AS c FROM nb JOIN m x ON a = x.id JOIN m y ON b = y.id GROUP BY x.comm)
SELECT s.comm, symbols, round(CASE WHEN symbols <= 1 THEN 1.0 ELSE coalesce(c, 1.0) END, 6) AS cohesion FROM s LEFT JOIN c ON s.comm = c.comm""")
def cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohesion of nations over all members (no sample)."""
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").alias("comm"))
    return analytics.cohesion(succession_edges(spark, sf_dir), members, None).withColumn("cohesion", F.round("cohesion", 6))


@query("frontier_semi_join", f"WITH {TRADE_SQL} SELECT type, count(*)::BIGINT AS n FROM trade_edges WHERE dst IN (SELECT id FROM trade_nodes WHERE label IN ('Supplier', 'Nation')) GROUP BY type")
def frontier_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = trade_graph(spark, sf_dir)
    return relational.frontier_edges(g.edges, g.label("Supplier", "Nation").select("id"), "dst").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("file_routes", r"""WITH p AS (SELECT page_id, lang, 'app/(web)/api/' || lang || '/' || page_id || '/route.ts' AS nx, 'api/' || lang || '_' || (page_id % 3) || '.php' AS ph FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang FROM pages))
SELECT page_id, '/api/' || lang || '/' || page_id AS next_route, '/api/' || lang || '_' || (page_id % 3) AS php_route FROM p""")
def file_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("app/(web)/api/"), lang, F.lit("/"), "page_id", F.lit("/route.ts")).alias("nx"), F.concat(F.lit("api/"), lang, F.lit("_"), (F.col("page_id") % 3).cast("string"), F.lit(".php")).alias("ph"))
    return p.select("page_id", urls.nextjs_route("nx").alias("next_route"), urls.php_route("ph").alias("php_route"))


@query("language_of", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'cpp' WHEN 3 THEN 'ruby' END AS language FROM pages")
def language_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("a/x.py", "a/x.TSX", "a/x.hpp", "a/Rakefile", "a/readme")])
    return table(spark, sf_dir, "pages").select("page_id", repo.language_of(F.element_at(names, (F.col("page_id") % 5 + 1).cast("int"))).alias("language"))


@query("tolerant_confidence", f"WITH {TRADE_SQL} SELECT type, count(*)::BIGINT AS n FROM (SELECT type, CASE WHEN type = 'CONTAINS' THEN NULL ELSE confidence END AS c FROM trade_edges) WHERE c IS NULL OR c >= 0.97 GROUP BY type")
def tolerant_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = trade_graph(spark, sf_dir).edges.withColumn("confidence", F.when(F.col("type") != "CONTAINS", F.col("confidence")))
    return e.where(predicates.tolerant_confidence(0.97)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("risk_by_target", f"WITH {succession_sql()}, d AS (SELECT dst AS id, count(*) AS direct FROM succ GROUP BY dst) SELECT id, direct::BIGINT AS direct, CASE WHEN direct >= 30 THEN 'CRITICAL' WHEN direct >= 15 THEN 'HIGH' WHEN direct >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM d")
def risk_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk class of changing each node by its direct dependents alone."""
    d = succession_edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("direct"))
    return d.withColumn("risk", impact.impact_risk(F.col("direct"), F.lit(0), F.lit(0), F.col("direct")))
