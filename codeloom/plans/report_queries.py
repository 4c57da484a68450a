"""Report queries: contracts, routes, shapes, URLs, structure, links, on data derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text, urls
from ..functions.predicates import is_noisy_contract, is_test_path
from ..model import Graph
from ..operators import contracts as c
from ..operators import relational, reports, structure
from ..session import stored
from ..sources.tables import table
from .derived import TRADE_SQL, trade_graph
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def page_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as contracts: hosts are repositories, languages services; kinds and roles follow the page number."""
    p = table(spark, sf_dir, "pages").withColumn("n", F.col("page_id"))
    host = F.regexp_extract("url", r"^https?://([^/]+)/", 1)
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]+)/", 1)
    word = F.element_at(F.split(host, r"\."), -3)
    kind = F.when(F.col("n") % 4 < 2, "http").when(F.col("n") % 4 == 2, "grpc").otherwise("thrift")
    group = (F.col("n") / 4).cast("long")
    role = F.when(group % 2 == 0, "provider").otherwise("consumer")
    method = F.when((role == "consumer") & (group % 6 == 1), "*").when(group % 3 == 0, "get").otherwise("POST")
    http = F.concat(F.lit("http::"), method, F.lit("::/"), lang, F.lit("/"), (group % 23).cast("string"), F.when(group % 5 == 0, "/").otherwise(""))
    service = F.concat(F.when((role == "consumer") & (group % 4 == 1), "").otherwise(F.concat(F.lit("com."), word, F.lit("."))), F.lit("Svc"), (group % 11).cast("string"))
    rpc = F.concat(kind, F.lit("::"), service, F.lit("/"), F.when((role == "consumer") & (group % 6 == 3), "*").otherwise(F.concat(F.lit("Do"), (group % 3).cast("string"))))
    contracts = p.select(
        host.alias("repo"),
        F.when(group % 3 != 0, lang).alias("service"),
        F.when(kind == "http", http).otherwise(rpc).alias("contract_id"),
        kind.alias("type"),
        role.alias("role"),
        F.concat(F.lit("Page:"), "page_id").alias("symbol_uid"),
        F.concat(lang, F.lit("/f"), (group % 7).cast("string"), F.lit(".ts")).alias("file_path"),
        F.concat(F.lit("fn"), "page_id").alias("ref_name"),
        F.when(F.col("n") % 5 == 0, "").otherwise(F.concat(F.lit("sym"), "page_id")).alias("symbol_name"),
        F.round(0.5 + (F.col("n") % 50) / 100, 2).alias("confidence"),
        F.when(F.col("n") % 9 == 0, "manifest").otherwise("scan").alias("source"),
        F.col("page_id").alias("seq"),
    )
    return stored(contracts, "page-contracts")  # a table, as in production, keeps the plans of the matches small


CONTRACTS_SQL = r"""
pg AS (SELECT page_id AS n, regexp_extract(url, '^https?://([^/]+)/', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang, page_id // 4 AS g FROM pages),
pk AS (SELECT *, CASE WHEN n % 4 < 2 THEN 'http' WHEN n % 4 = 2 THEN 'grpc' ELSE 'thrift' END AS type, CASE WHEN g % 2 = 0 THEN 'provider' ELSE 'consumer' END AS role, string_split(host, '.')[-3] AS word FROM pg),
ct AS (SELECT host AS repo, CASE WHEN g % 3 <> 0 THEN lang END AS service,
  CASE WHEN type = 'http' THEN 'http::' || CASE WHEN role = 'consumer' AND g % 6 = 1 THEN '*' WHEN g % 3 = 0 THEN 'get' ELSE 'POST' END || '::/' || lang || '/' || (g % 23) || CASE WHEN g % 5 = 0 THEN '/' ELSE '' END
  ELSE type || '::' || CASE WHEN role = 'consumer' AND g % 4 = 1 THEN '' ELSE 'com.' || word || '.' END || 'Svc' || (g % 11) || '/' || CASE WHEN role = 'consumer' AND g % 6 = 3 THEN '*' ELSE 'Do' || (g % 3) END END AS contract_id,
  type, role, 'Page:' || n AS symbol_uid, lang || '/f' || (g % 7) || '.ts' AS file_path, 'fn' || n AS ref_name, CASE WHEN n % 5 = 0 THEN '' ELSE 'sym' || n END AS symbol_name,
  round(0.5 + (n % 50) / 100, 2) AS confidence, CASE WHEN n % 9 = 0 THEN 'manifest' ELSE 'scan' END AS source, n AS seq FROM pk),
ck AS (SELECT *, CASE WHEN type = 'http' THEN 'http::' || upper(string_split(contract_id, '::')[2]) || '::' || rtrim(string_split(contract_id, '::')[3], '/')
  ELSE type || '::' || lower(string_split(string_split(contract_id, '::')[2], '/')[1]) || '/' || string_split(contract_id, '/')[2] END AS key FROM ct),
pr AS (SELECT *, CASE WHEN type <> 'http' THEN string_split(string_split(key, '::')[2], '/')[1] END AS svc, CASE WHEN type <> 'http' THEN string_split(key, '/')[2] END AS mth FROM ck WHERE role = 'provider'),
co AS (SELECT *, CASE WHEN type <> 'http' THEN string_split(string_split(key, '::')[2], '/')[1] END AS svc, CASE WHEN type <> 'http' THEN string_split(key, '/')[2] END AS mth FROM ck WHERE role = 'consumer'),
ok AS (SELECT co.symbol_uid AS c, pr.symbol_uid AS p FROM co, pr WHERE NOT (co.repo = pr.repo AND (co.service IS NULL OR pr.service IS NULL OR co.service = pr.service))),
wild AS (SELECT symbol_uid FROM co WHERE type <> 'http' AND mth = '*'),
exact AS (SELECT co.symbol_uid AS c, pr.symbol_uid AS p FROM co JOIN pr ON co.key = pr.key WHERE co.symbol_uid NOT IN (SELECT symbol_uid FROM wild)),
none AS (SELECT * FROM co WHERE key NOT IN (SELECT key FROM pr) AND symbol_uid NOT IN (SELECT symbol_uid FROM wild)),
anym AS (SELECT none.symbol_uid AS c, pr.symbol_uid AS p FROM none JOIN pr ON none.key LIKE 'http::*::%' AND pr.type = 'http' AND string_split(none.key, '::')[3] = string_split(pr.key, '::')[3]),
sufk AS (SELECT none.symbol_uid AS c, pr.key, pr.symbol_uid AS p FROM none JOIN pr ON none.type = 'thrift' AND pr.type = 'thrift' AND none.svc NOT LIKE '%.%' AND pr.mth = none.mth AND (pr.svc = none.svc OR pr.svc LIKE '%.' || none.svc)),
suf AS (SELECT c, p FROM sufk WHERE c IN (SELECT c FROM sufk GROUP BY c HAVING count(DISTINCT key) = 1)),
wk AS (SELECT co.symbol_uid AS c, co.type, co.svc AS want, pr.svc AS have, pr.symbol_uid AS p, least(co.confidence, pr.confidence) AS conf FROM co JOIN pr ON co.type = pr.type AND co.type <> 'http' AND co.mth = '*' AND pr.mth <> '*' AND (pr.svc = co.svc OR (co.svc NOT LIKE '%.%' AND pr.svc LIKE '%.' || co.svc))),
wl AS (SELECT * FROM wk WHERE NOT (type = 'thrift' AND want NOT LIKE '%.%' AND c IN (SELECT c FROM wk GROUP BY c HAVING count(DISTINCT have) > 1)))"""


def _pairs(links: DataFrame) -> DataFrame:
    return links.select("from_symbol_uid", "to_symbol_uid", "match_type", "confidence")


@query("contract_exact", f"WITH {CONTRACTS_SQL} SELECT x.c AS from_symbol_uid, x.p AS to_symbol_uid, 'exact' AS match_type, 1.0::DOUBLE AS confidence FROM (SELECT * FROM exact UNION ALL SELECT * FROM anym UNION ALL SELECT * FROM suf) x JOIN ok ON x.c = ok.c AND x.p = ok.p")
def contract_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal canonical ids, any-method HTTP consumers, unique thrift suffixes."""
    return _pairs(c.exact_links(*c.split_roles(page_contracts(spark, sf_dir))))


@query("contract_unique_suffix", f"WITH {CONTRACTS_SQL} SELECT c AS from_symbol_uid, p AS to_symbol_uid FROM suf")
def contract_unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    consumers, providers = c.split_roles(page_contracts(spark, sf_dir))
    left = consumers.where("NOT endswith(c_key, '/*')").join(providers.select("p_key").distinct(), F.col("c_key") == F.col("p_key"), "left_anti")
    return c.unique_suffix_pairs(left, providers).select(F.col("c_symbol_uid").alias("from_symbol_uid"), F.col("p_symbol_uid").alias("to_symbol_uid"))


@query("contract_wildcard", f"WITH {CONTRACTS_SQL} SELECT wl.c AS from_symbol_uid, wl.p AS to_symbol_uid, 'wildcard' AS match_type, conf AS confidence FROM wl JOIN ok ON wl.c = ok.c AND wl.p = ok.p")
def contract_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(c.wildcard_links(*c.split_roles(page_contracts(spark, sf_dir))))


@query("contract_unmatched", f"WITH {CONTRACTS_SQL}, l AS (SELECT x.c, x.p FROM (SELECT * FROM exact UNION ALL SELECT * FROM anym UNION ALL SELECT * FROM suf UNION ALL SELECT c, p FROM wl) x JOIN ok ON x.c = ok.c AND x.p = ok.p) SELECT symbol_uid, role FROM ct WHERE symbol_uid NOT IN (SELECT c FROM l UNION SELECT p FROM l)")
def contract_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_contracts(spark, sf_dir)
    return c.unmatched(t, c.match(t)).select("symbol_uid", "role")


@query(
    "contract_dedupe",
    f"""WITH {CONTRACTS_SQL}, s AS (SELECT *, 3 + 2 + 2 + CASE WHEN symbol_name <> '' THEN 2 ELSE 0 END + CASE WHEN service IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN source <> 'manifest' THEN 1 ELSE 0 END AS rich FROM ct)
SELECT repo, contract_id, role, file_path, arg_min(symbol_uid, -rich * 1000000 + seq) AS symbol_uid, arg_min(symbol_name, -rich * 1000000 + seq) FILTER (symbol_name <> '') AS symbol_name, max(confidence) AS confidence, count(*)::BIGINT AS n FROM s GROUP BY repo, contract_id, role, file_path""",
)
def contract_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = page_contracts(spark, sf_dir)
    key = ["repo", "contract_id", "role", "file_path"]
    return c.dedupe_contracts(t).select(*key, "symbol_uid", "symbol_name", "confidence").join(t.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)


@query("contract_normalise", f"WITH {CONTRACTS_SQL} SELECT symbol_uid, key FROM ck")
def contract_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_contracts(spark, sf_dir).select("symbol_uid", urls.normalize_contract_id("contract_id").alias("key"))


@query("noisy_contracts", f"WITH {CONTRACTS_SQL} SELECT symbol_uid, (type = 'http' AND key LIKE '%::/en/7') AS noisy FROM ck")
def noisy_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_contracts(spark, sf_dir).select("symbol_uid", is_noisy_contract("contract_id", ["/en/7"]).alias("noisy"))


@query(
    "url_normalise",
    r"""WITH p AS (SELECT page_id, url, string_split(string_split(regexp_replace(url, '^https?://[^/?#]*', ''), '#')[1], '?')[1] AS path FROM pages)
SELECT page_id, '/' || array_to_string(list_transform(list_filter(string_split(lower(path), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{param}' ELSE s END), '/') AS consumer_path,
CASE WHEN string_split(url, '?')[1] LIKE '/%' THEN string_split(url, '?')[1] END AS fetch_path FROM p""",
)
def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize_consumer_path("url").alias("consumer_path"), urls.normalize_fetch_url("url").alias("fetch_path"))


ROUTES = ["/en/[id]", "/fr/[id]", "/[lang]/[id].html", "/de/1", "/de/[slug]", "/es/[...rest]", "/[[...all]]"]
_VALUES = ", ".join(f"('{r}', {i})" for i, r in enumerate(ROUTES))


@query(
    "route_match",
    rf"""WITH f AS (SELECT DISTINCT string_split(string_split(regexp_replace(url, '^https?://[^/?#]*', ''), '#')[1], '?')[1] AS "fetch" FROM pages), r(route, seq) AS (VALUES {_VALUES}),
x AS (SELECT "fetch", route, seq, list_filter(string_split("fetch", '/'), lambda s: s <> '') AS a, list_filter(string_split(route, '/'), lambda s: s <> '') AS b FROM f, r),
m AS (SELECT * FROM x WHERE CASE WHEN b[-1] LIKE '[...%' OR b[-1] LIKE '[[...%' THEN len(a) >= len(b) - 1 AND len(list_filter(range(1, len(b)), lambda i: NOT (b[i] = a[i] OR b[i] LIKE '[%'))) = 0
  ELSE len(a) = len(b) AND len(list_filter(range(1, len(b) + 1), lambda i: NOT (b[i] = a[i] OR b[i] LIKE '[%'))) = 0 END)
SELECT "fetch", route, seq FROM m QUALIFY row_number() OVER (PARTITION BY "fetch" ORDER BY seq) = 1""",
)
def route_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.split(F.split(F.regexp_replace("url", r"^https?://[^/?#]*", ""), "#")[0], r"\?")[0]
    routes = spark.createDataFrame([(r, i) for i, r in enumerate(ROUTES)], "route string, seq int")
    return relational.first_route_match(table(spark, sf_dir, "pages").select(path.alias("fetch")), routes, urls.route_matches)


@query(
    "longest_prefix",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), s AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS prefix FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[a-z]+)/', 1) FROM p WHERE path LIKE '%/fr/%' OR path LIKE '%/de/%')
SELECT page_id, path, max_by(prefix, length(prefix)) AS prefix FROM p LEFT JOIN s ON path = prefix OR path LIKE prefix || '/%' GROUP BY page_id, path""",
)
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths under the deepest of some service directories."""
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    hosts = p.select(F.regexp_extract("path", "^([^/]+)", 1).alias("prefix"))
    deeper = p.where("path LIKE '%/fr/%' OR path LIKE '%/de/%'").select(F.regexp_extract("path", "^([^/]+/[a-z]+)/", 1).alias("prefix"))
    return relational.longest_prefix(p, hosts.unionByName(deeper)).select("page_id", "path", "prefix")


@query(
    "structure_nodes",
    r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages), x AS (SELECT path, string_split(path, '/') AS s FROM p),
n AS (SELECT array_to_string(s[1:i], '/') AS path, s[i] AS name, CASE WHEN i = len(s) THEN 'File' ELSE 'Folder' END AS label, CASE WHEN i > 1 THEN array_to_string(s[1:i - 1], '/') END AS parent FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM x))
SELECT DISTINCT label || ':' || path AS id, label, name, path AS file_path, 'Folder:' || parent AS parent_id FROM n""",
)
def structure_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL paths as file paths: folders, files and what contains them."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("path"))
    return structure.folders_and_files(p)


@query("html_links", r"""WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '(?:action|href|src)\s*=\s*"([^"]*)"', 1)) AS link FROM pages) SELECT page_id, link, count(*)::BIGINT AS n FROM x GROUP BY ALL""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(extract.html_links("html")).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count(F.lit(1)).alias("n"))


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Event types as routes, users' JSON property keys as what consumers read."""
    e = table(spark, sf_dir, "events")
    routes = e.select(F.col("event_type").alias("id")).distinct().withColumn("name", F.concat(F.lit("/api/"), "id"))
    routes = routes.withColumn("responseKeys", F.when(F.col("id") == "click", F.array(F.lit("k"))).otherwise(F.array(F.lit("id"), F.lit("items")))).withColumn("errorKeys", F.when(F.col("id") == "error", F.array(F.lit("k"), F.lit("message"))).otherwise(F.array(F.lit("message"))))
    used = e.groupBy(F.col("event_type").alias("route"), F.col("user_id").alias("consumer")).agg(F.array_join(F.sort_array(F.collect_set(F.json_object_keys("props")[0])), ",").alias("k"))
    per = e.groupBy(F.col("user_id").alias("consumer")).agg(F.countDistinct("event_type").alias("n"))
    fetches = used.join(per, "consumer").select("route", F.col("consumer").cast("string").alias("consumer"), F.concat(F.lit("keys:"), "k", F.lit(" fetches:"), F.col("n").cast("string")).alias("reason"))
    return routes, fetches


_SHAPE_SQL = """
u AS (SELECT event_type AS id, user_id::VARCHAR AS consumer, array_sort(array_agg(DISTINCT json_keys(props)[1])) AS ks FROM events GROUP BY ALL),
f AS (SELECT user_id::VARCHAR AS consumer, count(DISTINCT event_type) AS n FROM events GROUP BY user_id),
sh AS (SELECT id, consumer, CASE WHEN id = 'click' THEN ['k'] ELSE ['id', 'items'] END AS okk, CASE WHEN id = 'error' THEN ['k', 'message'] ELSE ['message'] END AS er, ks, n FROM u JOIN f USING (consumer)),
sc AS (SELECT id, consumer, list_filter(ks, lambda x: NOT list_contains(okk, x) AND NOT list_contains(er, x)) AS mm, list_filter(ks, lambda x: list_contains(er, x) AND NOT list_contains(okk, x)) AS eo, CASE WHEN n > 1 THEN 'low' ELSE 'high' END AS confidence FROM sh)"""


@query("shape_check", f"WITH {_SHAPE_SQL} SELECT id, consumer, array_to_string(mm, ',') AS mismatched, array_to_string(eo, ',') AS error_only, confidence FROM sc")
def shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.shape_check(*_routes(spark, sf_dir))
    return out.select("id", "consumer", F.array_join("mismatched", ",").alias("mismatched"), F.array_join("error_only", ",").alias("error_only"), "confidence")


@query(
    "api_impact",
    f"WITH {_SHAPE_SQL}, a AS (SELECT id, count(*) AS n, sum(len(mm)) AS m FROM sc GROUP BY id) SELECT id, n::INTEGER AS n_consumers, m::BIGINT AS n_mismatches, CASE least(3, CASE WHEN n >= 10 THEN 3 WHEN n >= 4 THEN 2 ELSE 1 END + CASE WHEN m > 0 THEN 1 ELSE 0 END) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM a",
)
def api_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.api_impact(*_routes(spark, sf_dir)).select("id", "n_consumers", "n_mismatches", "risk")


@query(
    "rename_preview",
    r"""WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS before, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), h AS (SELECT * FROM l WHERE regexp_matches(before, '\bLicense\b')),
d AS (SELECT *, CASE WHEN lang = 'de' THEN 'graph' WHEN lang = 'fr' THEN 'graph' ELSE 'text_search' END AS source FROM h QUALIFY lang <> 'fr' OR row_number() OVER (PARTITION BY doc_id ORDER BY line) = 1)
SELECT doc_id::VARCHAR AS "filePath", line::INTEGER AS line, md5(regexp_replace(before, '\bLicense\b', 'Licence', 'g')) AS after_md5, source FROM d""",
)
def rename_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License -> Licence: German documents define it, French ones refer to it, the others only mention it."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filePath"), F.col("text").alias("content"), "lang")
    edits = reports.rename_preview(d.select("filePath", "content"), "License", "Licence", d.where("lang = 'de'"), d.where("lang = 'fr'"))
    return edits.select("filePath", "line", F.md5("after").alias("after_md5"), "source")


@query(
    "detect_changes",
    """WITH h AS (SELECT o_custkey AS f, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY o_custkey), s AS (SELECT 'Order:' || o_orderkey AS id, o_custkey AS f, o_orderkey AS a, o_orderkey + 5 AS b FROM orders),
t AS (SELECT DISTINCT s.id FROM h JOIN s ON h.f = s.f AND h.a <= s.b AND h.b >= s.a)
SELECT o_orderpriority AS process, count(DISTINCT t.id)::BIGINT AS changed_steps, min(month(o_orderdate))::INTEGER AS first_step FROM t JOIN orders ON t.id = 'Order:' || o_orderkey GROUP BY o_orderpriority""",
)
def detect_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are files, order keys lines: symbols that a customer's urgent orders touch, and their processes."""
    o = table(spark, sf_dir, "orders")
    path = F.col("o_custkey").cast("string").alias("filePath")
    hunks = o.where("o_orderpriority LIKE '1%'").groupBy(path).agg(F.min("o_orderkey").alias("startLine"), F.max("o_orderkey").alias("endLine"))
    symbols = o.select(F.concat(F.lit("Order:"), "o_orderkey").alias("id"), path, F.col("o_orderkey").alias("startLine"), (F.col("o_orderkey") + 5).alias("endLine"))
    steps = o.select(F.concat(F.lit("Order:"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("process"), F.month("o_orderdate").alias("step"))
    span = 4096
    return reports.detect_changes(hunks, symbols, steps, span)[1]


@query("test_paths", "SELECT page_id, (contains(lower(url), '.test.') OR contains(lower(url), '/test/') OR contains(lower(url), '/tests/') OR contains(lower(url), '/spec/') OR contains(lower(url), '/test_') OR contains(lower(url), '.spec.') OR contains(lower(url), '/fixtures/')) AS is_test FROM pages")
def test_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_test_path("url").alias("is_test"))


@query("content_store", "SELECT doc_id, md5(CASE WHEN length(text) > 10000 THEN left(text, 10000) || chr(10) || '... [truncated]' ELSE text END) AS stored_md5, sha1('v1' || text) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.file_content("text")).alias("stored_md5"), text.content_hash("text").alias("content_hash"))


@query("graph_stats", f"WITH {TRADE_SQL} SELECT 'node' AS kind, label AS name, count(*)::BIGINT AS n FROM trade_nodes GROUP BY label UNION ALL SELECT 'edge', type, count(*)::BIGINT FROM trade_edges GROUP BY type")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    g: Graph = trade_graph(spark, sf_dir)
    return structure.stats(g)
