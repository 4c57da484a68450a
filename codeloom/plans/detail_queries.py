"""Small operators over whole tables, with SQL: prefixes, endpoints, link de-duplication, cleaning, members, scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates, text
from ..operators import contracts, embedding
from ..sources.tables import table
from .code_graph import CODE_SQL, code_graph
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("service_prefix", f"WITH {CODE_SQL}, p AS (SELECT DISTINCT path FROM fn), s AS (SELECT unnest(['src/m1', 'src/m2/f3.ts', 'src/m']) AS prefix) SELECT prefix, path FROM p, s WHERE path = prefix OR starts_with(path, prefix || '/')")
def service_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of services by prefix: the folder itself or what lies below it, not what begins like it."""
    paths = code_graph(spark, sf_dir).label("Function").select(F.col("filePath").alias("path")).distinct()
    each = paths.select("path", F.explode(F.array(*map(F.lit, ["src/m1", "src/m2/f3.ts", "src/m"]))).alias("prefix"))
    return each.where(predicates.under_prefix("path", F.col("prefix"))).select("prefix", "path")


@query(
    "endpoint_resolution",
    """WITH c AS (SELECT 'r' || (p_size % 3) AS repo, 'u' || p_partkey AS uid, 'f' || p_size AS file, p_type AS name, p_partkey AS k FROM part),
e AS (SELECT repo, k, CASE WHEN k % 3 = 0 THEN uid END AS uid, file, CASE WHEN k % 3 = 1 THEN name ELSE 'none' END AS name FROM c),
n AS (SELECT repo, file, name, min(uid) AS u FROM c GROUP BY ALL), a AS (SELECT repo, file, min(uid) AS u FROM c GROUP BY ALL HAVING count(DISTINCT uid) = 1)
SELECT k, coalesce(e.uid, n.u, a.u) AS node FROM e LEFT JOIN n ON n.repo = e.repo AND n.file = e.file AND n.name = e.name LEFT JOIN a ON a.repo = e.repo AND a.file = e.file""",
)
def endpoint_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of links: by uid, by file and name, or as the only contract of the file."""
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(_text("r", F.col("p_size") % 3).alias("repo"), F.lit("provider").alias("role"), _text("u", k).alias("symbol_uid"), _text("f", F.col("p_size")).alias("file_path"), F.col("p_type").alias("ref_name"), k.alias("k"))
    ends = c.select("k", "repo", "role", F.when(F.col("k") % 3 == 0, F.col("symbol_uid")).alias("uid"), "file_path", F.when(F.col("k") % 3 == 1, F.col("ref_name")).otherwise("none").alias("name"))
    return contracts.resolve_endpoints(ends, c).select("k", "node")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("string")
    return li.select(
        F.lit("http").alias("type"), _text("http::GET::/", F.col("l_partkey") % 5).alias("contract_id"), F.when(F.col("l_returnflag") == "R", "manifest").when(F.col("l_returnflag") == "A", "exact").otherwise("wildcard").alias("match_type"),
        F.lit("a").alias("from_repo"), none.alias("from_service"), _text("s", F.col("l_suppkey")).alias("from_symbol_uid"), F.lit("b").alias("to_repo"), none.alias("to_service"), _text("p", F.col("l_partkey") % 10).alias("to_symbol_uid"),
        F.round(1 - F.col("l_discount"), 2).alias("confidence"), _text("f", F.col("l_linenumber")).alias("from_file_path"), _text("g", F.col("l_linenumber")).alias("to_file_path"),
    )


_LINKS_SQL = "l AS (SELECT 'http::GET::/' || (l_partkey % 5) AS contract_id, CASE l_returnflag WHEN 'R' THEN 'manifest' WHEN 'A' THEN 'exact' ELSE 'wildcard' END AS match_type, 's' || l_suppkey AS from_symbol_uid, 'p' || (l_partkey % 10) AS to_symbol_uid, round(1 - l_discount, 2) AS confidence, 'f' || l_linenumber AS from_file_path FROM lineitem)"


@query("link_dedupe", f"WITH {_LINKS_SQL} SELECT contract_id, match_type, from_symbol_uid, to_symbol_uid, confidence, from_file_path FROM l QUALIFY row_number() OVER (PARTITION BY contract_id, match_type, from_symbol_uid, to_symbol_uid ORDER BY confidence DESC, from_file_path) = 1")
def link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal links the most confident."""
    return contracts.dedupe_links(_links(spark, sf_dir)).select("contract_id", "match_type", "from_symbol_uid", "to_symbol_uid", "confidence", "from_file_path")


@query("manifest_preferred", f"WITH {_LINKS_SQL} SELECT contract_id, from_symbol_uid, to_symbol_uid, match_type, confidence FROM l QUALIFY row_number() OVER (PARTITION BY contract_id, from_symbol_uid, to_symbol_uid ORDER BY match_type = 'manifest' DESC, confidence DESC, match_type) = 1")
def manifest_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of links between the same ends the declared one, else the most confident."""
    return contracts.prefer_manifest(_links(spark, sf_dir)).select("contract_id", "from_symbol_uid", "to_symbol_uid", "match_type", "confidence")


@query("content_cleaning", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text || ' x', '[ \t]+(\n)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t\n\x0B\f\r]+x$', '')) AS cleaned_md5 FROM documents WHERE text IS NOT NULL")
def content_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trailing blanks and runs of blank lines go."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(text.clean_content("text")).alias("cleaned_md5"))


@query("structural_names", f"WITH {CODE_SQL} SELECT src AS id, string_agg(DISTINCT name, ',' ORDER BY name) AS members FROM e JOIN n ON n.id = dst WHERE type = 'HAS_METHOD' GROUP BY src")
def structural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the members of each class."""
    return embedding.structural_names(code_graph(spark, sf_dir)).select("id", F.array_join("members", ",").alias("members"))


@query("math_scalars", "SELECT l_orderkey, l_linenumber, least(greatest(l_quantity, 5), 40) AS clamped, round(sqrt(l_extendedprice), 6) AS root FROM lineitem")
def math_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clamping and roots, as scores use them."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.least(F.greatest("l_quantity", F.lit(5.0)), F.lit(40.0)).alias("clamped"), F.round(F.sqrt("l_extendedprice"), 6).alias("root"))


@query(
    "array_scalars",
    "WITH a AS (SELECT l_orderkey, list(l_partkey % 50 ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(p[:3], ',') AS first, list_contains(p, 7) AS has, len(list_distinct(p))::INTEGER AS kinds, len(list_concat(p, p[2:]))::INTEGER AS flat FROM a",
)
def array_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, membership, distinct and flattened lists."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"] % 50).alias("p"))
    flat = F.flatten(F.array(F.col("p"), F.slice("p", F.lit(2), F.size("p"))))
    return rows.select("l_orderkey", F.array_join(F.slice("p", 1, 3), ",").alias("first"), F.array_contains("p", 7).alias("has"), F.size(F.array_distinct("p")).alias("kinds"), F.size(flat).alias("flat"))


@query("json_scalars", """SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, '{"event_type":"' || event_type || '","user":{"id":' || user_id || '}}' AS packed FROM events""")
def json_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a JSON text, and nested cells as JSON text."""
    nested = F.to_json(F.struct("event_type", F.struct(F.col("user_id").alias("id")).alias("user")))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), nested.alias("packed"))


@query("date_scalars", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_diff('day', o_orderdate, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))::INTEGER AS days FROM orders")
def date_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO time stamps, and days until a customer's next order."""
    after = F.lead("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.datediff(after, F.col("o_orderdate")).alias("days"))
