"""Cross-repository contracts: matching, de-duplication, endpoint resolution.

contracts: repo, service, contract_id, type, role, symbol_uid, file_path, ref_name, symbol_name, confidence, source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_noisy_contract, is_service_wildcard
from ..functions.urls import normalize_contract_id

SIDE = ("repo", "service", "symbol_uid", "file_path", "ref_name")


def _other_party() -> Column:
    """Not the same repository, or known and different services of it."""
    same = (F.col("c_repo") == F.col("p_repo")) & (F.coalesce("c_service", F.lit("")).isin("") | F.coalesce("p_service", F.lit("")).isin("") | (F.col("c_service") == F.col("p_service")))
    return ~same


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def _links(pairs: DataFrame, match: str, confidence: Column) -> DataFrame:
    return pairs.where(_other_party()).select(
        *[F.col(f"c_{c}").alias(f"from_{c}") for c in SIDE],
        *[F.col(f"p_{c}").alias(f"to_{c}") for c in SIDE],
        F.col("c_type").alias("type"),
        F.col("c_contract_id").alias("contract_id"),
        F.lit(match).alias("match_type"),
        confidence.alias("confidence"),
    )


def split_roles(contracts: DataFrame, exclude_paths: list[str] = (), exclude_param_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(consumers c_*, providers p_*) with the canonical key; noisy HTTP paths are left out of matching."""
    keyed = contracts.where(~is_noisy_contract("contract_id", list(exclude_paths), exclude_param_only)).withColumn("key", normalize_contract_id("contract_id"))
    return _side(keyed.where("role = 'consumer'"), "c"), _side(keyed.where("role = 'provider'"), "p")


def exact_links(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """Same canonical id; http::*::path consumers match every method, and bare thrift services a unique suffix, where no id is equal."""
    plain = consumers.where(~is_service_wildcard("c_contract_id"))
    equal = plain.join(providers, F.col("c_key") == F.col("p_key"))
    left = plain.join(providers.select("p_key").distinct(), F.col("c_key") == F.col("p_key"), "left_anti")
    any_method = left.where(F.col("c_key").startswith("http::*::")).withColumn("path", F.regexp_replace("c_key", r"^http::\*::", ""))
    http = providers.where(F.col("p_key").startswith("http::")).withColumn("path", F.regexp_replace("p_key", r"^http::[^:]*::", ""))
    by_path = any_method.join(http, "path").drop("path")
    return _links(equal.unionByName(by_path).unionByName(unique_suffix_pairs(left, providers)), "exact", F.lit(1.0))


def _rpc(df: DataFrame, prefix: str) -> DataFrame:
    """kind, service and method of grpc and thrift keys that have a method."""
    key = F.col(f"{prefix}_key")
    parts = df.where(key.rlike(r"^(grpc|thrift)::[^/]+/.+$"))
    return parts.withColumn("kind", F.regexp_extract(key, r"^(\w+)::", 1)).withColumn("service", F.regexp_extract(key, r"^\w+::([^/]+)/", 1)).withColumn("method", F.regexp_extract(key, r"^\w+::[^/]+/(.+)$", 1))


def _suffixes(service: Column) -> Column:
    """The service name and its last part, which a name without package may mean."""
    return F.array_distinct(F.array(service, F.element_at(F.split(service, r"\."), -1)))


def unique_suffix_pairs(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """Thrift consumers without package: (last part of the service, method) must name exactly one provider key."""
    c = _rpc(consumers, "c").where("kind = 'thrift' AND method <> '*' AND NOT contains(service, '.')").select(*consumers.columns, "service", "method")
    p = _rpc(providers, "p").where("kind = 'thrift' AND method <> '*'").withColumn("service", F.explode(_suffixes(F.col("service"))))
    unique = p.groupBy("service", "method").agg(F.countDistinct("p_key").alias("n")).where("n = 1").drop("n")
    return c.join(p.join(unique, ["service", "method"]).select(*providers.columns, "service", "method"), ["service", "method"]).select(*consumers.columns, *providers.columns)


def wildcard_links(consumers: DataFrame, providers: DataFrame) -> DataFrame:
    """service/* consumers with all methods of the service; without a package the last part counts, for thrift only if unambiguous."""
    c = _rpc(consumers, "c").where("method = '*'").select(*consumers.columns, "kind", F.col("service").alias("wanted"))
    p = _rpc(providers, "p").where(~F.col("p_key").endswith("/*")).select(*providers.columns, "kind", F.col("service").alias("full"))
    p = p.withColumn("wanted", F.explode(_suffixes(F.col("full"))))
    pairs = c.join(p, ["kind", "wanted"])
    services = pairs.groupBy("kind", "wanted").agg(F.countDistinct("full").alias("n"))
    allowed = services.where("kind <> 'thrift' OR contains(wanted, '.') OR n = 1").drop("n")
    return _links(pairs.join(allowed, ["kind", "wanted"]), "wildcard", F.least("p_confidence", "c_confidence"))


def match(contracts: DataFrame, **noise) -> DataFrame:
    consumers, providers = split_roles(contracts, **noise)
    return exact_links(consumers, providers).unionByName(wildcard_links(consumers, providers))


def unmatched(contracts: DataFrame, links: DataFrame) -> DataFrame:
    """Contracts that are no end of a link, by endpoint identity."""
    ends = links.select(F.col("from_repo").alias("repo"), F.col("from_symbol_uid").alias("symbol_uid")).unionByName(links.select(F.col("to_repo").alias("repo"), F.col("to_symbol_uid").alias("symbol_uid"))).distinct()
    return contracts.join(ends, ["repo", "symbol_uid"], "left_anti")


def _filled(c: str) -> Column:
    return F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))


def richness(contract: str = "contract_id") -> Column:
    # Weights of what a contract knows.
    known = lambda c: F.when(_filled(c).isNotNull(), 1).otherwise(0)
    named = lambda c: F.when(_filled(c).isNotNull() & (F.col(c) != F.col(contract)), 1).otherwise(0)
    return 3 * known("symbol_uid") + 2 * known("file_path") + 2 * named("ref_name") + 2 * named("symbol_name") + known("service") + F.when(F.coalesce("source", F.lit("")) != "manifest", 1).otherwise(0)


def dedupe_contracts(contracts: DataFrame, seq: str = "seq") -> DataFrame:
    """One contract per (repo, id, role, file): the richest, gaps filled from the others, the highest confidence."""
    key = ["repo", "contract_id", "role", "file_path"]
    ranked = contracts.withColumn("__rich", richness())
    order = Window.partitionBy(*key).orderBy(F.desc("__rich"), seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fields = [c for c in contracts.columns if c not in (*key, seq, "confidence")]
    filled = ranked.select(*key, seq, "__rich", F.max("confidence").over(order).alias("confidence"), *[F.first(_filled(c) if dict(contracts.dtypes)[c] == "string" else F.col(c), ignorenulls=True).over(order).alias(c) for c in fields])
    first = Window.partitionBy(*key).orderBy(F.desc("__rich"), seq)
    return filled.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*contracts.columns)


def dedupe_links(links: DataFrame) -> DataFrame:
    """One link per (type, id, match, both ends), the most confident one."""
    key = ["type", "contract_id", "match_type", *[f"{e}_{c}" for e in ("from", "to") for c in ("repo", "service", "symbol_uid")]]
    w = Window.partitionBy(*key).orderBy(F.desc("confidence"), "from_file_path", "to_file_path")
    return links.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def prefer_manifest(links: DataFrame) -> DataFrame:
    """Of links between the same ends for the same contract the declared (manifest) one wins."""
    key = ["type", "contract_id", *[f"{e}_{c}" for e in ("from", "to") for c in ("repo", "symbol_uid")]]
    w = Window.partitionBy(*key).orderBy(F.desc(F.col("match_type") == "manifest"), F.desc("confidence"), "match_type")
    return links.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def resolve_endpoints(ends: DataFrame, contracts: DataFrame) -> DataFrame:
    """ends (repo, role, uid, file_path, name) with node: by uid, else by (file, name), else the only contract of the file."""
    known = contracts.select("repo", "role", "symbol_uid", "file_path", F.col("ref_name").alias("name")).distinct()
    by_uid = known.select("repo", "role", F.col("symbol_uid").alias("uid"), F.col("symbol_uid").alias("n1")).where(_filled("uid").isNotNull()).distinct()
    by_name = known.groupBy("repo", "role", "file_path", "name").agg(F.min("symbol_uid").alias("n2"))
    alone = known.groupBy("repo", "role", "file_path").agg(F.min("symbol_uid").alias("n3"), F.countDistinct("symbol_uid").alias("n")).where("n = 1").drop("n")
    found = ends.join(by_uid, ["repo", "role", "uid"], "left").join(by_name, ["repo", "role", "file_path", "name"], "left").join(alone, ["repo", "role", "file_path"], "left")
    return found.select(*ends.columns, F.coalesce("n1", "n2", "n3").alias("node"))
