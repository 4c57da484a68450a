"""Composite reports: symbol search, process-grouped queries, enrichment, groups of repositories, derived edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import matcher_regex
from ..functions.urls import normalize_consumer_path, normalize_fetch_url, normalize_http_path, route_matches
from ..model import Graph
from . import contracts as c
from .relational import first_route_match, longest_prefix, top_per_key
from .search import bm25, process_ranking, ranked, rrf

# Labels with a full-text index, and the limits of the interactive reports.
INDEXED = ["File", "Function", "Class", "Method", "Interface"]
QUERY_LIMIT, MAX_SYMBOLS, MAX_DEFINITIONS = 5, 10, 20
AUGMENT_HITS, AUGMENT_FILES, AUGMENT_SYMBOLS = 10, 5, 3
CONNECTIONS = 5


# ---- search over a graph --------------------------------------------------------------------------------------


def node_hits(graph: Graph, terms: list[str], limit: int = 20, conjunctive: bool = False) -> DataFrame:
    """(id, label, filePath, score): BM25 over name and content, the best ``limit`` of each indexed label.

    Every label is an index of its own, with its own document frequencies.
    """
    out = None
    for label in INDEXED:
        docs = graph.label(label).select("id", F.concat_ws(" ", "name", "content").alias("text"))
        hits = bm25(docs, terms, "id", "text", conjunctive).withColumnRenamed("doc_id", "id").withColumn("label", F.lit(label))
        out = hits if out is None else out.unionByName(hits)
    best = top_per_key(out, "label", [F.desc("score"), "id"], limit)
    return best.join(graph.nodes.select("id", "filePath"), "id")


def file_hits(hits: DataFrame, limit: int = 20) -> DataFrame:
    """(filePath, score, node_ids, rank): a file scores the sum of its three best nodes, to nine places so that no order of adding decides."""
    top = top_per_key(hits, "filePath", [F.desc("score"), "id"], 3)
    files = top.groupBy("filePath").agg(F.round(F.sum("score"), 9).alias("score"), F.array_sort(F.collect_list("id")).alias("node_ids"))
    return ranked(files, [F.desc("score"), "filePath"], limit)


def symbol_hits(graph: Graph, files: DataFrame, per_file: int = 3) -> DataFrame:
    """(id, filePath, score, rank): files as their matching symbols; without any, the first symbols of the path; else the file itself."""
    own = files.select("filePath", "score", F.explode("node_ids").alias("id")).join(graph.nodes.where("label <> 'File'").select("id"), "id", "left_semi").select("id", "filePath", "score")
    rest = files.join(own.select("filePath").distinct(), "filePath", "left_anti").select("filePath", "score")
    symbols = graph.nodes.where("label NOT IN ('File', 'Folder', 'Community', 'Process')").select("id", "filePath").join(rest, "filePath")
    some = top_per_key(symbols, "filePath", ["id"], per_file).select("id", "filePath", "score")
    bare = rest.join(some.select("filePath").distinct(), "filePath", "left_anti").select(F.col("filePath").alias("id"), "filePath", "score")
    return ranked(own.unionByName(some).unionByName(bare), [F.desc("score"), "id"], 1_000)


def symbol_search(graph: Graph, terms: list[str], vector_hits: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """(id, score, sources, rank): text and vector lists (id, rank) fused at symbol level."""
    text = symbol_hits(graph, file_hits(node_hits(graph, terms, limit), limit))
    lists = {"bm25": text.select("id", "rank")} | ({"semantic": vector_hits.select("id", "rank")} if vector_hits is not None else {})
    return rrf(lists, "id", 0, limit)


def process_query(graph: Graph, hits: DataFrame, limit: int = QUERY_LIMIT, max_symbols: int = MAX_SYMBOLS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(processes, process symbols, definitions) of symbol hits (id, score, rank).

    Processes rank by summed score plus a tenth of the best cohesion; each shows at most max_symbols of its hits;
    definitions are the hits without a process, at most twenty.
    """
    steps = graph.type("STEP_IN_PROCESS").select(F.col("src").alias("id"), F.col("dst").alias("process"), "step")
    cohesive = graph.type("MEMBER_OF").select(F.col("src").alias("id"), F.col("dst").alias("comm")).join(graph.label("Community").select(F.col("id").alias("comm"), "cohesion"), "comm").select("id", "cohesion")
    processes = process_ranking(hits, steps.select("id", "process"), cohesive, limit)
    shown = hits.join(steps, "id").join(processes.select("process", F.col("rank").alias("process_rank")), "process")
    once = top_per_key(shown, "id", ["process_rank", "step"], 1)
    symbols = top_per_key(once, "process", [F.desc("score"), "id"], max_symbols)
    free = hits.join(steps.select("id").distinct(), "id", "left_anti").orderBy(F.desc("score"), "id").limit(MAX_DEFINITIONS)
    return processes, symbols, graph.nodes.join(free.select("id", "score"), "id")


def enrich(graph: Graph, hits: DataFrame, connections: int = CONNECTIONS) -> DataFrame:
    """Hits (id, ..) with up to five callers and callees, cluster and processes; three aggregations, no fan-out."""
    calls = graph.type("CALLS").select("src", "dst")

    def side(near: str, far: str, name: str) -> DataFrame:
        e = calls.join(hits.select(F.col("id").alias(near)), near, "left_semi")
        return top_per_key(e, near, [far], connections).groupBy(F.col(near).alias("id")).agg(F.sort_array(F.collect_list(far)).alias(name))

    clusters = graph.type("MEMBER_OF").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("cluster"))
    flows = graph.type("STEP_IN_PROCESS").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("processes"))
    out = hits
    for part in (side("dst", "src", "callers"), side("src", "dst", "callees"), clusters, flows):
        out = out.join(part, "id", "left")
    return out


def augment(graph: Graph, pattern: str) -> DataFrame:
    """Symbols that a search pattern most likely means, with callers, callees and processes, most cohesive first."""
    words = [w for w in pattern.lower().split() if w]
    if not words:
        return graph.nodes.limit(0).select("id")
    files = file_hits(node_hits(graph, words, AUGMENT_HITS), AUGMENT_FILES)
    named = graph.nodes.where(F.lower("name").contains(words[0]) & ~F.col("label").isin("File", "Folder", "Community", "Process")).join(files.select("filePath", "score"), "filePath")
    picked = top_per_key(named.select("id", "name", "filePath", "score"), "filePath", ["id"], AUGMENT_SYMBOLS)
    cohesive = graph.type("MEMBER_OF").select(F.col("src").alias("id"), F.col("dst").alias("comm")).join(graph.label("Community").select(F.col("id").alias("comm"), "cohesion"), "comm").groupBy("id").agg(F.max("cohesion").alias("cohesion"))
    return enrich(graph, picked, 3).join(cohesive, "id", "left").orderBy(F.desc_nulls_last("cohesion"), F.desc("score"), "id")


def group_query(lists: DataFrame, limit: int, prefix: str | None = None) -> DataFrame:
    """(repo, process, score): per-repository ranked processes (repo, process, rank, filePath) merged by reciprocal rank."""
    from ..functions.predicates import under_prefix

    rows = lists.where(under_prefix("filePath", prefix)) if prefix else lists
    return rows.withColumn("score", 1.0 / (60 + F.col("rank"))).orderBy(F.desc("score"), "repo", "process").limit(limit)


# ---- edges from extracted facts -------------------------------------------------------------------------------


def register_routes(routes: DataFrame) -> DataFrame:
    """First registration of each URL (url, filePath, seq) wins."""
    return top_per_key(routes, "url", ["seq", "filePath"], 1)


def fetch_edges(fetches: DataFrame, routes: DataFrame) -> DataFrame:
    """FETCHES edges: fetches (consumer, url, keys) on routes (id, url, seq); the reason carries keys and the number of routes."""
    plain = fetches.withColumn("fetch", normalize_fetch_url("url")).where("fetch IS NOT NULL")
    hit = first_route_match(plain, routes.select(F.col("url").alias("route"), "seq"), route_matches)
    joined = plain.join(hit.select("fetch", "route"), "fetch").join(routes.select(F.col("url").alias("route"), F.col("id").alias("dst")), "route")
    n = F.size(F.collect_set("route").over(Window.partitionBy("consumer")))
    reason = F.concat(F.lit("fetch-url-match|keys:"), F.array_join("keys", ","), F.when(n > 1, F.concat(F.lit("|fetches:"), n.cast("string"))).otherwise(""))
    return joined.select(F.col("consumer").alias("src"), "dst", F.lit("FETCHES").alias("type"), F.lit(0.9).alias("confidence"), reason.alias("reason"), F.lit(None).cast("int").alias("step")).distinct()


def attach_middleware(routes: DataFrame, matchers: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Routes (url, middleware) with the labels of matchers (pattern, label) that cover them in front, without repeats.

    The matchers come from configuration files; they are broadcast up to max_rows, else joined by nested loop in Spark.
    """
    m = matchers.select(matcher_regex("pattern").alias("re"), "label")
    m = F.broadcast(m) if matchers.limit(max_rows + 1).count() <= max_rows else m
    hit = routes.select("url").distinct().join(m, F.expr("url RLIKE re")).groupBy("url").agg(F.array_sort(F.collect_set("label")).alias("front"))
    empty = F.array().cast("array<string>")
    front, own = F.coalesce("front", empty), F.coalesce("middleware", empty)
    return routes.join(hit, "url", "left").withColumn("middleware", F.concat(front, F.array_except(own, front))).drop("front")


def link_processes(processes: DataFrame, routes: DataFrame, tools: DataFrame, nodes: DataFrame) -> DataFrame:
    """ENTRY_POINT_OF edges from routes and tools to processes: by handler id where known, else by the entry's file."""
    entry = processes.select(F.col("id").alias("process"), "entryPointId").join(nodes.select(F.col("id").alias("entryPointId"), "filePath"), "entryPointId")
    parts = None
    for kind in (routes, tools):
        exact = kind.where("handler IS NOT NULL").select(F.col("id").alias("src"), F.col("handler").alias("entryPointId")).join(entry, "entryPointId").select("src", "process")
        rest = kind.join(exact.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("src"), "filePath")
        both = exact.unionByName(rest.join(entry, "filePath").select("src", "process"))
        parts = both if parts is None else parts.unionByName(both)
    return parts.distinct().select("src", F.col("process").alias("dst"), F.lit("ENTRY_POINT_OF").alias("type"), F.lit(0.85).alias("confidence"), F.lit("process-entry").alias("reason"), F.lit(None).cast("int").alias("step"))


def heritage_edges(parents: DataFrame, resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """EXTENDS or IMPLEMENTS edges: parents (site, child, kind) with targets resolved (site, id, confidence).

    An interface parent of something that is none is implemented; otherwise the kind as written counts.
    """
    k = nodes.select(F.col("id").alias("dst"), F.col("label").alias("target"))
    own = nodes.select(F.col("id").alias("src"), F.col("label").alias("own"))
    j = parents.select("site", F.col("child").alias("src"), "kind").join(resolved.select("site", F.col("id").alias("dst"), "confidence"), "site").join(k, "dst").join(own, "src")
    kind = F.when((F.col("target") == "Interface") & (F.col("own") != "Interface"), "IMPLEMENTS").otherwise(F.coalesce("kind", F.lit("EXTENDS")))
    return j.where("src <> dst").select("src", "dst", kind.alias("type"), "confidence", F.lit("heritage").alias("reason"), F.lit(None).cast("int").alias("step")).distinct()


def first_strategy(imports: DataFrame, strategies: list[DataFrame]) -> DataFrame:
    """(file, spec, target) of the first strategy (file, spec, target) that knows an import."""
    out = imports.select("file", "spec").distinct()
    names = []
    for number, part in enumerate(strategies):
        name = f"t{number}"
        out = out.join(part.groupBy("file", "spec").agg(F.min("target").alias(name)), ["file", "spec"], "left")
        names.append(name)
    return out.select("file", "spec", F.coalesce(*names).alias("target"))


def dispatch_index(mro: DataFrame, heritage: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class -> ordered ancestors, interface -> implementors) as two tables."""
    order = mro.groupBy("child").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ancestor"))), lambda x: x["ancestor"]).alias("mro"))
    impl = heritage.where("kind = 'IMPLEMENTS'").groupBy(F.col("parent").alias("interface")).agg(F.array_sort(F.collect_set("child")).alias("implementors"))
    return order, impl


# ---- groups of repositories -----------------------------------------------------------------------------------


def http_contracts(routes: DataFrame, fetches: DataFrame) -> DataFrame:
    """Contracts of a graph's routes (repo, uid, url, method, filePath) and fetches (repo, uid, url, method, filePath)."""
    one = lambda df, role, path, weight: df.select(
        "repo",
        F.lit(None).cast("string").alias("service"),
        F.concat(F.lit("http::"), F.upper(F.coalesce("method", F.lit("*" if role == "consumer" else "GET"))), F.lit("::"), path).alias("contract_id"),
        F.lit("http").alias("type"),
        F.lit(role).alias("role"),
        F.col("uid").alias("symbol_uid"),
        F.col("filePath").alias("file_path"),
        F.lit("").alias("ref_name"),
        F.lit("").alias("symbol_name"),
        F.lit(weight).alias("confidence"),
        F.lit("graph").alias("source"),
        F.xxhash64("uid", "url").alias("seq"),
    )
    return one(routes, "provider", normalize_http_path("url"), 1.0).unionByName(one(fetches, "consumer", normalize_consumer_path("url"), 0.9))


def manifest_links(declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts, links) of declared links (from_repo, to_repo, contract_id, type); ends without a symbol get a synthetic uid."""
    uid = lambda side: F.concat(F.lit("manifest::"), F.col(f"{side}_repo"), F.lit("::"), F.col("contract_id"))
    none = F.lit(None).cast("string")

    def part(side: str, role: str) -> DataFrame:
        return declared.select(F.col(f"{side}_repo").alias("repo"), none.alias("service"), "contract_id", "type", F.lit(role).alias("role"), uid(side).alias("symbol_uid"), F.lit("").alias("file_path"), F.lit("").alias("ref_name"), F.col("contract_id").alias("symbol_name"), F.lit(1.0).alias("confidence"), F.lit("manifest").alias("source"), F.xxhash64(f"{side}_repo", "contract_id").alias("seq"))

    sides = [F.col(f"{s}_repo").alias(f"{s}_repo") for s in ("from", "to")]
    links = declared.select(sides[0], none.alias("from_service"), uid("from").alias("from_symbol_uid"), F.lit("").alias("from_file_path"), F.lit("").alias("from_ref_name"), sides[1], none.alias("to_service"), uid("to").alias("to_symbol_uid"), F.lit("").alias("to_file_path"), F.lit("").alias("to_ref_name"), "type", "contract_id", F.lit("manifest").alias("match_type"), F.lit(1.0).alias("confidence"))
    return part("from", "consumer").unionByName(part("to", "provider")), links


def sync_group(extracted: DataFrame, boundaries: DataFrame, declared: DataFrame | None = None, **noise) -> tuple[DataFrame, DataFrame]:
    """(contracts, links) of a group: services assigned by the deepest boundary (repo, prefix), declared links added, matched, de-duplicated."""
    keyed = extracted.withColumn("path", F.concat_ws("/", "repo", "file_path"))
    deepest = longest_prefix(keyed.select("path").distinct(), boundaries.select(F.concat_ws("/", "repo", "prefix").alias("prefix")))
    services = keyed.join(deepest, "path", "left").withColumn("service", F.coalesce("service", "prefix")).select(*extracted.columns)
    whole, links = services, None
    if declared is not None:
        more, links = manifest_links(declared)
        whole = whole.unionByName(more)
    contracts = c.dedupe_contracts(whole)
    found = c.match(contracts, **noise)
    return contracts, c.prefer_manifest(c.dedupe_links(found if links is None else found.unionByName(links)))


def is_exported(language: Column, name: Column, header: Column) -> Column:
    """Public symbols by language: keywords of the declaration, capitals in Go, no underscore in Python."""
    header = F.coalesce(header, F.lit(""))
    return (
        F.when(language.isin("javascript", "typescript", "vue"), header.rlike(r"\bexport\b|module\.exports"))
        .when(language == "python", ~name.startswith("_"))
        .when(language == "go", name.rlike(r"^\p{Lu}"))
        .when(language.isin("java", "csharp", "php", "kotlin", "dart"), ~header.rlike(r"\b(private|protected|internal)\b") & ((language != "dart") | ~name.startswith("_")) & (~language.isin("java", "csharp") | header.rlike(r"\bpublic\b")))
        .when(language == "rust", header.rlike(r"\bpub\b"))
        .when(language == "swift", header.rlike(r"\b(public|open)\b"))
        .when(language.isin("c", "cpp"), ~header.rlike(r"\bstatic\b"))
        .otherwise(F.lit(True))
    )
