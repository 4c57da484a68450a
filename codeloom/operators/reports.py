"""The public query API as DataFrame functions: context, impact, changes, rename, routes, shapes, overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import reason_fetches, reason_keys
from ..functions.risk import api_risk, change_risk
from ..model import Graph
from .analytics import aggregate_clusters
from .relational import overlapped

# Kind bonus of symbol candidates.
KIND_PRIORITY = {"Class": 5, "Interface": 4, "Function": 3, "Method": 2, "Constructor": 1}
#: Tasks over which the clones of one remote are dealt.
CLONE_PARTS = 16


def symbol_candidates(nodes: DataFrame, name: str, file_path: str | None = None, kind: str | None = None) -> DataFrame:
    """Nodes of a name with their score, best first: score, shorter path, id. A class hides its own constructors."""
    n = nodes.where((F.col("name") == name) | (F.col("id") == name))
    classes = n.where("label = 'Class'").select("filePath").distinct().withColumn("c", F.lit(True))
    n = n.join(classes, "filePath", "left").where("NOT (label = 'Constructor' AND coalesce(c, false))").drop("c")
    score = F.lit(0.5)
    if file_path:
        score = score + F.when(F.lower("filePath").contains(file_path.lower()), 0.4).otherwise(0.0)
    if kind:
        score = score + F.when(F.col("label") == kind, 0.2).otherwise(0.0)
    else:
        weights = F.create_map(*[F.lit(x) for p in KIND_PRIORITY.items() for x in p])
        score = score + F.coalesce(weights[F.col("label")], F.lit(0)) * 0.02
    return n.withColumn("score", F.least(F.lit(1.0), score)).orderBy(F.desc("score"), F.length("filePath"), "id")


def resolve_symbol(nodes: DataFrame, name: str, **hints) -> tuple[str, list[str]]:
    """(ok | ambiguous | not_found, ids): one id for ok, up to 20 candidates else."""
    rows = symbol_candidates(nodes, name, **hints).select("id", "score").limit(20).collect()
    if not rows:
        return "not_found", []
    if len(rows) == 1 or rows[0]["score"] >= 0.95 and rows[0]["score"] - rows[1]["score"] > 0.09:
        return "ok", [rows[0]["id"]]
    return "ambiguous", [r["id"] for r in rows]


def context(graph: Graph, ids: DataFrame, limit: int = 30) -> DataFrame:
    """Each symbol (id) with incoming and outgoing references by lower-cased type, and its processes.

    The two sides are aggregated apart, so they don't multiply. At most ``limit`` references per side and type, in
    a stated order (type, other id).
    """
    asked = graph.dealt(ids.select("id"), "id")

    def side(near: str, far: str, name: str) -> DataFrame:
        e = graph.dealt(graph.edges.where("type <> 'STEP_IN_PROCESS' AND type <> 'MEMBER_OF'"), near).join(asked.withColumnRenamed("id", near), near, "left_semi")
        w = Window.partitionBy(near, "type").orderBy(far)
        top = e.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
        per = top.groupBy(F.col(near).alias("id"), F.lower("type").alias("rel")).agg(F.sort_array(F.collect_list(far)).alias("refs"))
        return per.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rel", "refs")))).alias(name))

    flows = graph.dealt(graph.type("STEP_IN_PROCESS"), "src").join(asked.withColumnRenamed("id", "src"), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("processes"))
    return asked.join(graph.dealt(graph.nodes, "id"), "id").join(side("dst", "src", "incoming"), "id", "left").join(side("src", "dst", "outgoing"), "id", "left").join(flows, "id", "left")


def detect_changes(hunks: DataFrame, symbols: DataFrame, steps: DataFrame, width: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(touched symbols, affected processes, risk): hunks (filePath, startLine, endLine), symbols (id, filePath, startLine, endLine), steps (id, process, step)."""
    left = hunks.select("filePath", F.col("startLine").alias("start"), F.col("endLine").alias("end"))
    right = symbols.where("startLine IS NOT NULL AND endLine IS NOT NULL").select("filePath", "id", F.col("startLine").alias("r_start"), F.col("endLine").alias("r_end"))
    touched = overlapped(left, right, "filePath", width).select("id", "filePath").distinct()
    affected = steps.join(touched.select("id"), "id", "left_semi").groupBy("process").agg(F.countDistinct("id").alias("changed_steps"), F.min("step").alias("first_step"))
    risk = affected.agg(F.count(F.lit(1)).alias("affected_processes")).withColumn("risk", change_risk(F.col("affected_processes")))
    return touched, affected, risk


def rename_preview(files: DataFrame, old: str, new: str, defined_in: DataFrame, referring: DataFrame) -> DataFrame:
    """(filePath, line, before, after, source): all lines of the defining files, the first of each referring file (graph), every line elsewhere (text_search)."""
    pattern = rf"\b{old}\b"
    lines = files.select("filePath", F.posexplode(F.split("content", "\n")).alias("n", "before")).where(F.col("before").rlike(pattern))
    edits = lines.select("filePath", (F.col("n") + 1).alias("line"), "before", F.regexp_replace("before", pattern, new).alias("after"))
    d = defined_in.select("filePath").distinct()
    r = referring.select("filePath").distinct().join(d, "filePath", "left_anti")
    first = edits.join(r, "filePath", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("filePath").orderBy("line"))).where("k = 1").drop("k")
    graph_edits = edits.join(d, "filePath", "left_semi").unionByName(first).withColumn("source", F.lit("graph"))
    text_edits = edits.join(d.unionByName(r), "filePath", "left_anti").withColumn("source", F.lit("text_search"))
    return graph_edits.unionByName(text_edits)


def route_map(routes: DataFrame, fetches: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """Routes (id, name, ..) with consumers (consumer, keys, fetches) and flows (id, process)."""
    parsed = fetches.select(F.col("route").alias("id"), F.struct("consumer", reason_keys("reason").alias("keys"), reason_fetches("reason").alias("fetches")).alias("c"))
    grouped = parsed.groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("consumers"))
    out = routes.join(grouped, "id", "left").withColumn("n_consumers", F.greatest(F.lit(0), F.coalesce(F.size("consumers"), F.lit(0))))
    if flows is not None:
        out = out.join(flows.groupBy("id").agg(F.sort_array(F.collect_set("process")).alias("flows")), "id", "left")
    return out


def shape_check(routes: DataFrame, fetches: DataFrame) -> DataFrame:
    """(id, consumer, mismatched, error_only, confidence): keys read that the route doesn't return.

    error_only: keys read that only error responses have. Confidence is low for consumers of several routes.
    """
    known = routes.select("id", F.coalesce("responseKeys", F.array().cast("array<string>")).alias("ok"), F.coalesce("errorKeys", F.array().cast("array<string>")).alias("err"))
    used = fetches.select(F.col("route").alias("id"), "consumer", reason_keys("reason").alias("keys"), reason_fetches("reason").alias("n"))
    j = used.join(known, "id")
    out = j.select("id", "consumer", F.array_except("keys", F.array_union("ok", "err")).alias("mismatched"), F.array_except(F.array_intersect("keys", "err"), "ok").alias("error_only"), F.when(F.col("n") > 1, "low").otherwise("high").alias("confidence"))
    return out


def api_impact(routes: DataFrame, fetches: DataFrame, flows: DataFrame | None = None) -> DataFrame:
    """(id, n_consumers, n_mismatches, risk) of every route."""
    bad = shape_check(routes, fetches).groupBy("id").agg(F.sum(F.size("mismatched")).alias("n_mismatches"))
    per = route_map(routes, fetches, flows).join(bad, "id", "left").withColumn("n_mismatches", F.coalesce("n_mismatches", F.lit(0)))
    return per.withColumn("risk", api_risk(F.col("n_consumers"), F.col("n_mismatches") > 0))


def tool_map(tools: DataFrame, handlers: DataFrame, flows: DataFrame) -> DataFrame:
    """Tools (id, name, filePath, description) with handlers (id, handler) and flows (id, process)."""
    h = handlers.groupBy("id").agg(F.sort_array(F.collect_set("handler")).alias("handlers"))
    f = flows.groupBy("id").agg(F.sort_array(F.collect_set("process")).alias("flows"))
    return tools.withColumn("description", F.substring("description", 1, 200)).join(h, "id", "left").join(f, "id", "left")


def overview(communities: DataFrame, processes: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """(clusters by size, processes by steps)."""
    clusters = aggregate_clusters(communities).orderBy(F.desc("symbol_count"), "label").limit(limit)
    return clusters, processes.orderBy(F.desc("stepCount"), "id").limit(limit)


def cluster_detail(graph: Graph, name: str, limit: int = 30) -> DataFrame:
    """Members of the communities of a label."""
    comm = graph.label("Community").where((F.col("heuristicLabel") == name) | (F.col("id") == name)).select(F.col("id").alias("dst"))
    ids = graph.type("MEMBER_OF").join(comm, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return graph.nodes.join(ids, "id", "left_semi").orderBy("id").limit(limit)


def process_detail(graph: Graph, name: str) -> DataFrame:
    """Steps of a process in order."""
    flow = graph.label("Process").where((F.col("heuristicLabel") == name) | (F.col("id") == name)).select(F.col("id").alias("dst"))
    return graph.type("STEP_IN_PROCESS").join(flow, "dst", "left_semi").join(graph.nodes.select(F.col("id").alias("src"), "name", "filePath"), "src").orderBy("dst", "step")


def list_repos(repos: DataFrame, tasks: int | None = None) -> DataFrame:
    """Repositories (name, path, remoteUrl, ..) with their sibling clones: same remote, other path.

    tasks: how many tasks share the rows and build the lists (None: as Spark's settings have it). The lists of a remote
    with n clones have n * (n - 1) entries in all, whatever the plan.
    """
    keys = ["remoteUrl", "__part"]
    dealt = lambda rows, *by: rows.repartition(tasks, *by) if tasks else rows
    clones = dealt(repos.where("remoteUrl IS NOT NULL").select("remoteUrl", "path"), "remoteUrl").groupBy("remoteUrl").agg(F.sort_array(F.collect_set("path")).alias("clones"))
    # the lists are built where the rows meet: those of one remote are dealt to several tasks, each with its own copy of the list
    copies = dealt(clones.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(CLONE_PARTS - 1)))), *keys)
    parted = dealt(repos.withColumn("__part", F.pmod(F.xxhash64("path"), F.lit(CLONE_PARTS)).cast("int")), *keys)
    return parted.join(copies.hint("merge"), keys, "left").withColumn("siblings", F.when(F.size("clones") > 1, F.array_remove("clones", F.col("path")))).drop("clones", "__part")


def files_with_exports(nodes: DataFrame) -> DataFrame:
    """(filePath, symbols): exported symbols of each file."""
    return nodes.where("isExported").groupBy("filePath").agg(F.sort_array(F.collect_list(F.struct("name", "label"))).alias("symbols"))


def inter_file_calls(graph: Graph) -> DataFrame:
    """Distinct (from_file, from_name, to_file, to_name) of calls between files."""
    a = graph.nodes.select(F.col("id").alias("src"), F.col("filePath").alias("from_file"), F.col("name").alias("from_name"))
    b = graph.nodes.select(F.col("id").alias("dst"), F.col("filePath").alias("to_file"), F.col("name").alias("to_name"))
    named = graph.dealt(graph.type("CALLS").select("src", "dst"), "src").join(graph.dealt(a, "src"), "src")
    pairs = graph.dealt(named, "dst").join(graph.dealt(b, "dst"), "dst").where("from_file <> to_file").select("from_file", "from_name", "to_file", "to_name")
    return graph.dealt(pairs, *pairs.columns).distinct()


def module_calls(graph: Graph, files: DataFrame, limit: int = 30) -> dict[str, DataFrame]:
    """Calls within, into and out of a set of files (filePath); the latter two cut at ``limit`` in a stated order."""
    calls = inter_file_calls(graph)
    inside = lambda df, c, how: df.join(files.select(F.col("filePath").alias(c)).distinct(), c, how)
    order = ["from_file", "from_name", "to_file", "to_name"]
    return {
        "intra": inside(inside(calls, "from_file", "left_semi"), "to_file", "left_semi"),
        "incoming": inside(inside(calls, "to_file", "left_semi"), "from_file", "left_anti").orderBy(*order).limit(limit),
        "outgoing": inside(inside(calls, "from_file", "left_semi"), "to_file", "left_anti").orderBy(*order).limit(limit),
    }


def group_context(context_rows: DataFrame, repo: str = "repo", prefix: str | None = None) -> DataFrame:
    """Context rows of several repositories, optionally below a service path."""
    from ..functions.predicates import under_prefix

    return context_rows.where(under_prefix("filePath", prefix)) if prefix else context_rows


def consistency(left: Graph, right: Graph) -> DataFrame:
    """(what, key, left_n, right_n) where node counts by label or file, or edge counts by type, differ."""
    parts = []
    for what, a, b, key in (("label", left.nodes, right.nodes, "label"), ("file", left.nodes, right.nodes, "filePath"), ("edge", left.edges, right.edges, "type")):
        x = a.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("left_n"))
        y = b.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("right_n"))
        parts.append(x.join(y, "key", "full").select(F.lit(what).alias("what"), "key", F.coalesce("left_n", F.lit(0)).alias("left_n"), F.coalesce("right_n", F.lit(0)).alias("right_n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("left_n <> right_n")
