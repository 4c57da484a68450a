"""Text views of results (Markdown, text for agents, resources) and the registry of repositories."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Graph
from ..operators import reports, structure

#: Rows that a formatter takes from a result; a view on a screen, not a limit of a query.
MAX_ROWS = 200


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, (list, dict, tuple)):
        value = json.dumps(value.asDict(recursive=True) if hasattr(value, "asDict") else value, default=str, ensure_ascii=False)
    return str(value).replace("|", "\\|").replace("\n", " ")


def markdown_table(df: DataFrame, limit: int = MAX_ROWS) -> tuple[str, int]:
    """(table, number of rows shown)"""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " --- |" * len(df.columns)
    return head + "".join("\n| " + " | ".join(_cell(v) for v in r) + " |" for r in rows), len(rows)


def impact_text(target: str, found: DataFrame, summary: DataFrame) -> str:
    """Blast radius by depth, for reading."""
    s = summary.first()
    lines = [f"{target}: risk {s['risk']}, {s['direct']} direct, {s['total']} in all, {s['processes']} processes, {s['modules']} modules"]
    for r in found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.slice(F.sort_array(F.collect_list("id")), 1, 10).alias("ids")).orderBy("depth").collect():
        lines.append(f"depth {r['depth']}: {r['n']} - {', '.join(r['ids'])}" + (" ..." if r["n"] > len(r["ids"]) else ""))
    return "\n".join(lines)


def search_text(results: DataFrame) -> str:
    return "\n".join(f"{r['rank']}. {r[results.columns[0]]} ({r['score']:.4f}; {r['sources']})" for r in results.orderBy("rank").limit(MAX_ROWS).collect())


def resource(graph: Graph, uri: str, communities: DataFrame | None = None, processes: DataFrame | None = None) -> DataFrame:
    """Named views: schema, stats, clusters, processes, cluster/<name>, process/<name>."""
    kind, _, name = uri.partition("/")
    if kind == "stats":
        return structure.stats(graph)
    if kind == "schema":
        return graph.nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label")
    if kind == "clusters":
        return reports.overview(communities, processes)[0]
    if kind == "processes":
        return reports.overview(communities, processes)[1]
    if kind == "cluster":
        return reports.cluster_detail(graph, name)
    if kind == "process":
        return reports.process_detail(graph, name)
    raise KeyError(f"unknown resource {uri}")


REPO_COLUMNS = "id string, name string, path string, remoteUrl string, indexedCommit string, headCommit string, behind int, indexedAt string"


def resolve_repo(repos: DataFrame, wanted: str | None) -> str:
    """The id of one repository: by id, name, path, then part of the name; an error for none or several."""
    rows = repos.select("id", "name", "path").orderBy("id").collect()  # the registry: one row per indexed repository
    if not wanted:
        if len(rows) == 1:
            return rows[0]["id"]
        raise LookupError("name a repository: " + ", ".join(r["name"] for r in rows))
    for test in (lambda r: r["id"] == wanted, lambda r: r["name"] == wanted, lambda r: r["path"] == wanted, lambda r: wanted.lower() in (r["name"] or "").lower()):
        hit = [r["id"] for r in rows if test(r)]
        if len(hit) == 1:
            return hit[0]
        if hit:
            raise LookupError(f"{wanted} is ambiguous: {', '.join(hit)}")
    raise LookupError(f"no repository {wanted}")


def staleness(repos: DataFrame) -> DataFrame:
    """Repositories with ``stale``: the index is behind the head commit."""
    return repos.withColumn("stale", F.coalesce(F.col("behind") > 0, F.col("indexedCommit") != F.col("headCommit"), F.lit(False)))


def group_status(members: DataFrame, repos: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Members of a group with index and contract staleness; missing ones show as such."""
    j = members.join(staleness(repos).select(F.col("name").alias("repo"), "stale", "indexedCommit"), "repo", "left").join(snapshots.select("repo", F.col("commit").alias("contractCommit")), "repo", "left")
    return j.withColumn("indexed", F.col("indexedCommit").isNotNull()).withColumn("contracts_stale", F.coalesce(F.col("contractCommit") != F.col("indexedCommit"), F.lit(True)))


def register(spark: SparkSession, rows: list[tuple], path: str) -> None:
    """Add or replace repositories in the registry table (driver-sized)."""
    new = spark.createDataFrame(rows, REPO_COLUMNS)
    try:
        old = spark.createDataFrame(spark.read.parquet(path).join(new.select("id"), "id", "left_anti").select(*new.columns).collect(), REPO_COLUMNS)
    except Exception as error:  # a first registration has no table yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = spark.createDataFrame([], REPO_COLUMNS)
    old.unionByName(new).coalesce(1).write.mode("overwrite").parquet(path)
