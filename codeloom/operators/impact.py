"""Blast radius of a change: search, enrichment by processes and modules, risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import effective_confidence, is_test_path, min_confidence, relation_filter
from ..functions.risk import impact_risk, merged_risk
from ..model import Graph
from .traverse import bfs

# Relation types that carry impact by default, by name and by uid, and those that may be asked for.
DEFAULT_BY_NAME = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS", "USES"]
DEFAULT_BY_UID = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "METHOD_OVERRIDES", "METHOD_IMPLEMENTS"]
CLASS_EXTRA = ["ACCESSES"]
ALLOWED = ["CALLS", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HAS_METHOD", "HAS_PROPERTY", "METHOD_OVERRIDES", "OVERRIDES", "METHOD_IMPLEMENTS", "ACCESSES", "HANDLES_ROUTE", "FETCHES", "HANDLES_TOOL", "ENTRY_POINT_OF", "WRAPS"]
CLASS_LABELS = ["Class", "Interface", "Struct", "Record"]


def class_seeds(graph: Graph, target: DataFrame) -> DataFrame:
    """A class stands for itself, its constructors, its defining file and the properties typed with it."""
    t = target.join(graph.nodes.select("id", "label", "name"), "id").where(F.col("label").isin(CLASS_LABELS)).select("id", "name")
    e = graph.edges
    constructors = e.where("type = 'HAS_METHOD'").join(t, F.col("src") == F.col("id")).select(F.col("dst").alias("x")).join(graph.label("Constructor").select(F.col("id").alias("x")), "x", "left_semi")
    files = e.where("type = 'DEFINES'").join(t, F.col("dst") == F.col("id")).select(F.col("src").alias("x"))
    out = target.select("id").unionByName(constructors.select(F.col("x").alias("id"))).unionByName(files.select(F.col("x").alias("id")))
    if "declaredType" in graph.nodes.columns:
        from .relational import typed_as

        typed = typed_as(graph.label("Property").where("declaredType IS NOT NULL").select(F.col("id").alias("x"), "declaredType"), t.select("name"))
        out = out.unionByName(typed.select(F.col("x").alias("id")))
    return out.distinct()


def impact(graph: Graph, seeds: DataFrame, direction: str = "upstream", max_depth: int = 3, relation_types: list[str] | None = None, include_tests: bool = False, confidence: float = 0.0, default_types: list[str] | None = None) -> DataFrame:
    """(id, depth, parent, type, confidence) of what depends on the seeds (upstream) or what they depend on.

    Depth is clamped to 1..32 and the confidence floor to 0..1. Test files are neither reported nor walked through.
    """
    edges = relation_filter(graph.edges, relation_types, ALLOWED, default_types or DEFAULT_BY_NAME)
    edges = min_confidence(edges, min(1.0, max(0.0, confidence)))
    allowed = None
    if not include_tests and "filePath" in graph.nodes.columns:
        allowed = graph.nodes.where(~F.coalesce(is_test_path("filePath"), F.lit(False))).select("id")
    found = bfs(edges, seeds, "up" if direction == "upstream" else "down", min(32, max(1, max_depth)), allowed)
    return found.withColumn("confidence", effective_confidence())


def affected_processes(found: DataFrame, steps: DataFrame) -> DataFrame:
    """(process, hits, min_step): distinct impacted steps and the earliest; steps (id, process, step)."""
    return steps.join(found.select("id").distinct(), "id", "left_semi").groupBy("process").agg(F.countDistinct("id").alias("hits"), F.min("step").alias("min_step"))


def affected_modules(found: DataFrame, members: DataFrame, limit: int | None = 20) -> DataFrame:
    """(module, hits, impact): modules with distinct hits, direct if depth 1 is among them; members (id, module)."""
    out = found.join(members, "id").groupBy("module").agg(F.countDistinct("id").alias("hits"), F.when(F.max((F.col("depth") == 1).cast("int")) == 1, "direct").otherwise("indirect").alias("impact"))
    return out.orderBy(F.desc("hits"), "module").limit(limit) if limit else out


def summary(found: DataFrame, processes: DataFrame, modules: DataFrame) -> DataFrame:
    """One row: direct, total, processes, modules, risk."""
    a = found.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("depth") == 1).alias("direct"))
    p, m = processes.agg(F.count(F.lit(1)).alias("processes")), modules.agg(F.count(F.lit(1)).alias("modules"))
    one = a.crossJoin(p).crossJoin(m)  # three single rows
    return one.withColumn("risk", impact_risk(F.col("direct"), F.col("processes"), F.col("modules"), F.col("total")))


def cross_repo(edges: DataFrame, seeds: DataFrame, repo_of: DataFrame, links: DataFrame, local_depth: int = 3, far_depth: int = 1, direction: str = "up") -> DataFrame:
    """Two phases: search inside the seeds' repositories, cross contract links once, search in the neighbours.

    edges must stay inside a repository; links (from_id, to_id, confidence) cross them; repo_of (id, repo).
    Returns (id, repo, depth, phase, link_confidence).
    """
    local = bfs(edges, seeds, direction, local_depth)
    whole = local.select("id", "depth").unionByName(seeds.select("id", F.lit(0).alias("depth"))).groupBy("id").agg(F.min("depth").alias("depth"))
    near, far = ("to_id", "from_id") if direction == "up" else ("from_id", "to_id")
    entry = links.select(F.col(near).alias("id"), F.col(far).alias("other"), "confidence").join(whole.select("id"), "id").groupBy(F.col("other").alias("id")).agg(F.max("confidence").alias("link_confidence"))
    entry = entry.join(whole.select("id"), "id", "left_anti")
    beyond = bfs(edges, entry, direction, far_depth).select("id", F.col("depth")).join(entry.select("id"), "id", "left_anti")
    phase2 = entry.select("id", F.lit(0).alias("depth"), "link_confidence").unionByName(beyond.withColumn("link_confidence", F.lit(None).cast("double")))
    phase2 = phase2.join(whole.select("id"), "id", "left_anti")
    out = local.select("id", "depth", F.lit("local").alias("phase"), F.lit(None).cast("double").alias("link_confidence")).unionByName(phase2.select("id", "depth", F.lit("cross").alias("phase"), "link_confidence"))
    return out.join(repo_of, "id")


def cross_risk(local_risk: str, crossed: DataFrame) -> DataFrame:
    """One row (risk) from the local class and the contract links crossed."""
    return crossed.where("phase = 'cross' AND link_confidence IS NOT NULL").agg(merged_risk(F.lit(local_risk), F.count(F.lit(1)), F.max("link_confidence")).alias("risk"))
