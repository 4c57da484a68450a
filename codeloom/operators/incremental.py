"""Incremental maintenance: plans, write sets, subgraphs, body-only updates, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph
from ..session import stored
from .relational import hash_diff
from .traverse import closure

# Importer depth, share of files above which all is rebuilt, least number of files for that share.
IMPORTER_DEPTH, REBUILD_SHARE, REBUILD_LEAST, BODY_ONLY_FILES = 4, 0.4, 20, 5


def plan(diff: DataFrame, *, dirty: bool = False, forced: bool = False, schema_changed: bool = False, has_hashes: bool = True, has_git: bool = True, config_changed: bool = False) -> tuple[str, str]:
    """(full | incremental | none, reason) of a build over a hash diff (path, status)."""
    for flag, reason in ((forced, "forced"), (dirty, "dirty"), (schema_changed, "schema"), (not has_hashes, "no-hashes"), (not has_git, "no-git"), (config_changed, "config")):
        if flag:
            return "full", reason
    return ("none", "unchanged") if diff.where("status <> 'unchanged'").isEmpty() else ("incremental", "changed")


def write_set(diff: DataFrame, imports: DataFrame, depth: int = IMPORTER_DEPTH) -> tuple[DataFrame | None, str]:
    """(paths to rewrite, reason): changed and added files with their importers up to ``depth``; None for a full rebuild.

    imports (src, dst) are the stored edges, from before the change.
    """
    changed = diff.where("status IN ('added', 'changed', 'deleted')").select(F.col("path").alias("id"))
    edges = imports.select("src", "dst", F.lit("IMPORTS").alias("type"), F.lit(1.0).alias("confidence"))
    reached, complete = closure(edges, changed, "up", depth)
    if not complete:
        return None, "importers too deep"
    gone = diff.where("status = 'deleted'").select(F.col("path").alias("id"))
    paths = reached.select("id").join(gone, "id", "left_anti").withColumnRenamed("id", "path")
    total, n = diff.where("status <> 'deleted'").count(), paths.count()
    if total >= REBUILD_LEAST and n > REBUILD_SHARE * total:
        return None, "too many files"
    return paths, "ok"


def boundary(paths: DataFrame, imports: DataFrame) -> DataFrame:
    """The write set and the files one import away."""
    near = imports.join(paths.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"))
    return paths.select("path").unionByName(near).distinct()


def changed_subgraph(graph: Graph, paths: DataFrame) -> Graph:
    """Nodes of the paths, graph-wide nodes, folders above; edges with an end in the paths and both ends kept."""
    mine = graph.nodes.join(paths.select(F.col("path").alias("filePath")), "filePath", "left_semi")
    parts = F.split("path", "/")
    folders = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("filePath")).distinct()
    wide = graph.nodes.where("label IN ('Community', 'Process', 'Route', 'Tool')")
    above = graph.nodes.where("label = 'Folder'").join(folders, "filePath", "left_semi").select(*graph.nodes.columns)
    nodes = stored(mine.select(*graph.nodes.columns).unionByName(wide).unionByName(above).dropDuplicates(["id"]), "changed-nodes")
    ids, own = nodes.select("id"), nodes.join(paths.select(F.col("path").alias("filePath")).distinct(), "filePath", "left_semi").select("id")
    kept = stored(graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi"), "changed-edges")
    a = kept.join(own.withColumnRenamed("id", "src"), "src", "left_semi").select(*graph.edges.columns)
    b = kept.join(own.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*graph.edges.columns)
    return Graph(nodes, a.unionByName(b).distinct())


def shadow_candidates(added: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, shadowed): existing spellings that a new file may now win over (other extension or index file)."""
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    bare = F.regexp_replace(stem, r"/index$", "")
    names = F.array_distinct(F.concat(F.array(*[F.concat(bare, F.lit(e)) for e in extensions]), F.array(*[F.concat(bare, F.lit(f"/index{e}")) for e in extensions])))
    return added.select("path", F.explode(names).alias("shadowed")).where("path <> shadowed")


def call_signature(content: Column | str) -> Column:
    """Ordered names in call position: equal signatures mean that only bodies changed."""
    content = F.col(content) if isinstance(content, str) else content
    return F.array_join(F.regexp_extract_all(content, F.lit(r"([A-Za-z_$][\w$.]*)\s*\("), 1), ",")


def body_only(changes: DataFrame) -> DataFrame:
    """changes (path, old, new) with ok and reason: same number of lines and same calls."""
    lines = lambda c: F.size(F.split(c, "\n"))
    reason = F.when(lines("old") != lines("new"), "line-count").when(call_signature("old") != call_signature("new"), "calls")
    return changes.withColumn("reason", reason).withColumn("ok", reason.isNull())


def fresh_overlays(overlays: DataFrame, hashes: DataFrame) -> DataFrame:
    """Overlays (path, hash, content) whose hash is still the file's."""
    return overlays.join(hashes.select("path", "hash").distinct(), ["path", "hash"], "left_semi")


def apply_overlays(files: DataFrame, overlays: DataFrame) -> DataFrame:
    new = overlays.select("path", F.col("content").alias("__new"))
    return files.join(new, "path", "left").withColumn("content", F.coalesce("__new", "content")).drop("__new")


def rebuild_equals(left: DataFrame, right: DataFrame) -> bool:
    """Equivalence check: both differences (with repeats) are empty."""
    cols = sorted(left.columns)
    return left.select(cols).exceptAll(right.select(cols)).isEmpty() and right.select(cols).exceptAll(left.select(cols)).isEmpty()


__all__ = ["apply_overlays", "body_only", "boundary", "call_signature", "changed_subgraph", "fresh_overlays", "hash_diff", "plan", "rebuild_equals", "shadow_candidates", "write_set"]
