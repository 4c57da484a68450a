"""File tree, graph maintenance and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Graph, label_of
from ..session import stored


def folders_and_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(id, label, name, file_path, parent_id) of every file and of all folders above."""
    parts = F.split(F.col("p"), "/")
    every = paths.select(F.col(path).alias("p")).distinct().select(parts.alias("s"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("i"))
    join = lambda n: F.array_join(F.slice("s", F.lit(1), n), "/")
    rows = every.select(F.when(F.col("i") == F.size("s"), "File").otherwise("Folder").alias("label"), join(F.col("i")).alias("file_path"), F.element_at("s", F.col("i")).alias("name"), F.when(F.col("i") > 1, F.concat(F.lit("Folder:"), join(F.col("i") - 1))).alias("parent_id"))
    return rows.select(F.concat_ws(":", "label", "file_path").alias("id"), "label", "name", "file_path", "parent_id").distinct()


def contains_edges(tree: DataFrame) -> DataFrame:
    return tree.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("type"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("int").alias("step"))


def stats(graph: Graph) -> DataFrame:
    """(kind, name, n): nodes by label and edges by type."""
    n = graph.nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return n.unionByName(graph.edges.groupBy(F.col("type").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def insert_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """Append; on equal ids what is there stays."""
    fresh = rows.join(graph.nodes.select("id"), "id", "left_anti").dropDuplicates(["id"])
    return Graph(graph.nodes.unionByName(fresh, allowMissingColumns=True), graph.edges)


def upsert_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """Replace nodes of equal id, add the others."""
    kept = graph.nodes.join(rows.select("id").distinct(), "id", "left_anti")
    return Graph(kept.unionByName(rows.dropDuplicates(["id"]), allowMissingColumns=True), graph.edges)


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """Nodes of the files, every edge at them, and folders left without files."""
    gone = stored(graph.nodes.join(paths.select("filePath").distinct(), "filePath", "left_semi").select("id").distinct(), "nodes-of-files")
    nodes = graph.nodes.join(gone, "id", "left_anti")
    folders = nodes.where("label = 'Folder'").select(F.col("id").alias("fid"), F.col("filePath").alias("folder"))
    parts = F.split("filePath", "/")
    used = nodes.where("label = 'File'").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    empty = folders.join(used, "folder", "left_anti").select(F.col("fid").alias("id"))
    gone = stored(gone.unionByName(empty), "gone-nodes")  # used three times: by nodes and by both ends of edges
    nodes = graph.nodes.join(gone, "id", "left_anti")
    edges = graph.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return Graph(nodes, edges.select(*graph.edges.columns))


def drop_derived(graph: Graph) -> Graph:
    """Without communities, processes and their edges."""
    nodes = graph.nodes.where("label NOT IN ('Community', 'Process')")
    edges = graph.edges.where("type NOT IN ('MEMBER_OF', 'STEP_IN_PROCESS', 'ENTRY_POINT_OF')")
    return Graph(nodes, edges)


def update_contents(graph: Graph, updates: DataFrame) -> Graph:
    """New contents (id, content) over old ones."""
    new = updates.select("id", F.col("content").alias("__new")).dropDuplicates(["id"])
    nodes = graph.nodes.join(new, "id", "left").withColumn("content", F.coalesce("__new", "content")).drop("__new")
    return Graph(nodes.select(*graph.nodes.columns), graph.edges)


def split_by_labels(edges: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges with from_label and to_label, edges dropped because a label has no table)."""
    e = edges.withColumn("from_label", label_of("src")).withColumn("to_label", label_of("dst"))
    fits = F.col("from_label").isin(labels) & F.col("to_label").isin(labels)
    return e.where(fits), e.where(~fits)


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = ("src", "dst", "type")) -> DataFrame:
    """One edge per key, the most confident; ties to the smallest reason."""
    from .relational import top_per_key

    return top_per_key(edges.withColumn("__k", F.concat_ws("\u0001", *keys)), "__k", [F.desc_nulls_last("confidence"), "reason", "step"], 1).drop("__k")
