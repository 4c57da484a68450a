"""Changes of a graph as plans: each gives a new graph, and versions of graphs are written beside each other.

Creating is a union behind an anti join of the ids that exist, merging a full outer join by id, setting a left join
of new values, deleting with all edges one anti join of the nodes and two of the edges. Nothing is changed in place, so
a reader of the old version sees it whole, and a change that fails leaves nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import EDGE_SCHEMA, Graph
from ..sources.state import latest_folder


def _like(rows: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """rows with these columns and types, missing ones null."""
    have = {c.lower(): c for c in rows.columns}
    return rows.select(*[(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns])


def _one_each(rows: DataFrame) -> DataFrame:
    """One row for each id: of several the smallest by all columns."""
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.min(F.struct(*others)).alias("r")).select("id", "r.*").select(*rows.columns)


def create_nodes(graph: Graph, rows: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph with the new nodes, rows refused because their id exists or is null)."""
    new = _like(rows, graph.nodes.dtypes)
    known = graph.nodes.select("id")
    fresh = _one_each(new.where("id IS NOT NULL").join(known, "id", "left_anti").select(*graph.nodes.columns))
    refused = new.join(known, "id", "left_semi").select(*graph.nodes.columns).unionByName(new.where("id IS NULL"))
    return Graph(graph.nodes.unionByName(fresh), graph.edges), refused


def merge_nodes(graph: Graph, rows: DataFrame, on_create: list[str] | None = None, on_match: list[str] | None = None) -> Graph:
    """Nodes by id: new ones are made of on_create (None: all columns of rows), existing ones get on_match (None: all)."""
    given = [c for c in graph.nodes.columns if c.lower() in {x.lower() for x in rows.columns} and c != "id"]
    new = _one_each(_like(rows, graph.nodes.dtypes).where("id IS NOT NULL"))
    made = given if on_create is None else on_create
    changed = given if on_match is None else on_match
    joined = graph.nodes.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), "id", "full")
    out = [F.col("id")]
    for c in graph.nodes.columns:
        if c != "id":
            fresh = F.col(f"n.{c}") if c in made or c == "label" else F.lit(None)
            kept = F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in changed else F.col(f"o.{c}")
            out.append(F.when(F.col("__old"), kept).otherwise(fresh).alias(c))
    return Graph(joined.select(*out).select(*graph.nodes.columns), graph.edges)


def set_properties(graph: Graph, values: DataFrame) -> Graph:
    """Nodes with the columns of values (id, ...) put in their place; of several rows of an id the smallest counts."""
    names = [c for c in values.columns if c != "id"]
    kinds = dict(graph.nodes.dtypes)
    new = _one_each(values.select("id", *[F.col(c).cast(kinds[c]).alias(c) for c in names])).withColumn("__set", F.lit(True))
    joined = graph.nodes.alias("o").join(new.alias("n"), "id", "left")
    return Graph(joined.select(*[F.when(F.col("__set"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in names else F.col("id" if c == "id" else f"o.{c}") for c in graph.nodes.columns]), graph.edges)


def detach_delete(graph: Graph, ids: DataFrame) -> Graph:
    """Without these nodes (id) and without the edges at either of their ends."""
    gone = ids.select("id").distinct()
    edges = graph.edges
    for end in ("src", "dst"):
        edges = graph.dealt(edges, end).join(gone.select(F.col("id").alias("__gone")), F.col(end) == F.col("__gone"), "left_anti")
    return Graph(graph.nodes.join(gone, "id", "left_anti").select(*graph.nodes.columns), edges, graph.tasks)


def create_edges(graph: Graph, rows: DataFrame, once: bool = False, same: dict[str, Column] | None = None, matched: bool = False) -> tuple[Graph, DataFrame]:
    """(graph with the new edges, rows refused because an end is no node). once: edges that exist by (src, dst, type) stay as they are.

    same: columns with one value for all rows, put in last. matched: the ends were taken from the graph's nodes, so only null ids are refused.
    """
    keys = ["src", "dst", "type"]
    whole = lambda df: _like(df.withColumns(same) if same else df, graph.edges.dtypes)
    given = {c.lower() for c in rows.columns}
    new = _like(rows, [(c, kind) for c, kind in graph.edges.dtypes if c in keys or c.lower() in given])
    if matched:
        good, bad = new.where("src IS NOT NULL AND dst IS NOT NULL"), new.where("src IS NULL OR dst IS NULL")
    else:
        ids = graph.nodes.select(F.col("id").alias("__id"))
        good = new.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_semi")
        bad = new.join(ids, F.col("src") == F.col("__id"), "left_anti").unionByName(new.join(ids, F.col("src") == F.col("__id"), "left_semi").join(ids, F.col("dst") == F.col("__id"), "left_anti"))
    if once:
        # The filter is written out here: known edges that this step made before then have the plan of good, and one exchange serves both.
        known = graph.edges.where("src IS NOT NULL AND dst IS NOT NULL").select(*[F.col(c).alias(f"__{c}") for c in keys])
        good = graph.dealt(good, "src", "dst").dropDuplicates(keys).join(known, [F.col(c) == F.col(f"__{c}") for c in keys], "left_anti")
    return Graph(graph.nodes, graph.edges.unionByName(whole(good)), graph.tasks), whole(bad)


def copy_from(graph: Graph, label: str, path: str) -> tuple[Graph, DataFrame]:
    """Nodes of a label read from Parquet files, or from CSV files with a header; and the refused rows."""
    spark = graph.nodes.sparkSession
    rows = spark.read.csv(path, header=True) if path.rstrip("/").endswith(".csv") else spark.read.parquet(path)
    return create_nodes(graph, rows.withColumn("label", F.lit(label)))


# ---- versions


def save_version(graph: Graph, root: str) -> str:
    """Write the graph as a version of its own below root; a version counts once its edges, written last, are complete."""
    name = uuid.uuid4().hex
    graph.nodes.write.partitionBy("label").parquet(f"{root}/{name}/nodes")
    graph.edges.write.partitionBy("type").parquet(f"{root}/{name}/edges")
    return name


def latest_version(spark: SparkSession, root: str) -> Graph | None:
    """The newest complete version; None if there is none."""
    name = latest_folder(spark, root, "edges/_SUCCESS")
    if name is None:
        return None
    return Graph(spark.read.parquet(f"{root}/{name}/nodes"), spark.read.schema(EDGE_SCHEMA).parquet(f"{root}/{name}/edges"))
