"""Schemas of the property graph: one wide node table, one edge table, and a small container for both."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Persisted node labels.
NODE_LABELS = (
    "File Folder Function Class Interface Method CodeElement Community Process Struct Enum Macro Typedef Union Namespace Trait "
    "Impl TypeAlias Const Static Variable Property Record Delegate Annotation Constructor Template Module Route Tool Section"
).split()
#: Relation types.
RELATION_TYPES = (
    "CONTAINS DEFINES IMPORTS CALLS EXTENDS IMPLEMENTS HAS_METHOD HAS_PROPERTY ACCESSES USES METHOD_OVERRIDES OVERRIDES "
    "METHOD_IMPLEMENTS MEMBER_OF STEP_IN_PROCESS HANDLES_ROUTE FETCHES HANDLES_TOOL ENTRY_POINT_OF QUERIES WRAPS INHERITS DECORATES"
).split()

_TEXT = T.StringType()
NODE_SCHEMA = T.StructType(
    [T.StructField(n, _TEXT) for n in ("id", "label", "name", "filePath")]
    + [T.StructField(n, T.LongType()) for n in ("startLine", "endLine")]
    + [T.StructField("isExported", T.BooleanType())]
    + [T.StructField(n, _TEXT) for n in ("content", "description", "returnType", "declaredType", "heuristicLabel", "processType", "entryPointId", "terminalId")]
    + [T.StructField(n, T.IntegerType()) for n in ("parameterCount", "stepCount", "symbolCount", "level")]
    + [T.StructField("cohesion", T.DoubleType())]
    + [T.StructField(n, T.ArrayType(_TEXT)) for n in ("communities", "keywords", "responseKeys", "errorKeys", "middleware", "parameterTypes")]
)
EDGE_SCHEMA = T.StructType([T.StructField("src", _TEXT), T.StructField("dst", _TEXT), T.StructField("type", _TEXT), T.StructField("confidence", T.DoubleType()), T.StructField("reason", _TEXT), T.StructField("step", T.IntegerType())])

#: Rows of the table that a graph is made of, for each of the graph's tasks.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame) -> int:
    """Tasks for a graph made of these rows (whose number Parquet's footers tell): what a task holds doesn't grow with them."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS))


@dataclass
class Graph:
    """Typed property graph. ``nodes`` follows NODE_SCHEMA (missing columns allowed), ``edges`` EDGE_SCHEMA.

    tasks: how many tasks share the graph's rows in joins and aggregations (None: as Spark's settings have it).
    """

    nodes: DataFrame
    edges: DataFrame
    tasks: int | None = None

    def dealt(self, rows: DataFrame, *keys) -> DataFrame:
        """rows dealt by their keys to the graph's tasks, so that joins and aggregations by these keys take place there."""
        return rows.repartition(self.tasks, *keys) if self.tasks else rows

    def label(self, *labels: str) -> DataFrame:
        """Nodes of some labels; a partition filter where nodes are partitioned by label."""
        return self.nodes.where(F.col("label").isin(*labels))

    def type(self, *types: str) -> DataFrame:
        return self.edges.where(F.col("type").isin(*types))

    def views(self, prefix: str = "") -> None:
        """Temp views: nodes, edges and one per label."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
        for label in NODE_LABELS:
            self.label(label).createOrReplaceTempView(f"{prefix}{label.lower()}_nodes")


def first_writer_wins(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Graph insert semantics: of rows with the same key the one with the smallest seq stays."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(seq))).where("__n = 1").drop("__n")


def label_of(node_id):
    """Label from a node id: comm_* and proc_* are derived nodes, others carry it before the colon."""
    node_id = F.col(node_id) if isinstance(node_id, str) else node_id
    return F.when(node_id.startswith("comm_"), "Community").when(node_id.startswith("proc_"), "Process").otherwise(F.split(node_id, ":")[0])
