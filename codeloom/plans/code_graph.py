"""A code graph derived from whole driver tables, and the same graph as SQL.

Parts are functions of files, suppliers classes, nations communities, brands processes. A part calls the part on the
next line of an order; a supplier has the parts it delivers as methods.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Graph, tasks_for
from ..sources.tables import table

NODE_COLUMNS = ["id", "label", "name", "filePath", "startLine", "endLine", "isExported", "content", "heuristicLabel", "cohesion"]


def _nodes(df: DataFrame, label: str, key, **columns) -> DataFrame:
    kinds = {"name": "string", "filePath": "string", "startLine": "long", "endLine": "long", "isExported": "boolean", "content": "string", "heuristicLabel": "string", "cohesion": "double"}
    values = [columns.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
    return df.select(key.alias("id"), F.lit(label).alias("label"), *values)


def _edges(df: DataFrame, src, dst, kind: str, confidence=None, step=None) -> DataFrame:
    c = F.lit(1.0) if confidence is None else confidence
    s = F.lit(None) if step is None else step
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), c.cast("double").alias("confidence"), F.lit("fact").alias("reason"), s.cast("int").alias("step"))


def _named(prefix: str, column: Column) -> Column:
    return F.concat(F.lit(prefix), column.cast("string"))


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as functions: id, name, filePath, startLine, endLine, isExported, content, brand."""
    p, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    line = (F.floor(key / 20) % 50) * 10 + 1
    path = F.concat(F.lit("src/m"), F.col("p_size").cast("string"), F.lit("/f"), (key % 20).cast("string"), F.lit(".ts"))
    return p.select(_named("Function:", key).alias("id"), F.concat(F.lower("p_type"), F.lit("_"), (key % 50).cast("string")).alias("name"), path.alias("filePath"), line.alias("startLine"), (line + 7).alias("endLine"), (F.col("p_size") > 25).alias("isExported"), F.col("p_name").alias("content"), F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"), key.alias("key"))


def calls(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """(src, dst, confidence) of distinct calls: the next line of the same order. Orders and pairs are dealt to tasks."""
    tasks = tasks or tasks_for(table(spark, sf_dir, "lineitem"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = table(spark, sf_dir, "lineitem").repartition(tasks, "l_orderkey").withColumn("next", F.lead("l_partkey").over(w)).where("next <> l_partkey")
    return li.repartition(tasks, "l_partkey", "next").groupBy("l_partkey", "next").agg(F.max(F.round(1 - F.col("l_discount"), 2)).alias("c"))


def code_graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = lambda name: table(spark, sf_dir, name)
    c, f = F.col, functions(spark, sf_dir)
    tasks = tasks_for(t("lineitem"))
    classes = t("supplier").withColumn("path", F.concat(F.lit("src/m"), (c("s_nationkey") + 1).cast("string"), F.lit("/class.ts")))
    paths = f.select("filePath").unionByName(classes.select(c("path").alias("filePath"))).distinct()
    brands = f.select("brand").distinct()
    nodes = [
        _nodes(f, "Function", c("id"), **{k: c(k) for k in ("name", "filePath", "startLine", "endLine", "isExported", "content")}),
        _nodes(classes, "Class", _named("Class:", c("s_suppkey")), name=c("s_name"), filePath=c("path"), startLine=F.lit(1), endLine=F.lit(50), isExported=F.lit(True), content=c("s_name")),
        _nodes(paths, "File", F.concat(F.lit("File:"), "filePath"), name=F.element_at(F.split("filePath", "/"), -1), filePath=c("filePath")),
        _nodes(t("nation"), "Community", _named("comm_", c("n_nationkey")), name=c("n_name"), heuristicLabel=_named("region_", c("n_regionkey")), cohesion=F.round(c("n_nationkey") / 25, 4)),
        _nodes(brands, "Process", _named("proc_", c("brand")), name=c("brand"), heuristicLabel=c("brand")),
    ]
    step = F.row_number().over(Window.partitionBy("brand").orderBy("key"))
    called = calls(spark, sf_dir, tasks)
    s = t("supplier").where("s_suppkey % 10 <> 0")
    edges = [
        _edges(f, F.concat(F.lit("File:"), "filePath"), c("id"), "DEFINES"),
        _edges(classes, F.concat(F.lit("File:"), "path"), _named("Class:", c("s_suppkey")), "DEFINES"),
        _edges(called, _named("Function:", c("l_partkey")), _named("Function:", c("next")), "CALLS", c("c")),
        _edges(t("lineitem").select("l_suppkey", "l_partkey").repartition(tasks, "l_suppkey", "l_partkey").distinct(), _named("Class:", c("l_suppkey")), _named("Function:", c("l_partkey")), "HAS_METHOD"),
        _edges(f, c("id"), _named("comm_", c("key") % 25), "MEMBER_OF"),
        _edges(f, c("id"), _named("proc_", c("brand")), "STEP_IN_PROCESS", step=step),
        _edges(s, _named("Class:", c("s_suppkey")), _named("Class:", c("s_suppkey") - c("s_suppkey") % 10), "EXTENDS", F.lit(0.9)),
    ]
    whole_nodes, whole_edges = nodes[0], edges[0]
    for part in nodes[1:]:
        whole_nodes = whole_nodes.unionByName(part)
    for part in edges[1:]:
        whole_edges = whole_edges.unionByName(part)
    return Graph(whole_nodes, whole_edges, tasks)


CODE_SQL = """
fn AS (SELECT 'Function:' || p_partkey AS id, lower(p_type) || '_' || (p_partkey % 50) AS name, 'src/m' || p_size || '/f' || (p_partkey % 20) || '.ts' AS path,
              (p_partkey // 20 % 50) * 10 + 1 AS line, p_size > 25 AS exported, p_name AS content, replace(p_brand, '#', '_') AS brand, p_partkey AS key FROM part),
cl AS (SELECT 'Class:' || s_suppkey AS id, s_name AS name, 'src/m' || (s_nationkey + 1) || '/class.ts' AS path, s_suppkey AS key FROM supplier),
fi AS (SELECT DISTINCT path FROM (SELECT path FROM fn UNION ALL SELECT path FROM cl)),
n AS (SELECT id, 'Function' AS label, name, path AS "filePath", line AS "startLine", line + 7 AS "endLine", exported AS "isExported", content, NULL::VARCHAR AS "heuristicLabel", NULL::DOUBLE AS cohesion FROM fn
  UNION ALL SELECT id, 'Class', name, path, 1, 50, true, name, NULL, NULL FROM cl
  UNION ALL SELECT 'File:' || path, 'File', string_split(path, '/')[-1], path, NULL, NULL, NULL, NULL, NULL, NULL FROM fi
  UNION ALL SELECT 'comm_' || n_nationkey, 'Community', n_name, NULL, NULL, NULL, NULL, NULL, 'region_' || n_regionkey, round(n_nationkey / 25.0, 4) FROM nation
  UNION ALL SELECT DISTINCT 'proc_' || brand, 'Process', brand, NULL, NULL, NULL, NULL, NULL, brand, NULL FROM fn),
ca AS (SELECT l_partkey, nxt, max(round(1 - l_discount, 2)) AS c FROM (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nxt FROM lineitem) WHERE nxt <> l_partkey GROUP BY ALL),
e AS (SELECT 'File:' || path AS src, id AS dst, 'DEFINES' AS type, 1.0::DOUBLE AS confidence, NULL::INT AS step FROM fn
  UNION ALL SELECT 'File:' || path, id, 'DEFINES', 1.0, NULL FROM cl
  UNION ALL SELECT 'Function:' || l_partkey, 'Function:' || nxt, 'CALLS', c, NULL FROM ca
  UNION ALL SELECT DISTINCT 'Class:' || l_suppkey, 'Function:' || l_partkey, 'HAS_METHOD', 1.0, NULL::INT FROM lineitem
  UNION ALL SELECT id, 'comm_' || (key % 25), 'MEMBER_OF', 1.0, NULL FROM fn
  UNION ALL SELECT id, 'proc_' || brand, 'STEP_IN_PROCESS', 1.0, row_number() OVER (PARTITION BY brand ORDER BY key) FROM fn
  UNION ALL SELECT id, 'Class:' || (key - key % 10), 'EXTENDS', 0.9, NULL FROM cl WHERE key % 10 <> 0)"""
