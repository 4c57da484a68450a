"""Writing and reading of graphs, contracts and caches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sanitize
from ..model import Graph
from ..operators.structure import split_by_labels


def write_graph(graph: Graph, path: str) -> None:
    """Nodes by label and edges by type, so that a query reads only the partitions it names."""
    text = [f.name for f in graph.nodes.schema if isinstance(f.dataType, T.StringType) and f.name in ("content", "description")]
    nodes = graph.nodes
    for c in text:
        nodes = nodes.withColumn(c, sanitize(c))
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def bulk_load(graph: Graph, labels: list[str], path: str) -> dict[str, int]:
    """write_graph of the edges between known labels; counts of inserted and skipped edges."""
    fit, dropped = split_by_labels(graph.edges, labels)
    write_graph(Graph(graph.nodes.where(F.col("label").isin(labels)), fit.drop("from_label", "to_label")), path)
    return {"inserted": graph.edges.sparkSession.read.schema(graph.edges.schema).parquet(f"{path}/edges").count(), "skipped": dropped.count()}


def ndjson(graph: Graph, with_content: bool = False) -> DataFrame:
    """One column ``value``: {"type": "node" | "relationship", "data": {..}} for every record, for a text sink or toLocalIterator."""
    nodes = graph.nodes if with_content or "content" not in graph.nodes.columns else graph.nodes.drop("content")
    line = lambda kind, df: df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*df.columns).alias("data"))).alias("value"))
    return line("node", nodes).unionByName(line("relationship", graph.edges))


CONTRACT_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("repo", "service", "contractId", "type", "role", "symbolUid", "symbolName")]
    + [T.StructField("symbolRef", T.StructType([T.StructField("filePath", T.StringType()), T.StructField("name", T.StringType())])), T.StructField("confidence", T.DoubleType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt", T.StringType())]
)


def write_registry(contracts: DataFrame, path: str) -> None:
    contracts.write.mode("overwrite").json(path)


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(contracts, corrupt lines): rows that don't parse or lack an id are set apart, not dropped silently."""
    raw = spark.read.text(path).select(F.from_json("value", CONTRACT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("c"), "value")
    bad = F.col("c._corrupt").isNotNull() | F.col("c.contractId").isNull() | F.col("c.repo").isNull()
    return raw.where(~bad).select("c.*").drop("_corrupt"), raw.where(bad).select("value")


def write_bridge(contracts: DataFrame, snapshots: DataFrame, links: DataFrame, path: str) -> dict[str, int]:
    """Three tables in a fresh versioned folder; links without both ends are dropped and counted."""
    ends = contracts.select(F.col("symbol_uid").alias("u")).distinct()
    whole = links.join(ends.withColumnRenamed("u", "from_symbol_uid"), "from_symbol_uid", "left_semi").join(ends.withColumnRenamed("u", "to_symbol_uid"), "to_symbol_uid", "left_semi")
    contracts.write.mode("overwrite").parquet(f"{path}/contracts")
    snapshots.write.mode("overwrite").parquet(f"{path}/snapshots")
    whole.write.mode("overwrite").parquet(f"{path}/links")
    kept, total = whole.count(), links.count()
    return {"links": kept, "dropped": total - kept}


def parse_group_config(text: str) -> dict:
    """The subset of YAML that group files use: nested maps, lists of scalars or maps, scalars; defaults filled in."""

    def scalar(value: str):
        value = value.strip()
        if value[:1] in "'\"" and value[-1:] == value[:1]:
            return value[1:-1]
        if value in ("true", "false"):
            return value == "true"
        if value in ("", "null", "~"):
            return None
        for kind in (int, float):
            try:
                return kind(value)
            except ValueError:
                pass
        if value.startswith("[") and value.endswith("]"):
            return [scalar(v) for v in value[1:-1].split(",") if v.strip()]
        return value

    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(i: int, indent: int):
        if i < len(lines) and lines[i][1].startswith("- "):
            out: list = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("- "):
                body = lines[i][1][2:]
                if re.match(r"^[\w./@-]+:(\s|$)", body):
                    lines[i] = (indent + 2, body)
                    value, i = block(i, indent + 2)
                else:
                    value, i = scalar(body), i + 1
                out.append(value)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            i += 1
            if rest.strip():
                out[key.strip("'\"")] = scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or lines[i][1].startswith("- ") and lines[i][0] >= indent):
                out[key.strip("'\"")], i = block(i, lines[i][0])
            else:
                out[key.strip("'\"")] = None
        return out, i

    config = block(0, lines[0][0])[0] if lines else {}
    # Defaults of detection and matching.
    config["detect"] = {"http": True, "grpc": True, "thrift": True, "topics": True, "shared_libs": True, "embedding_fallback": True, "includes": False, "workspace_deps": False} | (config.get("detect") or {})
    config["matching"] = {"bm25_threshold": 0.7, "embedding_threshold": 0.65, "max_candidates": 3} | (config.get("matching") or {})
    return config


def reusable(current: DataFrame, cache: DataFrame, key: str = "path", value: str = "hash") -> tuple[DataFrame, DataFrame]:
    """(cached rows that are still valid, current rows to be computed) by (path, hash)."""
    return cache.join(current.select(key, value).distinct(), [key, value], "left_semi"), current.join(cache.select(key, value).distinct(), [key, value], "left_anti")
