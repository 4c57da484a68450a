"""Preparation of embeddings: nodes, chunks by declarations, texts, incremental recomputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHUNK, OVERLAP, character_chunks, content_hash, embedding_text
from ..model import Graph

# Labels that get embeddings.
EMBEDDABLE = "Function Class Method Interface Struct Enum Trait Impl Macro Namespace TypeAlias Typedef Const Property Record Union Static Variable Constructor".split()


def embeddable(graph: Graph) -> DataFrame:
    return graph.nodes.where(F.col("label").isin(EMBEDDABLE) & F.col("content").isNotNull())


def declaration_chunks(nodes: DataFrame, text: str = "content", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, chunk): blocks between blank lines packed greedily up to ``size``; larger blocks are cut by characters.

    One fold over the blocks of a node; nothing is shuffled.
    """
    blocks = F.filter(F.split(F.col(text), r"\n\s*\n"), lambda b: F.trim(b) != "")
    step = lambda a, b: F.when(
        (F.length(a["open"]) > 0) & (F.length(a["open"]) + F.length(b) + 2 > size),
        F.struct(F.concat(a["done"], F.array(a["open"])).alias("done"), b.alias("open")),
    ).otherwise(F.struct(a["done"].alias("done"), F.when(F.length(a["open"]) > 0, F.concat(a["open"], F.lit("\n\n"), b)).otherwise(b).alias("open")))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    folded = F.aggregate(blocks, start, step, lambda a: F.filter(F.concat(a["done"], F.array(a["open"])), lambda x: x != ""))
    units = nodes.select("id", F.posexplode(folded).alias("unit", "body"))
    cut = character_chunks(units, "body", size, overlap)
    return cut.select("id", F.struct("unit", "chunk_index").alias("k"), "chunk").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "chunk"))), lambda x: x["chunk"]).alias("chunks")).select("id", F.posexplode("chunks").alias("chunk_index", "chunk"))


def structural_names(graph: Graph) -> DataFrame:
    """(id, members): names of the methods and properties of class-like nodes."""
    e = graph.type("HAS_METHOD", "HAS_PROPERTY").join(graph.nodes.select(F.col("id").alias("dst"), "name"), "dst")
    return e.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("name")).alias("members"))


def declarations_only(text):
    """Bodies in braces behind a parameter list removed, innermost first, however deep they are nested."""
    text = F.col(text) if isinstance(text, str) else text
    done = "\u0001"  # stands for a removed body while those around it are looked at
    opened = F.length(text) - F.length(F.replace(text, F.lit("{"), F.lit("")))
    shell = rf"(\)\s*(?::\s*[\w<>\[\]., |]+)?)\s*\{{[^{{}}]*\}}"
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), opened)), text, lambda a, _: F.regexp_replace(a, shell, f") {done}"))
    return F.replace(folded, F.lit(done), F.lit("{ … }"))


def embedding_inputs(graph: Graph) -> DataFrame:
    """(id, text, hash) of every embeddable node."""
    n = embeddable(graph).join(structural_names(graph), "id", "left")
    body = F.when(F.col("label").isin("Class", "Interface", "Struct", "Trait"), declarations_only("content")).otherwise(F.col("content"))
    text = embedding_text(F.col("label"), F.col("name"), F.col("filePath"), body, None, F.col("members"), F.col("description") if "description" in graph.nodes.columns else None)
    return n.select("id", text.alias("text"), content_hash("content").alias("hash"))


def incremental_embeddings(inputs: DataFrame, stored: DataFrame, embed) -> DataFrame:
    """Stored rows (id, hash, embedding) of unchanged nodes, and new ones for the others; gone nodes disappear."""
    same = stored.join(inputs.select("id", "hash"), ["id", "hash"], "left_semi").select("id", "hash", "embedding")
    fresh = inputs.join(stored.select("id", "hash"), ["id", "hash"], "left_anti").select("id", "hash", embed("text").alias("embedding"))
    return same.unionByName(fresh)
