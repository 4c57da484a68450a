"""Stored text and vector indexes of a graph, by label and name: what CALL statements of queries search in.

A text index holds the postings of some properties of a label's nodes and the corpus totals, stored once and sorted by
term, so a search reads the row groups of its terms only. A vector index is an inverted file (vector_index).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.porter import porter
from ..model import Graph
from ..session import stored
from . import search, vector_index


class IndexMissing(ValueError):
    """A search in an index that doesn't exist, or a second index of one name."""


@dataclass
class TextIndex:
    postings: DataFrame
    totals: DataFrame
    stemmed: bool

    def scores(self, query: str, conjunctive: bool = False) -> DataFrame:
        """(id, score) of the nodes with any (conjunctive: every) word of the query."""
        spark = self.postings.sparkSession
        row = spark.range(1).select(search.tokens(F.lit(query)).alias("w"))
        words = (row.select(F.explode("w").alias("w")).select(porter("w").alias("w")) if self.stemmed else row.select(F.explode("w").alias("w"))).collect()  # the words of one query
        terms = sorted({r["w"] for r in words})
        if not terms:
            return self.postings.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score")).limit(0)
        return search.bm25_index(self.postings, terms, conjunctive=conjunctive, totals=self.totals).select(F.col("doc_id").alias("id"), "score")


@dataclass
class GraphIndexes:
    """The indexes of a graph. ``tables`` are rows that are no nodes, such as embeddings, by the name queries use."""

    graph: Graph
    tables: dict[str, DataFrame] = field(default_factory=dict)
    texts: dict[tuple[str, str], TextIndex] = field(default_factory=dict)
    vectors: dict[tuple[str, str], vector_index.VectorIndex] = field(default_factory=dict)

    def rows(self, label: str) -> DataFrame:
        return self.tables[label] if label in self.tables else self.graph.label(label)

    def create_text(self, label: str, name: str, properties: list[str], stem: bool = False) -> TextIndex:
        if (label, name) in self.texts:
            raise IndexMissing(f"the index {name} of {label} exists")
        text = F.concat_ws(" ", *[F.col(p).cast("string") for p in properties])
        made = search.postings(self.rows(label).select("id", text.alias("text")), "id", "text", porter if stem else None)
        kept = stored(made.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"), "text-index")
        self.texts[label, name] = TextIndex(kept, stored(search.posting_totals(kept), "text-totals"), stem)
        return self.texts[label, name]

    def create_vectors(self, label: str, name: str, column: str, key: str | None = None) -> vector_index.VectorIndex:
        if (label, name) in self.vectors:
            raise IndexMissing(f"the index {name} of {label} exists")
        rows = self.rows(label)
        key = key or next(c for c in ("id", "nodeId") if c in rows.columns)
        self.vectors[label, name] = vector_index.build(rows, key, column)
        return self.vectors[label, name]

    def drop_text(self, label: str, name: str) -> None:
        if self.texts.pop((label, name), None) is None:
            raise IndexMissing(f"no text index {name} of {label}")

    def search_text(self, label: str, name: str, query: str, conjunctive: bool = False) -> DataFrame:
        """The label's nodes with a score."""
        if (label, name) not in self.texts:
            raise IndexMissing(f"no text index {name} of {label}; create it first")
        return self.rows(label).join(self.texts[label, name].scores(query, conjunctive), "id")

    def search_vectors(self, label: str, name: str, vector: list[float], k: int) -> DataFrame:
        """The k nearest rows with their distance."""
        if (label, name) not in self.vectors:
            raise IndexMissing(f"no vector index {name} of {label}; create it first")
        return self.vectors[label, name].search(vector, k).drop("cell")
