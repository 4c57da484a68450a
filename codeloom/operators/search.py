"""Full-text, vector and hybrid search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

# BM25 parameters and the offset of reciprocal rank fusion.
K1, B = 1.2, 0.75
RRF_K = 60


def tokens(text: Column | str) -> Column:
    """Lower-case word tokens."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z0-9_]+)"), 1)


def postings(docs: DataFrame, doc_id: str, text: str, stem=None) -> DataFrame:
    """Inverted index (doc_id, term, tf, dl). stem: optional UDF over terms (see functions.porter)."""
    words = docs.select(F.col(doc_id).alias("doc_id"), tokens(text).alias("words")).select("doc_id", F.size("words").alias("dl"), F.explode("words").alias("term"))
    if stem is not None:
        words = words.withColumn("term", stem("term"))
    return words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def _is(term: str):
    return lambda x: x == F.lit(term)


def bm25(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", conjunctive: bool = False, k1: float = K1, b: float = B, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, columns to keep) of the documents with any (conjunctive: every) query term.

    The query terms are matched while a document is tokenised, and the counts, a few numbers for each document, are
    stored: the texts are read and tokenised once, the statistics and the scores come from the counts.
    """
    terms = sorted(set(query))
    words = docs.select(F.col(doc_id).alias("doc_id"), *keep, tokens(text).alias("w"))
    counts = [F.size(F.filter("w", _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    tf = stored(words.select("doc_id", *keep, F.size("w").alias("dl"), *counts), "term-counts")
    stats = tf.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avgdl = stats["n"] or 0, stats["avgdl"] or 1.0
    score, every, some = F.lit(0.0), F.lit(True), F.lit(False)
    for i in range(len(terms)):
        df, f = stats[f"df{i}"] or 0, F.col(f"tf{i}").cast("double")
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.lit(idf) * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.lit(float(avgdl))))
        every, some = every & (F.col(f"tf{i}") > 0), some | (F.col(f"tf{i}") > 0)
    return tf.where(every if conjunctive else some).select("doc_id", score.alias("score"), *keep)


def posting_totals(index: DataFrame) -> DataFrame:
    """(n, avgdl): one row, the number of documents with a word and their mean length."""
    docs = index.groupBy("doc_id").agg(F.first("dl").alias("dl"))
    return docs.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25_index(index: DataFrame, query: list[str], k1: float = K1, b: float = B, conjunctive: bool = False, totals: DataFrame | None = None) -> DataFrame:
    """The same over stored postings (doc_id, term, tf, dl); totals: those of posting_totals, if they are kept."""
    totals = posting_totals(index) if totals is None else totals
    hits = index.where(F.col("term").isin(*query))
    df = hits.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    f, dl = F.col("tf").cast("double"), F.col("dl")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(totals))  # at most a row per query term, and one row
    out = scored.groupBy("doc_id").agg(F.sum(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / F.col("avgdl")))).alias("score"), F.countDistinct("term").alias("n_terms"))
    return out.where(F.col("n_terms") == len(set(query))).select("doc_id", "score") if conjunctive else out.select("doc_id", "score")


def ranked(df: DataFrame, order: list, limit: int) -> DataFrame:
    """The first rows with a 1-based rank; the sort is a top-k, only the k rows meet in one task."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine over the common length; 1 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm == 0, 1.0).otherwise(1 - _dot(a, b) / norm)


def vector_distances(vectors: DataFrame, query: list[float], vec: str = "embedding", max_distance: float = 0.6) -> DataFrame:
    """vectors plus distance, below the cut-off. The query is a literal: no join, no shuffle."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("distance", cosine_distance(F.col(vec), q)).where(F.col("distance") < max_distance)


def vector_topk(vectors: DataFrame, query: list[float], k: int, key: str, vec: str = "embedding", max_distance: float = 0.6) -> DataFrame:
    return vector_distances(vectors, query, vec, max_distance).orderBy("distance", key).limit(k)


def best_chunk(rows: DataFrame, node: str, limit: int | None = None) -> DataFrame:
    """The nearest chunk of each node (all chunks are seen; there is no over-fetching)."""
    best = rows.withColumn("__n", F.row_number().over(Window.partitionBy(node).orderBy("distance", *[c for c in ("chunkIndex", "vec_id") if c in rows.columns]))).where("__n = 1").drop("__n")
    return best.orderBy("distance", node).limit(limit) if limit else best


def rrf(lists: dict[str, DataFrame], key: str, offset: int, limit: int | None = None) -> DataFrame:
    """(key, score, sources): sum of 1 / (60 + rank - 1 + offset) over ranked lists (key, rank from 1).

    offset 0 at symbol level, 1 for files and groups.
    """
    parts = None
    for name, df in lists.items():
        part = df.select(F.col(key), (F.lit(1.0) / (F.lit(RRF_K - 1 + offset) + F.col("rank"))).alias("s"), F.lit(name).alias("src"))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy(key).agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"))
    return ranked(out, [F.desc("score"), key], limit) if limit else out


def hybrid(text_hits: DataFrame, vector_hits: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """File-level hybrid search: text list (key, score, rank), vector list (key, distance, rank).

    Both scores travel with the ranks through one union and one aggregation, so neither list is made twice.
    """
    none, fused = F.lit(None).cast("double"), 1.0 / (F.lit(RRF_K) + F.col("rank"))
    left = text_hits.select(key, fused.alias("s"), F.lit("bm25").alias("src"), F.col("score").cast("double").alias("bm25_score"), none.alias("semantic_score"))
    right = vector_hits.select(key, fused.alias("s"), F.lit("semantic").alias("src"), none.alias("bm25_score"), (1 - F.col("distance")).alias("semantic_score"))
    out = left.unionByName(right).groupBy(key).agg(F.sum("s").alias("score"), F.array_join(F.sort_array(F.collect_set("src")), ",").alias("sources"), F.max("bm25_score").alias("bm25_score"), F.max("semantic_score").alias("semantic_score"))
    return ranked(out, [F.desc("score"), key], limit)


def process_ranking(hits: DataFrame, steps: DataFrame, cohesion: DataFrame, limit: int = 5) -> DataFrame:
    """Processes by summed score of their hits plus a tenth of the best cohesion.

    hits (id, score), steps (id, process), cohesion (id, cohesion).
    """
    own = cohesion.groupBy("id").agg(F.max("cohesion").alias("cohesion"))
    joined = hits.join(steps, "id").join(own, "id", "left")
    summed = joined.groupBy("process").agg(F.sum("score").alias("total"), F.coalesce(F.max("cohesion"), F.lit(0.0)).alias("boost"), F.countDistinct("id").alias("n_symbols"))
    return ranked(summed.withColumn("priority", F.col("total") + 0.1 * F.col("boost")), [F.desc("priority"), "process"], limit)


def overlay_correction(files: DataFrame, overlays: DataFrame, query: str) -> DataFrame:
    """Files (filePath, score) corrected by fresh contents (filePath, content): matching ones score at least 1, others go."""
    from ..functions.predicates import overlay_matches

    fresh = overlays.select("filePath", overlay_matches("content", query).alias("hit"))
    return files.join(fresh, "filePath", "full").where("hit IS NULL OR hit").select("filePath", F.when(F.col("hit"), F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(1.0))).otherwise(F.col("score")).alias("score"))


def grep(files: DataFrame, pattern: str, path: str = "filePath", content: str = "content", limit: int = 200) -> DataFrame:
    """Case-insensitive literal search by line: (path, line from 1, text cut to 200)."""
    lines = files.select(F.col(path).alias("path"), F.posexplode(F.split(content, "\n")).alias("n", "text"))
    hit = lines.where(F.lower("text").contains(pattern[:200].lower()))
    return hit.select("path", (F.col("n") + 1).alias("line"), F.substring(F.trim("text"), 1, 200).alias("text")).orderBy("path", "line").limit(limit)


def hashing_embedder(dims: int = 64):
    """Deterministic offline text embedder: signed hashing of word tokens, unit length. All JVM-side."""

    def embed(text: Column | str) -> Column:
        words = tokens(text)
        cells = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dims)).alias("d"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(cells, lambda c: c["d"] == i), F.lit(0.0), lambda a, c: a + c["s"]))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
        return F.when(norm == 0, raw).otherwise(F.transform(raw, lambda x: x / norm)).cast("array<float>")

    return embed


def open_index(spark: SparkSession, table: str) -> DataFrame | None:
    """A stored postings table; None if it doesn't exist (an empty result is something else)."""
    return spark.table(table) if spark.catalog.tableExists(table) else None


def create_index(docs: DataFrame, table: str, doc_id: str = "doc_id", text: str = "text", stem=None) -> DataFrame:
    """Build postings and store them as a table, sorted by term so that a search reads few row groups."""
    if docs.sparkSession.catalog.tableExists(table):
        raise ValueError(f"index {table} exists; drop it first")
    postings(docs, doc_id, text, stem).sortWithinPartitions("term", "doc_id").write.saveAsTable(table)
    return docs.sparkSession.table(table)


def drop_index(spark: SparkSession, table: str) -> bool:
    """True if there was one."""
    there = spark.catalog.tableExists(table)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    return there
