"""Search queries: BM25, vectors, fusion, chunks, grep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as text_fn
from ..operators import composite, relational, search
from ..sources.tables import table
from .derived import SESSIONS_SQL, sessions
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query
TERMS = ["the", "with", "que"]

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')"
_IN = ", ".join(f"'{t}'" for t in TERMS)
BM25_SQL = f"""
tok AS (SELECT doc_id, source, {_WORDS} AS w FROM documents),
stat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
tf AS (SELECT doc_id, source, len(w) AS dl, t.term, len(list_filter(w, lambda x: x = t.term))::DOUBLE AS f FROM tok, (SELECT unnest([{_IN}]) AS term) t),
df AS (SELECT term, count(*) FILTER (f > 0) AS df FROM tf GROUP BY term),
bm AS (SELECT doc_id, source, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) FILTER (f > 0) AS matched
       FROM tf JOIN df USING (term), stat GROUP BY doc_id, source HAVING count(*) FILTER (f > 0) > 0)"""
COS_SQL = """
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id, label, 1 - list_cosine_similarity(embedding::DOUBLE[], q) AS distance FROM embeddings, q),
vhit AS (SELECT * FROM vec WHERE distance < 1.0)"""


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else [0.0]


def _text(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), TERMS, **options)


def _text_list(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    hits = _text(spark, sf_dir).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    return search.ranked(hits, [F.desc("score"), "id"], k)


def _vector_list(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    near = search.vector_distances(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), max_distance=1.0)
    return search.ranked(near.select(F.col("vec_id").alias("id"), F.round("distance", 6).alias("distance")), ["distance", "id"], k)


_LISTS = """
tl AS (SELECT doc_id AS id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50),
vl AS (SELECT vec_id AS id, round(distance, 6) AS distance, row_number() OVER (ORDER BY round(distance, 6), vec_id) AS rank FROM vhit QUALIFY rank <= 50)"""


def _rrf_sql(offset: int) -> str:
    return f"""WITH {BM25_SQL}, {COS_SQL}, {_LISTS}
SELECT id, round(sum(1.0 / (60 + rank - 1 + {offset})), 9) AS score, string_agg(src, ',' ORDER BY src) AS sources
FROM (SELECT id, rank, 'bm25' AS src FROM tl UNION ALL SELECT id, rank, 'semantic' FROM vl) GROUP BY id"""


@query("bm25_documents", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_conjunctive", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm WHERE matched = {len(TERMS)}")
def bm25_conjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(spark, sf_dir, conjunctive=True).select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_postings", f"WITH {BM25_SQL} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranking over an inverted index built from the corpus."""
    index = search.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return search.bm25_index(index, TERMS).select("doc_id", F.round("score", 6).alias("score"))


@query("top3_sum_per_source", f"WITH {BM25_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) AS n FROM bm) SELECT source, round(sum(round(score, 6)), 5) AS score FROM r WHERE n <= 3 GROUP BY source")
def top3_sum_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _text(spark, sf_dir, keep=("source",)).withColumn("score", F.round("score", 6))
    return relational.top3_sum(hits, "source", tie="doc_id").select("source", F.round("score", 5).alias("score"))


@query("vector_topk", f"WITH {COS_SQL} SELECT vec_id, label, round(distance, 6) AS distance FROM vhit ORDER BY round(distance, 6), vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.vector_distances(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), max_distance=1.0)
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance")).orderBy("distance", "vec_id").limit(20)


@query("best_chunk_per_node", f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 6), vec_id) AS n FROM vhit) SELECT label, vec_id, round(distance, 6) AS distance FROM r WHERE n = 1")
def best_chunk_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = search.vector_distances(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), max_distance=1.0).withColumn("distance", F.round("distance", 6))
    return search.best_chunk(near, "label").select("label", "vec_id", "distance")


@query("rrf_symbol", _rrf_sql(0))
def rrf_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.rrf({"bm25": _text_list(spark, sf_dir), "semantic": _vector_list(spark, sf_dir)}, "id", 0)
    return out.withColumn("score", F.round("score", 9))


@query("rrf_file", _rrf_sql(1))
def rrf_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.rrf({"bm25": _text_list(spark, sf_dir), "semantic": _vector_list(spark, sf_dir)}, "id", 1)
    return out.withColumn("score", F.round("score", 9))


@query(
    "rrf_group",
    f"WITH {BM25_SQL}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY round(score, 6) DESC, doc_id) AS n FROM bm) SELECT source, doc_id, round(1.0 / (60 + n), 9) AS score FROM r WHERE n <= 5",
)
def rrf_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a repository of a group; its list is ranked by itself."""
    hits = _text(spark, sf_dir, keep=("source",)).withColumn("score", F.round("score", 6))
    best = relational.top_per_key(hits, "source", [F.desc("score"), "doc_id"], 5)
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    lists = best.select(F.col("source").alias("repo"), F.col("doc_id").alias("process"), F.row_number().over(w).alias("rank"), F.lit("").alias("filePath"))
    return composite.group_query(lists, 1_000_000).select(F.col("repo").alias("source"), F.col("process").alias("doc_id"), F.round("score", 9).alias("score"))


@query(
    "hybrid_search",
    f"""WITH {BM25_SQL}, {COS_SQL}, {_LISTS},
f AS (SELECT id, sum(1.0 / (60 + rank)) AS score, string_agg(src, ',' ORDER BY src) AS sources
      FROM (SELECT id, rank, 'bm25' AS src FROM tl UNION ALL SELECT id, rank, 'semantic' FROM vl) GROUP BY id)
SELECT f.id, round(f.score, 9) AS score, sources, tl.score AS bm25_score, round(1 - vl.distance, 6) AS semantic_score, row_number() OVER (ORDER BY f.score DESC, f.id)::INTEGER AS rank
FROM f LEFT JOIN tl ON f.id = tl.id LEFT JOIN vl ON f.id = vl.id QUALIFY row_number() OVER (ORDER BY f.score DESC, f.id) <= 10""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.hybrid(_text_list(spark, sf_dir), _vector_list(spark, sf_dir), "id", 10)
    return out.withColumn("score", F.round("score", 9)).withColumn("semantic_score", F.round("semantic_score", 6))


@query(
    "process_ranking",
    f"""WITH {SESSIONS_SQL}, t AS (
  SELECT session AS process, sum(value) AS total, max(round(value / (value + 100), 4)) AS boost, count(DISTINCT event_id) AS n_symbols FROM sess WHERE event_type = 'purchase' GROUP BY session)
SELECT process, round(total, 4) AS total, boost, n_symbols, round(total + 0.1 * boost, 6) AS priority, row_number() OVER (ORDER BY round(total + 0.1 * boost, 6) DESC, process)::INTEGER AS rank FROM t QUALIFY rank <= 20""",
)
def process_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are the hits, sessions the processes."""
    s = sessions(spark, sf_dir).where("event_type = 'purchase'")
    hits = s.select(F.col("event_id").alias("id"), F.col("value").alias("score"))
    cohesion = s.select(F.col("event_id").alias("id"), F.round(F.col("value") / (F.col("value") + 100), 4).alias("cohesion"))
    out = search.process_ranking(hits, s.select(F.col("event_id").alias("id"), F.col("session").alias("process")), cohesion, 20)
    return out.select("process", F.round("total", 4).alias("total"), "boost", "n_symbols", F.round("priority", 6).alias("priority"), "rank")


@query(
    "chunk_characters",
    """WITH o AS (SELECT doc_id, text, unnest(range(0, greatest(1, length(text)), 1080)) AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (s // 1080)::INTEGER AS chunk_index, s::INTEGER AS start_offset, least(s + 1200, length(text))::INTEGER AS end_offset, md5(text[s + 1:s + 1200]) AS chunk_md5 FROM o WHERE s = 0 OR s + 120 < length(text)""",
)
def chunk_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = text_fn.character_chunks(table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text"), "text")
    return chunks.select("doc_id", "chunk_index", "start_offset", "end_offset", F.md5("chunk").alias("chunk_md5"))


@query(
    "line_grep",
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
SELECT doc_id::VARCHAR AS path, line::INTEGER AS line, left(trim(text, ' '), 200) AS text FROM l WHERE contains(lower(text), 'license') ORDER BY path, line LIMIT 200""",
)
def line_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filePath"), F.col("text").alias("content"))
    return search.grep(docs, "license")


@query(
    "overlay_correction",
    f"""WITH {BM25_SQL}, fresh AS (SELECT doc_id, contains(lower(text), 'the with que') OR (contains(lower(text), 'the') AND contains(lower(text), 'with') AND contains(lower(text), 'que')) AS hit FROM documents WHERE lang = 'en')
SELECT coalesce(bm.doc_id, fresh.doc_id) AS doc_id, round(CASE WHEN hit THEN greatest(coalesce(score, 0), 1) ELSE score END, 6) AS score
FROM bm FULL JOIN fresh ON bm.doc_id = fresh.doc_id WHERE hit IS NULL OR hit""",
)
def overlay_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents play the freshly edited files."""
    files = _text(spark, sf_dir).select(F.col("doc_id").alias("filePath"), "score")
    fresh = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("filePath"), F.col("text").alias("content"))
    return search.overlay_correction(files, fresh, " ".join(TERMS)).select(F.col("filePath").alias("doc_id"), F.round("score", 6).alias("score"))
