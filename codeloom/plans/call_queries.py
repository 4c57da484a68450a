"""Call resolution by types, the vector index, and the state of builds, as queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, vector_index
from ..sources import state
from ..sources.tables import table
from .code_graph import CODE_SQL, code_graph
from .fact_queries import _folder, _methods
from .registry import Registry

REGISTRY = Registry()


def query(name: str, sql: str):
    return REGISTRY.query(name, f"WITH {CODE_SQL} {sql}")


_FACTS_SQL = """, ow AS (SELECT dst AS id, min(substr(src, 7)::BIGINT) AS k FROM e WHERE type = 'HAS_METHOD' GROUP BY dst),
fa AS (SELECT f.id AS scope, f.path AS file, f.key, c.name AS made, 'T' || (f.key % 7) AS noted FROM fn f JOIN ow ON ow.id = f.id JOIN cl c ON c.key = ow.k),
me AS (SELECT e.src AS owner, e.dst AS id, n.name FROM e JOIN n ON n.id = e.dst WHERE e.type = 'HAS_METHOD'), mr AS (SELECT src AS child, dst AS ancestor FROM e WHERE type = 'EXTENDS'),
si AS (SELECT e.src || '>' || e.dst AS site, e.src AS scope, f.path AS file, n.name, substr(e.src, 10)::BIGINT AS key FROM e JOIN fn f ON f.id = e.src JOIN n ON n.id = e.dst WHERE e.type = 'CALLS')"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, assignments, sites): each function holds an object of its first owner; every third also notes a type."""
    g = code_graph(spark, sf_dir)
    owner = g.type("HAS_METHOD").groupBy(F.col("dst").alias("id")).agg(F.min(F.substr("src", F.lit(7)).cast("long")).alias("k"))
    names = g.label("Class").select(F.substr("id", F.lit(7)).cast("long").alias("k"), F.col("name").alias("type"))
    own = g.label("Function").select("id", "filePath").join(owner, "id").join(names, "k")
    key = F.substr("scope", F.lit(10)).cast("long")
    made = own.select(F.col("filePath").alias("file"), F.col("id").alias("scope"), F.lit("recv").alias("name"), "type", F.lit("construction").alias("origin"))
    noted = made.where(key % 3 == 0).withColumn("type", F.concat(F.lit("T"), (key % 7).cast("string"))).withColumn("origin", F.lit("annotation"))
    assigned = made.select("file", "scope", F.lit("alias").alias("name"), F.lit("recv").alias("source"))
    at = g.label("Function").select(F.col("id").alias("src"), F.col("filePath").alias("file"))
    sites = g.type("CALLS").join(at, "src").join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst")
    sites = sites.select(F.concat("src", F.lit(">"), "dst").alias("site"), "file", F.col("src").alias("scope"), F.lit("alias").alias("receiver"), "name", F.lit(None).cast("int").alias("arg_count"))
    return made.unionByName(noted), assigned, sites


@query("type_environment", f"{_FACTS_SQL} SELECT file, scope, unnest(['recv', 'alias']) AS name, CASE WHEN key % 3 = 0 THEN noted ELSE made END AS type FROM fa")
def type_environment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each local name holds: annotations before constructions, carried along assignments."""
    facts, assigned, _ = _facts(spark, sf_dir)
    return calls.type_environment(facts, assigned)


@query(
    "receiver_calls",
    f"{_FACTS_SQL}, b AS (SELECT si.site, si.name, cl.id AS owner FROM si JOIN fa ON fa.scope = si.scope JOIN cl ON cl.name = fa.made WHERE fa.key % 3 <> 0), d AS (SELECT site, me.id, -1 AS pos FROM b JOIN me USING (owner, name) UNION ALL SELECT site, me.id, 0 FROM b JOIN mr ON mr.child = b.owner JOIN me ON me.owner = mr.ancestor AND me.name = b.name) SELECT site, id FROM d QUALIFY row_number() OVER (PARTITION BY site ORDER BY pos, id) = 1",
)
def receiver_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls through a name whose class is known, to its own or its base's method."""
    facts, assigned, sites = _facts(spark, sf_dir)
    g = code_graph(spark, sf_dir)
    methods, mro = _methods(g)
    classes = g.label("Class").select("name", "id")
    return calls.receiver_calls(sites, calls.type_environment(facts, assigned), classes, methods, mro).select("site", "id")


_DEFS_SQL = ", s AS (SELECT DISTINCT file || '#' || name AS site, file, name FROM si), t AS (SELECT s.site, fn.id, 1 AS r FROM s JOIN fn ON fn.name = s.name AND fn.path = s.file UNION ALL SELECT s.site, fn.id, 2 FROM s JOIN fn ON fn.name = s.name), u AS (SELECT site, id, r FROM t QUALIFY rank() OVER (PARTITION BY site ORDER BY r) = 1), z AS (SELECT site, min(id) AS id, max(CASE r WHEN 1 THEN 0.95 ELSE 0.5 END)::DOUBLE AS confidence FROM u GROUP BY site HAVING count(*) = 1)"


def _free(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sites, defs, imports): every name a file calls, all functions, and no imports."""
    _, _, sites = _facts(spark, sf_dir)
    free = sites.select(F.concat_ws("#", "file", "name").alias("site"), "file", "name").distinct().withColumn("arg_count", F.lit(None).cast("int")).withColumn("receiver", F.lit(None).cast("string"))
    defs = code_graph(spark, sf_dir).label("Function").select("id", F.col("filePath").alias("file"), "name", F.lit("Function").alias("kind"), F.lit(None).cast("int").alias("required"), F.lit(None).cast("int").alias("total"))
    return free, defs, spark.createDataFrame([], "file string, source string, local string, exported string")


@query("tiered_calls", f"{_FACTS_SQL}{_DEFS_SQL} SELECT * FROM z")
def tiered_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the nearest tier resolves to one function."""
    return calls.tiered_calls(*_free(spark, sf_dir))


@query("free_call_fallback", f"{_FACTS_SQL}{_DEFS_SQL}, o AS (SELECT name, min(id) AS id FROM fn GROUP BY name HAVING count(*) = 1) SELECT s.site, o.id, 0.5::DOUBLE AS confidence FROM s JOIN o USING (name) WHERE s.file LIKE '%/f1%'")
def free_call_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls that the passes left open, where one function has the name; here those of some files."""
    sites, defs, _ = _free(spark, sf_dir)
    return calls.free_call_fallback(sites, sites.where("file NOT LIKE '%/f1%'"), defs)


_NEAREST_SQL = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT query, vec_id AS key, 1 - list_cosine_similarity(embedding::DOUBLE[], v) AS distance FROM embeddings, q)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    """The index over all embeddings, and as queries those whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_index.build(vectors, "vec_id"), vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


@REGISTRY.query("vector_index_search", f"{_NEAREST_SQL} SELECT query, key, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(distance, 6), key) <= 10")
def vector_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows of each query, in one job through all cells of the index."""
    index, queries = _index(spark, sf_dir)
    return index.search_all(queries, 10, None, digits=6).select("query", "key", F.round("distance", 6).alias("distance"))


@REGISTRY.query("vector_index_recall", "SELECT count(*)::BIGINT AS indexed, count(*) FILTER (vec_id % 50 = 0)::BIGINT AS queries, true AS whole_recall_exact, true AS recall_reached FROM embeddings")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is indexed; all cells give the exact answer, and as many as were measured to be enough when it was built at least nine tenths of it."""
    index, queries = _index(spark, sf_dir)
    whole, some = vector_index.recalls(index, queries, [len(index.centroids), index.probes])
    counts = index.rows.agg(F.count(F.lit(1)).alias("indexed"), F.count_if(F.col("vec_id") % 50 == 0).alias("queries"))
    return counts.withColumn("whole_recall_exact", F.lit(whole == 1.0)).withColumn("recall_reached", F.lit(some >= 0.9))


@REGISTRY.query("vector_index_recall_by_probes")
def vector_index_recall_by_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the exact ten nearest the index finds over all queries, by how many of its cells are read."""
    index, queries = _index(spark, sf_dir)
    tried = [p for p in vector_index.steps(index) if p]
    cells, measured = len(index.centroids), vector_index.recalls(index, queries, tried)
    return spark.createDataFrame([(p, cells, r) for p, r in zip(tried, measured, strict=True)], "probes int, cells int, recall double")


@REGISTRY.query("crash_marker", "SELECT doc_id, unnest(['first', 'second', 'third']) AS build, unnest([false, true, false]) AS dirty, unnest([NULL, 'second', 'second']) AS made_in FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id")
def crash_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three builds over all documents: the first breaks behind its first half, so the second finds the marker and makes all anew, and the third finds none and reuses all."""
    path = _folder(spark, "build")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    rows = []

    def build(name: str, breaks: bool) -> None:
        dirty = state.is_dirty(spark, path)
        state.mark_dirty(spark, path)
        done = state.has_folder(spark, f"{path}/made") and not dirty
        if not done:
            docs.where("doc_id % 2 = 0").withColumn("made_in", F.lit(name)).write.mode("overwrite").parquet(f"{path}/made")
            if breaks:
                rows.append(docs.select("doc_id", F.lit(name).alias("build"), F.lit(dirty).alias("dirty"), F.lit(None).cast("string").alias("made_in")))
                return  # as a build that is killed: the marker stays, and half of the rows are there
            docs.where("doc_id % 2 <> 0").withColumn("made_in", F.lit(name)).write.mode("append").parquet(f"{path}/made")
        state.clear_dirty(spark, path)
        made = spark.read.parquet(f"{path}/made")
        rows.append(docs.join(made, "doc_id", "left").select("doc_id", F.lit(name).alias("build"), F.lit(dirty).alias("dirty"), "made_in"))

    for name in ("first", "second", "third"):
        build(name, name == "first")
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@REGISTRY.query("finalize_cache", "SELECT doc_id AS key, md5(text || CASE WHEN doc_id % 3 = 0 THEN '!' ELSE '' END) AS hash, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS made_in FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL")
def finalize_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds of which the second finds a third of the inputs changed: only these are made again."""
    d, path = table(spark, sf_dir, "documents").where("text IS NOT NULL AND doc_id IS NOT NULL"), _folder(spark, "finalized")
    first = d.select(F.col("doc_id").alias("key"), F.md5("text").alias("hash")).distinct()
    second = d.select(F.col("doc_id").alias("key"), F.md5(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash")).distinct()
    state.finalized(first, path, lambda rows: rows.withColumn("made_in", F.lit("first")))
    return state.finalized(second, path, lambda rows: rows.withColumn("made_in", F.lit("second")))
