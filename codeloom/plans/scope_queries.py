"""The seven steps of scope lookup over a tree of scopes made of all parts, with SQL; each step decides some rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scopes as scope_lookup
from ..sources.tables import table
from .registry import Registry

REGISTRY = Registry()

_SQL = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_type AS t FROM part),
s AS (SELECT k FROM p UNION SELECT 0), up AS (SELECT k AS site, k AS scope, 0 AS depth FROM p UNION ALL SELECT site, scope // 3, depth + 1 FROM up WHERE scope > 0),
bound AS (SELECT k AS scope, t AS name, 'b' || k AS id, CASE WHEN k % 3 = 0 THEN 'import' ELSE 'local' END AS origin, k % 2 = 0 AS fn FROM p WHERE k % 5 = 0),
lex AS (SELECT up.site, id, origin, fn, up.depth FROM up JOIN p ON p.k = site AND k % 4 < 2 JOIN bound ON bound.scope = up.scope AND name = t QUALIFY rank() OVER (PARTITION BY site ORDER BY depth) = 1),
r1 AS (SELECT site, id, 1 AS step, round(CASE origin WHEN 'local' THEN 0.55 ELSE 0.45 END - 0.02 * depth, 6) AS confidence FROM lex WHERE fn),
ty AS (SELECT up.site, up.scope % 4 AS j FROM up JOIN p ON p.k = site AND k % 4 = 2 WHERE up.scope % 10 = 0 AND (up.scope > 0 OR EXISTS (SELECT 1 FROM p q WHERE q.k = 0)) QUALIFY row_number() OVER (PARTITION BY site ORDER BY depth) = 1),
m AS (SELECT o, i, (o + i) % 3 AS total FROM (SELECT unnest(range(4)) AS o), (SELECT unnest(range(7)) AS i) WHERE (o + i) % 2 = 0),
cand AS (SELECT site, 'm' || o || '_' || i AS id, j - o AS d, total = site % 3 AS fits FROM ty JOIN m ON o <= j AND i = site % 7),
r2 AS (SELECT site, id, 2 AS step, round([0.5, 0.42, 0.36, 0.32][d + 1] + CASE WHEN d = 0 THEN 0.2 ELSE 0 END + 0.1, 6) AS confidence FROM cand WHERE fits),
r3 AS (SELECT k AS site, 'm' || (k % 3) || '_' || (k % 7) AS id, 3 AS step, 0.75::DOUBLE AS confidence FROM p WHERE k % 8 = 3 AND (k % 3 + k % 7) % 2 = 0),
r6 AS (SELECT k AS site, 'q' || (k % 11) AS id, 6 AS step, 0.35::DOUBLE AS confidence FROM p WHERE k % 8 = 7 AND k % 11 % 2 = 0)
SELECT site, id, step, confidence, row_number() OVER (PARTITION BY site ORDER BY round(confidence, 3) DESC, id)::INTEGER AS rank
FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r6)"""


@REGISTRY.query("scope_lookup_steps", _SQL)
def scope_lookup_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a scope in that of a third of its key, and a site: a name bound around it, a method of a receiver, a member of an owner, or a qualified name."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("t"))
    k = F.col("k")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    scopes = p.select(k.alias("scope"), F.when(k > 0, F.floor(k / 3)).alias("parent")).unionByName(p.limit(1).select(F.lit(0).cast("long").alias("scope"), F.lit(None).cast("long").alias("parent"))).distinct()
    bindings = p.where("k % 5 = 0").select(k.alias("scope"), F.col("t").alias("name"), text("b", k).alias("id"), F.when(k % 3 == 0, "import").otherwise("local").alias("origin"), F.lit(True).alias("linked"))
    receivers = p.where("k % 10 = 0").select(k.alias("scope"), F.lit("self").alias("receiver"), text("T", k % 4).alias("type"))
    null = F.lit(None).cast("int")
    one = lambda o, i: (f"m{o}_{i}", "Method", f"pkg.T{o}.m{i}", f"t{o}", (o + i) % 3, (o + i) % 3)
    fixed = [(f"t{o}", "Class", f"T{o}", None, None, None) for o in range(4)] + [one(o, i) for o in range(4) for i in range(7) if (o + i) % 2 == 0] + [(f"q{i}", "Function", f"Q.f{i}", None, None, None) for i in range(0, 11, 2)]
    defs = p.where("k % 5 = 0").select(text("b", k).alias("id"), F.when(k % 2 == 0, "Function").otherwise("Class").alias("kind"), F.col("t").alias("qualified"), F.lit(None).cast("string").alias("owner"), null.alias("required"), null.alias("total"))
    defs = defs.unionByName(spark.createDataFrame(fixed, "id string, kind string, qualified string, owner string, required int, total int"))
    mro = spark.createDataFrame([(f"t{a}", a - b - 1, f"t{b}") for a in range(4) for b in range(a)], "child string, pos int, ancestor string")
    sites = p.select(
        k.alias("site"), k.alias("scope"),
        F.when(k % 4 < 2, F.col("t")).when((k % 4 == 2) | (k % 8 == 3), text("m", k % 7)).otherwise(text("Q.f", k % 11)).alias("name"),
        F.array(F.lit("Function"), F.lit("Method")).alias("kinds"), F.lit(None).cast("string").alias("receiver"), (k % 4 == 2).alias("by_receiver"),
        F.when(k % 8 == 3, text("t", k % 3)).alias("owner"), F.when(k % 4 == 2, (k % 3).cast("int")).alias("arg_count"),
    )
    return scope_lookup.lookup(sites, scopes, bindings, defs, receivers, mro)
