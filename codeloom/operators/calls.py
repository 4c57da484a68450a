"""Call resolution by types: a type environment, receiver-bound calls, the tiered pass and the free-call fallback.

facts (file, scope, name, type, origin) say what a name holds: an annotation, a parameter, a construction or an
assignment from another name or call. sites (site, file, scope, receiver, name, arg_count) are calls. All passes are
joins over all sites at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .analytics import lookup_with_mro
from .resolution import CALLABLE, lone_candidates, propagate_types

# Which statement about a name counts first.
ORIGINS = {"annotation": 0, "parameter": 1, "construction": 2, "return": 3}
RECEIVER_CONFIDENCE, FALLBACK_CONFIDENCE = 0.85, 0.5


def type_environment(facts: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """(file, scope, name, type): the type of each name by the strongest statement, carried along assignments.

    assignments (file, scope, name, source): name = source in one scope. What is stated wins over what is carried.
    """
    order = F.create_map(*[F.lit(x) for pair in ORIGINS.items() for x in pair])
    w = Window.partitionBy("file", "scope", "name").orderBy(F.coalesce(order[F.col("origin")], F.lit(len(ORIGINS))), "type")
    known = facts.where("type IS NOT NULL").withColumn("n", F.row_number().over(w)).where("n = 1").select("file", "scope", "name", "type")
    if assignments is None:
        return known
    key = lambda name: F.struct("file", "scope", F.col(name).alias("name"))
    carried = propagate_types(known.select(key("name").alias("name"), "type"), assignments.select(key("name").alias("name"), key("source").alias("source")))
    return carried.select("name.file", "name.scope", "name.name", "type")


def receiver_calls(sites: DataFrame, environment: DataFrame, classes: DataFrame, methods: DataFrame, mro: DataFrame) -> DataFrame:
    """(site, id, confidence): calls on a name whose type is known, to the method of that class or its nearest base.

    The name is looked up in the call's own scope, then in the file's (scope null); classes (name, id), one id for each
    name; methods (owner, name, id); mro (child, pos, ancestor).
    """
    inner = sites.join(environment.where("scope IS NOT NULL").withColumnRenamed("name", "receiver"), ["file", "scope", "receiver"]).select("site", "name", "type")
    rest = sites.join(inner.select("site"), "site", "left_anti")
    outer = rest.join(environment.where("scope IS NULL").select("file", F.col("name").alias("receiver"), "type"), ["file", "receiver"]).select("site", "name", "type")
    unique = classes.groupBy(F.col("name").alias("type")).agg(F.min("id").alias("owner"), F.countDistinct("id").alias("n")).where("n = 1")
    bound = inner.unionByName(outer).join(unique, "type").select("site", "owner", "name")
    return lookup_with_mro(bound, mro, methods).select("site", F.col("method").alias("id"), F.lit(RECEIVER_CONFIDENCE).alias("confidence"))


def tiered_calls(sites: DataFrame, defs: DataFrame, imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(site, id, confidence): callable candidates of the nearest tier that fit the arguments, where only one is left."""
    return lone_candidates(sites, defs, imports, packages)


def free_call_fallback(sites: DataFrame, resolved: DataFrame, defs: DataFrame) -> DataFrame:
    """(site, id, confidence): calls without a receiver that no pass resolved, where one callable has the name."""
    names = defs.where(F.col("kind").isin(CALLABLE)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1")
    left = sites.where("receiver IS NULL").join(resolved.select("site").distinct(), "site", "left_anti")
    return left.join(names.select("name", "id"), "name").select("site", "id", F.lit(FALLBACK_CONFIDENCE).alias("confidence"))
