"""Names looked up through nested scopes in seven steps, for all sites at once.

1. the nearest enclosing scope that binds the name: its bindings, and it hides all outer ones whatever their kind;
2. the receiver's type and its ancestors in method resolution order; 3. members of a given owner; 4. only kinds that the
site accepts; 5. arity: what can't take the arguments goes if anything fits or may fit, all go if nothing can;
6. if nothing is left and no scope bound the name, definitions of that qualified name; 7. evidence ranks what is left.

The enclosing scopes of all scopes are one table, made by doubling its reach (rounds grow with the logarithm of the
nesting), so a lookup is a join and the smallest depth, not a walk.

sites (site, scope, name, kinds, receiver, by_receiver, owner, arg_count), scopes (scope, parent), bindings (scope, name,
id, origin, linked), defs (id, kind, qualified, owner, required, total), receivers (scope, receiver, type), mro (child,
pos from 0, ancestor). A null arg_count is no call, a null receiver stands for self or this.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .resolution import ORIGIN_PRIORITY, evidence

IMPLICIT = ["self", "this"]


def enclosing(scopes: DataFrame, max_doublings: int = 40) -> DataFrame:
    """(scope, outer, depth): each scope's enclosing scopes, itself at depth 0. A circle of scopes is an error."""
    known = scopes.select("scope", "parent").distinct()
    step = cut(known.where("parent IS NOT NULL").select("scope", F.col("parent").alias("outer"), F.lit(1).alias("depth")))
    reach = step
    for k in range(max_doublings):
        far = step.select(F.col("scope").alias("outer"), F.col("outer").alias("next"), F.col("depth").alias("more"))
        longer = reach.join(far, "outer").select("scope", F.col("next").alias("outer"), (F.col("depth") + F.col("more")).alias("depth"))
        top = cut(longer.where(F.col("depth") > 2**k)).distinct()  # reach has depths to 2**k, step exactly 2**k
        if not top.where("scope = outer").isEmpty():
            raise ValueError("scopes are nested in a circle")
        if top.isEmpty():
            return reach.unionByName(known.select("scope", F.col("scope").alias("outer"), F.lit(0).alias("depth")))
        reach = cut(reach.unionByName(top))
        step = reach.where(F.col("depth") == 2 ** (k + 1))
    raise ValueError("scopes are nested in a circle")


def _nearest(asked: DataFrame, outer: DataFrame, bound: DataFrame, on: str) -> DataFrame:
    """asked (site, scope, key) with the nearest enclosing scope that has a row of bound (scope, key): (site, scope, depth)."""
    met = asked.join(outer, "scope").select("site", F.col("outer").alias("scope"), "depth", on).join(bound.select("scope", on).distinct(), ["scope", on])
    return met.groupBy("site").agg(F.min(F.struct("depth", "scope")).alias("m")).select("site", "m.scope", "m.depth")


def lookup(sites: DataFrame, scopes: DataFrame, bindings: DataFrame, defs: DataFrame, receivers: DataFrame, mro: DataFrame) -> DataFrame:
    """(site, id, step, confidence, rank): candidates of each site, the best of rank 1; step is what found it (1, 2, 3, 6)."""
    outer = cut(enclosing(scopes))
    none = lambda kind: F.lit(None).cast(kind)
    simple = F.element_at(F.split("qualified", r"\."), -1)
    kinds = sites.select("site", "kinds", "arg_count")
    known = defs.select("id", "kind", "required", "total")

    # 1: the scope that binds the name hides all others, and only then its bindings are looked at
    shadow = cut(_nearest(sites.select("site", "scope", "name"), outer, bindings, "name"))
    bound = sites.select("site", "name").join(shadow, "site").join(bindings, ["scope", "name"])
    lexical = bound.select("site", "id", F.lit(1).alias("step"), "origin", "depth", F.coalesce("linked", F.lit(True)).alias("linked"), none("int").alias("mro_depth"), F.lit(False).alias("own"))

    # 2: explicit receivers by their name, else self before this
    wanted = sites.where("by_receiver").select("site", "scope", F.explode(F.when(F.col("receiver").isNotNull(), F.array("receiver")).otherwise(F.array(*map(F.lit, IMPLICIT)))).alias("receiver"))
    tried = wanted.withColumn("asked", F.struct("site", "receiver"))
    near = _nearest(tried.select(F.col("asked").alias("site"), "scope", "receiver"), outer, receivers, "receiver")
    typed = near.select("site.site", "site.receiver", "scope").join(receivers.select("scope", "receiver", "type"), ["scope", "receiver"])
    single = defs.groupBy(F.col("qualified").alias("type")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("class")).where("n = 1")
    owners = typed.join(single, "type").groupBy("site").agg(F.min(F.struct("receiver", "class")).alias("m")).select("site", F.col("m.class").alias("class"))
    chain = owners.select("site", "class", F.col("class").alias("at"), F.lit(0).alias("mro_depth")).unionByName(owners.join(mro.select(F.col("child").alias("class"), (F.col("pos") + 1).cast("int").alias("mro_depth"), F.col("ancestor").alias("at")), "class").select("site", "class", "at", "mro_depth"))
    members = defs.where("owner IS NOT NULL").select("id", F.col("owner").alias("at"), simple.alias("name"))
    dispatched = chain.join(sites.select("site", "name"), "site").join(members, ["at", "name"]).select("site", "id", F.lit(2).alias("step"), none("string").alias("origin"), none("int").alias("depth"), none("boolean").alias("linked"), "mro_depth", (F.col("at") == F.col("class")).alias("own"))

    # 3: members of the owner that the site names
    owned = sites.where("owner IS NOT NULL").select("site", "name", F.col("owner").alias("at")).join(members, ["at", "name"]).select("site", "id", F.lit(3).alias("step"), F.lit("local").alias("origin"), F.lit(0).alias("depth"), F.lit(True).alias("linked"), none("int").alias("mro_depth"), F.lit(True).alias("own"))

    # 4: kinds; what several steps found is one candidate with the signals of all
    every = lexical.unionByName(dispatched).unionByName(owned).join(known, "id").join(kinds, "site").where(F.array_contains("kinds", F.col("kind")))
    by = lambda step, column: F.max(F.when(F.col("step") == step, F.col(column)))
    one = every.groupBy("site", "id").agg(
        F.max((F.col("step") == 3).cast("int")).alias("is3"), F.max((F.col("step") == 1).cast("int")).alias("is1"), by(1, "origin").alias("origin1"), F.min(F.when(F.col("step") == 1, F.col("depth"))).alias("depth1"),
        F.min(F.when(F.col("step") == 1, F.col("linked"))).alias("linked1"), F.min("mro_depth").alias("mro_depth"), F.max("own").alias("own"), F.first("required").alias("required"), F.first("total").alias("total"), F.first("arg_count").alias("arg_count"),
    )
    named = one.select(
        "site", "id", F.when(F.col("is3") == 1, 3).when(F.col("is1") == 1, 1).otherwise(2).alias("step"), F.when(F.col("is3") == 1, "local").when(F.col("is1") == 1, F.col("origin1")).alias("origin"),
        F.when(F.col("is3") == 1, 0).otherwise(F.col("depth1")).alias("depth"), F.coalesce("linked1", F.lit(True)).alias("linked"), "mro_depth", "own", "required", "total", "arg_count",
    )

    # 5: arity; a null verdict is unknown
    fits = F.when(F.col("total").isNotNull(), F.col("arg_count").between(F.coalesce("required", "total"), F.col("total")))
    per = Window.partitionBy("site")
    judged = named.withColumn("fits", F.when(F.col("arg_count").isNotNull(), fits)).withColumn("some", F.max(F.coalesce("fits", F.lit(False))).over(per)).withColumn("open", F.max(F.col("fits").isNull()).over(per))
    left = judged.where(F.when(F.col("arg_count").isNull(), True).when(F.col("some"), F.col("fits").isNull() | F.col("fits")).otherwise(F.col("open"))).drop("some", "open")

    # 6: nothing left and nothing hidden
    alone = sites.where(F.contains("name", F.lit("."))).join(left.select("site").distinct(), "site", "left_anti").join(shadow.select("site"), "site", "left_anti")
    qualified = defs.select("id", "kind", F.col("qualified").alias("name"))
    everywhere = alone.join(qualified, "name").where(F.array_contains("kinds", F.col("kind"))).select("site", "id", F.lit(6).alias("step"), F.lit("global-qualified").alias("origin"), none("int").alias("depth"), F.lit(True).alias("linked"), none("int").alias("mro_depth"), F.lit(False).alias("own"), none("boolean").alias("fits"))

    # 7: evidence and ties
    final = left.select(*everywhere.columns).unionByName(everywhere)
    weighed = final.withColumn("confidence", F.round(evidence(F.col("origin"), F.coalesce("depth", F.lit(0)), F.col("mro_depth"), F.col("own"), F.col("fits"), F.col("linked")), 6))
    priority = F.create_map(*[F.lit(x) for p in ORIGIN_PRIORITY.items() for x in p])
    order = Window.partitionBy("site").orderBy(F.desc(F.round("confidence", 3)), F.coalesce("depth", F.lit(0)), F.coalesce("mro_depth", F.lit(0)), priority[F.coalesce("origin", F.lit("import"))], "id")
    return weighed.withColumn("rank", F.row_number().over(order)).select("site", "id", "step", "confidence", "rank")
