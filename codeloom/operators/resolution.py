"""Name resolution as ranked unions of joins: tiers, re-exports, imports, dispatch, evidence.

sites (site, file, name, form, arg_count), defs (id, file, name, kind, owner, required, total, return_type),
imports (file, source, local, exported). No row is looked up by itself: every tier is one join for all sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# Confidence by tier, origin priorities, evidence weights.
TIER_CONFIDENCE = {"same-file": 0.95, "import-scoped": 0.9, "global": 0.5}
ORIGIN_PRIORITY = {"local": 0, "import": 1, "reexport": 2, "namespace": 3, "wildcard": 4, "global-qualified": 5, "global-name": 6}
ORIGIN_WEIGHT = {"local": 0.55, "import": 0.45, "reexport": 0.4, "namespace": 0.4, "wildcard": 0.3, "global-qualified": 0.35, "global-name": 0.1}
MRO_WEIGHT = [0.5, 0.42, 0.36, 0.32, 0.3]
HOP_PENALTY, OWNER_WEIGHT, ARITY_FIT, ARITY_MISFIT, UNLINKED = 0.02, 0.2, 0.1, -0.15, 0.5
CALLABLE = ["Function", "Method", "Constructor", "Macro", "Delegate"]


def reexport_chain(imports: DataFrame, defs: DataFrame, hops: int = 5) -> DataFrame:
    """(file, local, id, hops): what an imported name stands for, followed through re-exports at most ``hops`` times."""
    current = imports.select(F.col("file").alias("origin"), F.col("local").alias("as"), F.col("source").alias("file"), F.col("exported").alias("name"), F.array("file").alias("seen"))
    found = None
    for k in range(1, hops + 1):
        hit = current.join(defs.select("file", "name", "id"), ["file", "name"]).select(F.col("origin").alias("file"), F.col("as").alias("local"), "id", F.lit(k).alias("hops"))
        found = hit if found is None else found.unionByName(hit)
        step = imports.select("file", F.col("local").alias("name"), F.col("source").alias("next"), F.col("exported").alias("next_name"))
        current = cut(current.where(~F.array_contains("seen", F.col("file"))).join(step, ["file", "name"]).select("origin", "as", F.col("next").alias("file"), F.col("next_name").alias("name"), F.concat("seen", F.array("file")).alias("seen")))
        if current.isEmpty():
            break
    w = Window.partitionBy("file", "local").orderBy("hops", "id")
    return found.withColumn("n", F.dense_rank().over(Window.partitionBy("file", "local").orderBy("hops"))).where("n = 1").drop("n").withColumn("k", F.row_number().over(w)).drop("k")


def resolve_tiers(sites: DataFrame, defs: DataFrame, imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(site, id, tier, confidence): candidates of the first tier that has any.

    Tiers: the file itself; names imported (through re-exports); files imported; files of the same package
    (packages: file, package); anywhere.
    """
    d = defs.select("id", "name", F.col("file").alias("def_file"))
    best, sites = None, cut(sites)
    for keys, table, rank, tier in _tiers(sites, d, imports, defs, packages):
        part = rank.join(table.hint("merge"), keys).select("site", "id", F.lit(tier).alias("tier"))
        best = part if best is None else best.unionByName(part)
    levels = F.create_map(*[F.lit(x) for p in TIER_CONFIDENCE.items() for x in p])
    return best.distinct().withColumn("confidence", levels[F.col("tier")])


def _tiers(sites: DataFrame, d: DataFrame, imports: DataFrame, defs: DataFrame, packages: DataFrame | None) -> list[tuple]:
    """(keys, definitions, rows of sites, tier) for each tier: only the sites whose first tier it is, with its keys.

    Which tier is a site's first is settled on distinct keys, so a name that many files define costs nothing where a
    nearer tier has it.
    """
    chain = reexport_chain(imports, defs).select("file", F.col("local").alias("name"), "id").distinct()
    near = imports.select("file", F.col("source").alias("def_file")).distinct()
    own = F.col("file").alias("def_file")
    steps = [(["def_file", "name"], d, sites.select("site", own, "name"), "same-file"), (["file", "name"], chain, sites.select("site", "file", "name"), "import-scoped"), (["def_file", "name"], d, sites.join(near.hint("merge"), "file").select("site", "def_file", "name"), "import-scoped")]
    if packages is not None:
        mates = packages.select("file", "package").join(packages.select(F.col("file").alias("def_file"), "package"), "package").where("file <> def_file").select("file", "def_file").distinct()
        steps.append((["def_file", "name"], d, sites.join(mates.hint("merge"), "file").select("site", "def_file", "name"), "import-scoped"))
    steps.append((["name"], d, sites.select("site", "name"), "global"))
    marks = None
    for rank, (keys, table, asked, _) in enumerate(steps):
        there = asked.join(table.select(*keys).distinct().hint("merge"), keys, "left_semi").select("site", F.lit(rank).alias("rank"))
        marks = there if marks is None else marks.unionByName(there)
    first = cut(marks.groupBy("site").agg(F.min("rank").alias("rank")))
    return [(keys, table, asked.join(first.where(F.col("rank") == rank).select("site").hint("merge"), "site", "left_semi"), tier) for rank, (keys, table, asked, tier) in enumerate(steps)]


def lone_candidates(sites: DataFrame, defs: DataFrame, imports: DataFrame, packages: DataFrame | None = None) -> DataFrame:
    """(site, id, confidence): what resolve_tiers and narrow_overloads leave of a site, where that is one definition.

    Definitions of one name and file (of one name for the last tier) that take the same arguments are one row with their
    number, so a site never meets all definitions of a name.
    """
    call = F.col("kind").isin(CALLABLE)
    takes = ["required", "total"]
    d = defs.select("id", "name", F.col("file").alias("def_file"), call.alias("callable"), *takes)
    alike = lambda df, keys: df.where("callable").groupBy(*keys, *takes).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    facts = d.select("id", "callable", *takes).distinct()
    found, sites = None, cut(sites)
    for keys, table, asked, tier in _tiers(sites, d.select("id", "name", "def_file"), imports, defs, packages):
        rows = d if "def_file" in table.columns else table.join(facts.hint("merge"), "id")
        part = asked.join(alike(rows, keys).hint("merge"), keys).select("site", "n", "id", *takes, F.lit(TIER_CONFIDENCE[tier]).alias("confidence"))
        found = part if found is None else found.unionByName(part)
    found = found.join(sites.select("site", "arg_count").hint("merge"), "site")
    fits = F.coalesce(F.col("arg_count").isNull() | F.col("total").isNull() | F.col("arg_count").between(F.coalesce("required", "total"), F.col("total")), F.lit(False))
    sums = lambda c, w: [F.sum(F.when(w, F.col("n"))).alias(f"{c}_n"), F.min(F.when(w, F.col("id"))).alias(f"{c}_id")]
    by = found.withColumn("fits", fits).groupBy("site").agg(*sums("fit", F.col("fits")), *sums("all", F.lit(True)), F.max("confidence").alias("confidence"))
    n, one = F.coalesce("fit_n", "all_n"), F.when(F.col("fit_n").isNotNull(), F.col("fit_id")).otherwise(F.col("all_id"))
    return by.where(n == 1).select("site", one.alias("id"), "confidence")


def narrow_overloads(candidates: DataFrame, defs: DataFrame, sites: DataFrame) -> DataFrame:
    """Candidates (site, id, ..) whose kind is callable and whose arity fits, if any fits; else all callable ones."""
    j = candidates.join(defs.select("id", "kind", "required", "total"), "id").join(sites.select("site", "arg_count"), "site").where(F.col("kind").isin(CALLABLE))
    fits = F.col("arg_count").isNull() | F.col("total").isNull() | F.col("arg_count").between(F.coalesce("required", "total"), F.col("total"))
    best = Window.partitionBy("site")
    return j.withColumn("fits", fits.cast("int")).withColumn("any", F.max("fits").over(best)).where("fits = any").select(*candidates.columns)


def suffix_imports(imports: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """(file, spec, target): import specs matched by path suffix, with the extension candidates in order; shortest path wins.

    Every path is exploded into its suffixes once, so the match is an equi join.
    """
    parts = F.split("path", "/")
    suffixes = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).alias("suffix"))
    spec = F.regexp_replace("spec", r"^(\.\.?/)+", "")
    tried = imports.select("file", "spec", F.posexplode(F.array(*[F.concat(spec, F.lit(e)) for e in extensions])).alias("rank", "suffix"))
    hit = tried.join(suffixes, "suffix").where("path <> file")
    w = Window.partitionBy("file", "spec").orderBy("rank", F.length("path"), "path")
    return hit.withColumn("n", F.row_number().over(w)).where("n = 1").select("file", "spec", F.col("path").alias("target"))


def interface_dispatch(calls: DataFrame, methods: DataFrame, heritage: DataFrame) -> DataFrame:
    """(site, id, confidence 0.7): calls of an interface's method also reach that name in its implementors.

    calls (site, id), methods (id, owner, name), heritage (child, parent, kind).
    """
    m = calls.join(methods.select("id", "owner", "name"), "id").join(heritage.where("kind = 'IMPLEMENTS'").select("child", F.col("parent").alias("owner")), "owner")
    impl = methods.select(F.col("owner").alias("child"), "name", F.col("id").alias("target"))
    return m.join(impl, ["child", "name"]).where("target <> id").select("site", F.col("target").alias("id"), F.lit(0.7).alias("confidence")).distinct()


def methods_by_owner(sites: DataFrame, defs: DataFrame) -> DataFrame:
    """sites (site, owner, name, arg_count) -> (site, id): one definition, or several that agree on the return type (the first)."""
    j = sites.join(defs.select("owner", "name", "id", "required", "total", "return_type"), ["owner", "name"])
    j = j.where(F.col("arg_count").isNull() | F.col("total").isNull() | F.col("arg_count").between(F.coalesce("required", "total"), F.col("total")))
    w = Window.partitionBy("site")
    agreed = (F.count("id").over(w) == 1) | (F.size(F.collect_set("return_type").over(w)) == 1)
    return j.withColumn("ok", agreed).where("ok").groupBy("site").agg(F.min("id").alias("id"))


def evidence(origin: Column, hops: Column, mro_depth: Column, owner_match: Column, arity: Column, linked: Column) -> Column:
    """Confidence from signals: origin, scope distance, MRO distance, owner, arity (true, false, null), unlinked imports halved; at most 1."""
    weights = F.create_map(*[F.lit(x) for p in ORIGIN_WEIGHT.items() for x in p])
    base = F.coalesce(weights[origin], F.lit(0.0)) * F.when(linked, 1.0).otherwise(UNLINKED)
    by_mro = F.when(mro_depth.isNull(), 0.0).otherwise(F.element_at(F.array(*[F.lit(x) for x in MRO_WEIGHT]), F.least(mro_depth, F.lit(len(MRO_WEIGHT) - 1)) + 1))
    fit = F.when(arity.isNull(), 0.0).when(arity, ARITY_FIT).otherwise(ARITY_MISFIT)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - HOP_PENALTY * F.coalesce(hops, F.lit(0)) + by_mro + F.when(owner_match, OWNER_WEIGHT).otherwise(0.0) + fit))


def tie_break(candidates: DataFrame) -> DataFrame:
    """(site, id) of the best candidate: confidence (to 0.001), scope depth, MRO depth, origin, id.

    candidates (site, id, confidence, scope_depth, mro_depth, origin).
    """
    priority = F.create_map(*[F.lit(x) for p in ORIGIN_PRIORITY.items() for x in p])
    w = Window.partitionBy("site").orderBy(F.desc(F.round("confidence", 3)), "scope_depth", "mro_depth", priority[F.col("origin")], "id")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def scope_lookup(sites: DataFrame, scopes: DataFrame, bindings: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """(site, id, hops): the nearest enclosing scope that binds the name; a binding hides outer ones.

    Scopes nested deeper than max_depth, or in a circle, are an error.

    sites (site, scope, name), scopes (scope, parent), bindings (scope, name, id).
    """
    current = sites.select("site", "scope", "name", F.lit(0).alias("hops"))
    out = None
    for _ in range(max_depth):
        hit = cut(current.join(bindings, ["scope", "name"]).select("site", "id", "hops"))
        out = hit if out is None else out.unionByName(hit)
        rest = current.join(hit.select("site").distinct(), "site", "left_anti")
        current = cut(rest.join(scopes.where("parent IS NOT NULL"), "scope").select("site", F.col("parent").alias("scope"), "name", (F.col("hops") + 1).alias("hops")))
        if current.isEmpty():
            return out
    raise RuntimeError(f"scopes are nested more than {max_depth} deep")


def wildcard_bindings(imports: DataFrame, exports: DataFrame, cap: int = 1_000) -> DataFrame:
    """(file, name, id): names that a whole-file import brings in; the cap per file is part of the definition."""
    j = imports.select("file", F.col("source").alias("def_file")).distinct().join(exports.select(F.col("file").alias("def_file"), "name", "id"), "def_file")
    w = Window.partitionBy("file").orderBy("def_file", "name", "id")
    return j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).select("file", "name", "id")


def propagate_types(known: DataFrame, links: DataFrame) -> DataFrame:
    """Fixpoint of types over import links: known (name, type), links (name, source); the first type reached stays.

    Only the names of the last round go on, as the others' links were followed before. No table is sent to all tasks.
    """
    fresh = cut(known.select("name", "type").dropDuplicates(["name"]))
    state, parts = fresh, 1
    while True:  # every round adds names or is the last
        reached = links.select("name", "source").join(fresh.withColumnRenamed("name", "source").hint("merge"), "source").groupBy("name").agg(F.min("type").alias("type"))
        fresh = cut(reached.join(state.select("name").hint("merge"), "name", "left_anti"))
        if fresh.isEmpty():
            break
        state, parts = state.unionByName(fresh), parts + 1
        if parts % 10 == 0:
            state = cut(state)
    return state


def call_edges(sites: DataFrame, passes: list[DataFrame]) -> DataFrame:
    """(src, dst, confidence, pass): passes (site, id, confidence) in order, each only for the sites that earlier ones left."""
    taken, out = None, None
    for number, found in enumerate(passes):
        left = found if taken is None else found.join(taken, "site", "left_anti")
        part = left.withColumn("pass", F.lit(number))
        out = part if out is None else out.unionByName(part)
        taken = out.select("site").distinct()
    return out.join(sites.select("site", F.col("caller").alias("src")), "site").groupBy("src", F.col("id").alias("dst")).agg(F.max("confidence").alias("confidence"), F.min("pass").alias("pass"))
