"""Whole-graph analytics: clusters, communities, entry points, processes, method resolution order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frameworks import path_multiplier
from ..functions.predicates import is_test_file
from ..functions.text import capitalize, sanitize_id
from ..session import cut
from .traverse import drop_contained, hierarchy, longest_per_ends, traces

# Folder names that say nothing about a community; name patterns of entry points and of utilities.
GENERIC_FOLDERS = ["src", "lib", "core", "utils", "common", "shared", "helpers"]
ENTRY_NAMES = r"(?i:^(main|init|bootstrap|start|run|setup|configure)$)|^(handle|on|process|execute|perform|dispatch|trigger|fire|emit)[A-Z]|(Handler|Controller)$"
UTILITY_NAMES = r"^(get|set|is|has|can|should|will|did|to|from)[A-Z]|^_|(?i:^(format|parse|validate|convert|transform|encode|decode|serialize|deserialize|clone|copy|deep|merge|extend|assign|filter|map|reduce|sort|find))|(?i:^(log|debug|error|warn|info)$)|(Helper|Utils?)$|(?i:^(utils?|helpers?)$)"


# ---- clusters -------------------------------------------------------------------------------------------------


def aggregate_clusters(communities: DataFrame, tie: Column | None = None, least: int = 5) -> DataFrame:
    """Communities (label, id, symbols, cohesion) of equal label as one: summed size, weighted cohesion, largest id."""
    size = F.struct(F.col("symbols"), tie if tie is not None else F.col("id"))
    out = communities.groupBy("label").agg(
        F.max_by("id", size).alias("id"),
        F.sum("symbols").alias("symbol_count"),
        (F.sum(F.col("cohesion") * F.col("symbols")) / F.sum("symbols")).alias("cohesion"),
        F.count(F.lit(1)).alias("sub_communities"),
    )
    return out.where(F.col("symbol_count") >= least)


def neighbours(edges: DataFrame) -> DataFrame:
    """Undirected simple graph: (a, b) both ways, no loops, no repeats."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def cohesion(edges: DataFrame, members: DataFrame, sample: int | None = 50) -> DataFrame:
    """(comm, cohesion): share of neighbours inside, over the first ``sample`` members of each community; 1.0 if none.

    The sample is the operator's own definition (None: all members).
    """
    near = neighbours(edges)
    picked = members
    if sample is not None:
        picked = members.withColumn("n", F.row_number().over(Window.partitionBy("comm").orderBy("id"))).where(F.col("n") <= sample).drop("n")
    inner = picked.join(near, F.col("id") == F.col("a")).join(members.select(F.col("id").alias("b"), F.col("comm").alias("other")), "b")
    share = inner.groupBy("comm").agg(F.avg((F.col("comm") == F.col("other")).cast("double")).alias("c"))
    sizes = members.groupBy("comm").agg(F.count(F.lit(1)).alias("symbols"))
    return sizes.join(share, "comm", "left").select("comm", "symbols", F.when(F.col("symbols") <= 1, 1.0).otherwise(F.coalesce(F.least("c", F.lit(1.0)), F.lit(1.0))).alias("cohesion"))


def communities(edges: DataFrame, rounds: int = 5, large: int | None = None) -> DataFrame:
    """(id, comm): deterministic label propagation, weighted by modularity gain; comm is the smallest id inside.

    Every round each node looks at the labels of its neighbours and takes the one with the largest modularity gain
    (links to the label minus what its total degree lets expect), ties to the smallest label. Nodes move in two
    alternating halves (by a hash) so that neighbours don't swap labels for ever. Every node and edge counts at every
    size; only who sets ``large`` asks for the quicker mode of graphs with more nodes than that: without edges of low
    confidence and nodes of degree one, in few rounds.
    """
    near = cut(neighbours(edges))
    if large is not None and near.select("a").distinct().count() > large:
        strong = edges.where("confidence IS NULL OR confidence >= 0.5") if "confidence" in edges.columns else edges
        near = neighbours(strong)
        firm = near.groupBy("a").agg(F.count(F.lit(1)).alias("d")).where("d >= 2").select("a")
        near = cut(near.join(firm, "a", "left_semi").join(firm.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
        rounds = 3
    degree = cut(near.groupBy("a").agg(F.count(F.lit(1)).alias("d")))
    total = degree.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0] or 1
    state = cut(degree.select(F.col("a").alias("id"), "d", F.col("a").alias("comm")))
    quality, best = -1.0, state
    for step in range(2 * rounds):
        weight = state.groupBy("comm").agg(F.sum("d").alias("w"))
        # only the links of the half that may move are made; a neighbour brings the weight of its community along
        known = state.join(weight, "comm").select(F.col("id").alias("b"), "comm", "w")
        turn = lambda c: F.pmod(F.xxhash64(c), F.lit(2)) == step % 2  # noqa: B023, E731
        links = near.where(turn("a")).join(known, "b").groupBy(F.col("a").alias("id"), "comm").agg(F.count(F.lit(1)).alias("k"), F.max("w").alias("w"))
        scored = links.join(state.select("id", "d", F.col("comm").alias("own")), "id")
        # the node's own degree doesn't count against the community it is in
        rest = F.col("w") - F.when(F.col("comm") == F.col("own"), F.col("d")).otherwise(0)
        gain = F.col("k") - F.col("d") * rest / F.lit(float(total))
        pick = Window.partitionBy("id").orderBy(F.desc(F.round(gain, 9)), F.desc((F.col("comm") == F.col("own")).cast("int")), "comm")
        wish = scored.withColumn("gain", gain).withColumn("n", F.row_number().over(pick)).where("n = 1").where(F.col("gain") > 0).select("id", F.col("comm").alias("wish"))
        state = cut(state.join(wish, "id", "left").select("id", "d", F.when(F.col("wish").isNotNull(), F.col("wish")).otherwise(F.col("comm")).alias("comm")))
        if step % 2:
            now = modularity(near, state)
            if now <= quality + 1e-9:
                break
            quality, best = now, state
    first = best.groupBy("comm").agg(F.min("id").alias("first"))
    return best.join(first, "comm").select("id", F.col("first").alias("comm"))


def modularity(near: DataFrame, members: DataFrame) -> float:
    """Modularity of a partition of an undirected graph given both ways; members (id, comm), and d, the degrees, if they are known."""
    m = members.select("id", "comm")
    known = members if "d" in members.columns else near.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d")).join(m, "id")
    row = known.groupBy("comm").agg(F.sum("d").alias("d")).agg(F.sum("d").alias("total"), F.sum(F.col("d").cast("double") ** 2).alias("squares")).first()
    total = row["total"] or 1
    inside = 2 * near.where("a < b").join(m.withColumnRenamed("id", "a"), "a").join(m.select(F.col("id").alias("b"), F.col("comm").alias("c2")), "b").where("comm = c2").count()
    return inside / total - (row["squares"] or 0.0) / total**2


def community_nodes(members: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(comm, symbols, cohesion, label): communities of at least two, named by their most frequent telling folder.

    members (id, comm); paths (id, filePath, name). Without a folder the common prefix of three or more names, else Cluster_ and its id.
    """
    sized = cohesion(edges, members).where("symbols >= 2")
    of = members.join(paths, "id")
    parts = F.filter(F.split("filePath", "/"), lambda s: s != "")
    folders = of.where(F.size(parts) >= 2).withColumn("folder", F.element_at(parts, -2)).where(~F.lower("folder").isin(GENERIC_FOLDERS))
    counted = folders.groupBy("comm", "folder").agg(F.count(F.lit(1)).alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("comm").orderBy(F.desc("n"), "folder"))).where("k = 1").select("comm", "folder")
    from .relational import common_prefix

    names = of.groupBy("comm").agg(F.min("name").alias("low"), F.max("name").alias("high"), F.count("name").alias("names"))
    named = names.withColumn("prefix", F.when(F.col("names") > 2, common_prefix(F.col("low"), F.col("high"))))
    out = sized.join(top, "comm", "left").join(named.select("comm", "prefix"), "comm", "left")
    return out.select("comm", "symbols", "cohesion", F.coalesce(capitalize("folder"), F.when(F.length("prefix") > 2, capitalize("prefix")), F.concat(F.lit("Cluster_"), "comm")).alias("label"))


# ---- entry points and processes -------------------------------------------------------------------------------


def name_multiplier(name: Column | str) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.when(name.rlike(UTILITY_NAMES), 0.3).when(name.rlike(ENTRY_NAMES), 1.5).otherwise(1.0)


def entry_points(nodes: DataFrame, calls: DataFrame, limit: int | None = 200) -> DataFrame:
    """(id, score, callees, callers) of functions and methods that call something, test files apart.

    Score: callees / (callers + 1), times 2 if exported, times name, path and decorator multipliers.
    """
    out = calls.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    f = nodes.where(F.col("label").isin("Function", "Method") & ~F.coalesce(is_test_file("filePath"), F.lit(False)))
    j = f.join(out, "id").join(into, "id", "left").withColumn("callers", F.coalesce("callers", F.lit(0)))
    ast = F.greatest(F.coalesce(F.col("astMultiplier"), F.lit(1.0)), F.lit(1.0)) if "astMultiplier" in nodes.columns else F.lit(1.0)
    score = F.col("callees") / (F.col("callers") + 1.0) * F.when(F.col("isExported"), 2.0).otherwise(1.0) * name_multiplier("name") * path_multiplier("filePath") * ast
    scored = j.select("id", score.alias("score"), "callees", "callers").where("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(limit) if limit else scored


def max_processes(n_symbols: int) -> int:
    # A tenth of the symbols, between 20 and 300.
    return max(20, min(300, int(n_symbols / 10 + 0.5)))


def processes(nodes: DataFrame, calls: DataFrame, members: DataFrame, cap: int, max_depth: int = 10, branching: int = 4, per_entry: int = 12, min_steps: int = 3) -> tuple[DataFrame, DataFrame]:
    """(processes, steps): traces from entry points, contained ones dropped, one per pair of ends, the longest ``cap``.

    processes: id, label, processType, stepCount, communities, entryPointId, terminalId; steps: id, process, step (from 1).
    """
    strong = calls.where("confidence IS NULL OR confidence >= 0.5")
    found = traces(strong, entry_points(nodes, strong), max_depth, branching, per_entry, min_steps)
    unique = longest_per_ends(drop_contained(found)).select("path").distinct()
    top = cut(unique.withColumn("stepCount", F.size("path")).orderBy(F.desc("stepCount"), "path").limit(cap))
    ordered = top.withColumn("number", F.row_number().over(Window.orderBy(F.desc("stepCount"), "path")) - 1)  # at most cap rows
    names = nodes.select("id", "name")
    ends = ordered.withColumn("entryPointId", F.col("path")[0]).withColumn("terminalId", F.element_at("path", -1))
    named = ends.join(names.select(F.col("id").alias("entryPointId"), F.col("name").alias("a")), "entryPointId", "left").join(names.select(F.col("id").alias("terminalId"), F.col("name").alias("z")), "terminalId", "left")
    named = named.withColumn("a", F.coalesce("a", F.lit("Unknown"))).withColumn("z", F.coalesce("z", F.lit("Unknown")))
    named = cut(named.withColumn("process", F.concat(F.lit("proc_"), F.col("number").cast("string"), F.lit("_"), sanitize_id("a"))))
    steps = named.select("process", F.posexplode("path").alias("at", "id")).select("id", "process", (F.col("at") + 1).alias("step"))
    touched = steps.join(members, "id").groupBy("process").agg(F.sort_array(F.collect_set("comm")).alias("communities"))
    out = named.join(touched, "process", "left").withColumn("communities", F.coalesce("communities", F.array().cast("array<string>")))
    kind = F.when(F.size("communities") > 1, "cross_community").otherwise("intra_community")
    return out.select(F.col("process").alias("id"), F.concat(capitalize("a"), F.lit(" → "), capitalize("z")).alias("label"), kind.alias("processType"), "stepCount", "communities", "entryPointId", "terminalId"), steps


# ---- method resolution order ----------------------------------------------------------------------------------


def merge_orders(parents: list[str], orders: list[list[str]]) -> list[str] | None:
    """C3 merge of the parents' own orders, without the class itself; None for an inconsistent hierarchy."""
    rows = [[p, *order] for p, order in zip(parents, orders)] + [list(parents)]
    out = []
    while rows := [r for r in rows if r]:
        head = next((r[0] for r in rows if not any(r[0] in o[1:] for o in rows)), None)
        if head is None:
            return None
        out.append(head)
        rows = [[x for x in r if x != head] if r[0] == head else r for r in rows]
    return out


def c3(parents: dict[str, list[str]], name: str, active: frozenset = frozenset()) -> list[str] | None:
    """C3 linearisation without the class itself; None for a cycle or an inconsistent hierarchy."""
    if name in active:
        return None
    orders = [c3(parents, parent, active | {name}) for parent in parents.get(name, [])]
    return None if None in orders else merge_orders(parents.get(name, []), orders)


def linear_orders(heritage: DataFrame) -> DataFrame:
    """(child, order, exact): the ancestors of each class in C3 order; breadth first (exact = false) where C3 has no answer.

    heritage (child, parent, seq). A class is merged from its parents' orders (a class has few ancestors), bases first.
    """
    return hierarchy(heritage, merge_orders).select("child", F.coalesce("order", "near").alias("order"), F.col("order").isNotNull().alias("exact"))


def linearize(heritage: DataFrame) -> DataFrame:
    """(child, pos, ancestor, exact): linear_orders with a row for each ancestor, positions from 0."""
    return linear_orders(heritage).select("child", F.posexplode("order").alias("pos", "ancestor"), "exact")


def mro_collisions(mro: DataFrame, methods: DataFrame, heritage: DataFrame, strategy: str = "first-wins") -> DataFrame:
    """(class, method, winner, confidence, reason): methods that two or more ancestors define and the class doesn't.

    methods (owner, id, name). Strategies: first-wins, leftmost-base and c3 take the first in order; implements-split
    prefers classes over interfaces and finds several interfaces ambiguous; qualified-syntax never picks;
    ruby-mixin takes the last.
    """
    own = methods.select(F.col("owner").alias("child"), "name")
    inherited = mro.join(methods.select(F.col("owner").alias("ancestor"), F.col("id").alias("method"), "name"), "ancestor").join(own, ["child", "name"], "left_anti")
    kinds = heritage.select("child", F.col("parent").alias("ancestor"), "kind").distinct()
    inherited = inherited.join(kinds, ["child", "ancestor"], "left").withColumn("is_interface", F.coalesce(F.col("kind") == "IMPLEMENTS", F.lit(False)))
    rank = [F.desc("pos"), "method"] if strategy == "ruby-mixin" else (["is_interface", "pos", "method"] if strategy == "implements-split" else ["pos", "method"])
    w = Window.partitionBy("child", "name").orderBy(*rank)
    whole = Window.partitionBy("child", "name")
    marked = inherited.withColumn("n", F.row_number().over(w)).withColumn("k", F.size(F.collect_set("ancestor").over(whole))).withColumn("classes", F.sum((~F.col("is_interface")).cast("int")).over(whole))
    best = marked.where("n = 1 AND k > 1")
    if strategy == "qualified-syntax":
        return best.select(F.col("child").alias("class"), F.col("name").alias("method"), F.lit(None).cast("string").alias("winner"), F.lit(0.5).alias("confidence"), F.lit("ambiguous: qualify the call").alias("reason"))
    split = strategy == "implements-split"
    ambiguous = (F.col("classes") == 0) if split else F.lit(False)
    sure = F.when(ambiguous, 0.5).otherwise(F.lit(0.95 if split else 0.9))
    why = F.when(ambiguous, "ambiguous: several interfaces").otherwise(F.concat(F.lit(f"{strategy}: "), "ancestor"))
    return best.select(F.col("child").alias("class"), F.col("name").alias("method"), F.when(~ambiguous, F.col("method")).alias("winner"), sure.alias("confidence"), why.alias("reason"))


def method_implements(mro: DataFrame, methods: DataFrame, abstract_owners: DataFrame) -> DataFrame:
    """(src, dst, confidence): concrete methods and the interface or abstract methods above that they fulfil.

    methods (owner, id, name, parameterTypes, parameterCount, isAbstract). Equal parameter types give 1.0, else an
    equal count 0.7; with unknown parameters the name alone 0.7.
    """
    concrete = methods.where("NOT coalesce(isAbstract, false)").join(abstract_owners.select("owner"), "owner", "left_anti")
    wanted = methods.join(abstract_owners.select("owner"), "owner", "left_semi").select(F.col("owner").alias("ancestor"), F.col("id").alias("dst"), "name", F.col("parameterTypes").alias("t2"), F.col("parameterCount").alias("c2"))
    pairs = concrete.join(mro.select(F.col("child").alias("owner"), "ancestor"), "owner").join(wanted, ["ancestor", "name"])
    known = F.col("parameterTypes").isNotNull() & F.col("t2").isNotNull()
    same = F.when(known, F.col("parameterTypes") == F.col("t2")).otherwise(F.coalesce(F.col("parameterCount") == F.col("c2"), F.lit(True)))
    return pairs.where(same).select(F.col("id").alias("src"), "dst", F.when(known, 1.0).otherwise(0.7).alias("confidence")).distinct()


def lookup_with_mro(sites: DataFrame, mro: DataFrame, methods: DataFrame) -> DataFrame:
    """sites (site, owner, name) with the nearest definition: the owner's, else the first ancestor's in order."""
    direct = sites.join(methods.select("owner", "name", F.col("id").alias("method")), ["owner", "name"]).select("site", "method", F.lit(-1).alias("pos"))
    above = sites.join(mro.select(F.col("child").alias("owner"), "pos", "ancestor"), "owner").join(methods.select(F.col("owner").alias("ancestor"), "name", F.col("id").alias("method")), ["ancestor", "name"]).select("site", "method", "pos")
    w = Window.partitionBy("site").orderBy("pos", "method")
    return direct.unionByName(above).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
