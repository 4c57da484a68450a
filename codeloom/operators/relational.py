"""Joins, aggregations and windows of the graph queries, over (src, dst, type, confidence) edges and id-keyed nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Graph
from ..session import stored

# ---- expands --------------------------------------------------------------------------------------------------


def expand(edges: DataFrame, nodes: DataFrame, direction: str = "out", kinds: list[str] | None = None) -> DataFrame:
    """One hop from every node: (id, other, type, confidence, other's columns with prefix o_)."""
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    e = edges.where(F.col("type").isin(*kinds)) if kinds else edges
    other = nodes.select(*[F.col(c).alias(f"o_{c}") for c in nodes.columns])
    return e.join(other, F.col(far) == F.col("o_id")).select(F.col(near).alias("id"), F.col(far).alias("other"), "type", "confidence", *[c for c in other.columns if c != "o_id"])


def frontier_edges(edges: DataFrame, frontier: DataFrame, side: str) -> DataFrame:
    """Edges one end of which is in the frontier (one column: id); a semi join, so nothing is multiplied."""
    return edges.join(frontier.select(F.col("id").alias(side)).distinct(), side, "left_semi")


def optional_expand(nodes: DataFrame, edges: DataFrame, kinds: list[str], side: str = "dst") -> DataFrame:
    """Every node with its incoming (side dst) or outgoing edges of some types, or once with nulls."""
    other = "src" if side == "dst" else "dst"
    e = edges.where(F.col("type").isin(*kinds)).select(F.col(side).alias("__k"), F.col(other).alias("other"), F.col("type").alias("rel_type"))
    return nodes.join(e, nodes["id"] == F.col("__k"), "left").drop("__k")


def two_hop(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(a)-[first]->(b)-[second]->(c), distinct (a, b, c): distinct edges make distinct triples, so the join's result isn't sorted out again."""
    x = edges.where(F.col("type") == first).select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    y = edges.where(F.col("type") == second).select(F.col("src").alias("b"), F.col("dst").alias("c")).distinct()
    return x.join(y, "b").select("a", "b", "c")


def two_hop_counts(edges: DataFrame, first: str, second: str, wide: int = 1_000, tasks: int | None = None, middle: Column | None = None) -> DataFrame:
    """(a, n): how many distinct c two_hop finds for each a. What follows a b is sent to its a as one list of up to ``wide``.

    So the shuffle carries lists and not triples, and the lists hold numbers of four bytes and not ids. The lists of an
    a meet in one row; an a with more than ``wide`` b counts its distinct pairs instead.

    tasks: how many tasks share the rows (None: as Spark's settings have it). middle: a condition on b that every node
    with edges on both sides meets, so that edges which go on nowhere aren't shuffled.
    """
    dealt = lambda rows, key: rows.repartition(tasks, key) if tasks else rows
    through = F.lit(True) if middle is None else middle
    x = dealt(edges.where(F.col("type") == first).select(F.col("src").alias("a"), F.col("dst").alias("b")).where(through), "a").distinct().withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("a")) > wide)
    y = edges.where(F.col("type") == second).select(F.col("src").alias("b"), F.col("dst").alias("c")).where(through)
    # the c are numbered by parts, so no task sees them all: a number is c's rank in its part, times the parts, plus the part
    parts = 16 * (tasks or 4)
    ranked = dealt(y.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(parts))), "part").withColumn("number", F.when(F.col("c").isNotNull(), F.dense_rank().over(Window.partitionBy("part").orderBy("c")).cast("long") * parts + F.col("part")))
    block = F.shiftright("number", 31)
    numbered = dealt(ranked.select("b", block.cast("int").alias("block"), F.col("number").bitwiseAND(2**31 - 1).cast("int").alias("number")), "b").distinct()
    piece = F.floor((F.row_number().over(Window.partitionBy("b").orderBy("block", "number")) - 1) / wide)
    lists = numbered.withColumn("piece", piece).groupBy("b", "block", "piece").agg(F.collect_list("number").alias("numbers")).select("b", "block", "numbers")
    sent = dealt(dealt(x.where("NOT many").select("a", "b"), "b").join(lists.hint("merge"), "b").select("a", "block", "numbers"), "a")
    few = sent.groupBy("a", "block").agg(F.size(F.array_distinct(F.flatten(F.collect_list("numbers")))).cast("long").alias("n")).groupBy("a").agg(F.sum("n").alias("n"))
    few = few.select(F.col("a").alias("a"), "n")  # an a of its own: otherwise the optimizer keeps a projection here only, and the union's halves don't share the shuffle of x
    many = dealt(x.where("many").select("a", "b"), "b").join(numbered.hint("merge"), "b").groupBy("a").agg(F.countDistinct(F.when(F.col("number").isNotNull(), F.struct("block", "number"))).alias("n"))
    return few.unionByName(many)


def reference_counts(graph: Graph, spread: int = 64) -> DataFrame:
    """(id, side, rel, n): how many edges of a type come in and go out, for each node.

    Edges are dealt to the graph's tasks before they are counted, as counting where they are read holds all nodes of
    a task's input; the edges of one node are spread over some tasks first, which hand on one row each.
    """

    def side(near: str, far: str, name: str) -> DataFrame:
        e = graph.edges.select(F.col(near).alias("id"), F.lower("type").alias("rel"), F.pmod(F.xxhash64(far), F.lit(spread)).alias("part"))
        counted = graph.dealt(e, "id", "rel", "part").groupBy("id", "rel", "part").agg(F.count(F.lit(1)).alias("n"))
        return graph.dealt(counted, "id", "rel").groupBy("id", "rel").agg(F.sum("n").alias("n")).select("id", F.lit(name).alias("side"), "rel", "n")

    return side("dst", "src", "incoming").unionByName(side("src", "dst", "outgoing"))


def via_file(edges: DataFrame, defines: str = "DEFINES", uses: tuple[str, ...] = ("IMPORTS", "CALLS")) -> DataFrame:
    """(symbol, file, user): who imports or calls the file that defines a symbol."""
    d = edges.where(F.col("type") == defines).select(F.col("src").alias("file"), F.col("dst").alias("symbol"))
    u = edges.where(F.col("type").isin(*uses)).select(F.col("src").alias("user"), F.col("dst").alias("file"), F.col("type").alias("how"))
    return d.join(u, "file").select("symbol", "file", "user", "how").distinct()


def diamonds(edges: DataFrame, kind: str) -> DataFrame:
    """(top, left, right, bottom): bottom reaches top by two different middles, left < right."""
    # paths of two edges are met by their ends: which ends have two paths is counted on hashes of them alone, and only
    # these paths are made with their nodes; Spark broadcasts the hashes where they are few
    e = stored(edges.where(F.col("type") == kind).select("src", "dst").distinct(), "diamond-edges")
    paths = e.select(F.col("src").alias("bottom"), F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), F.col("dst").alias("top")), "mid").withColumn("ends", F.xxhash64("bottom", "top"))
    twice = stored(paths.select("ends").repartition("ends").groupBy("ends").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ends"), "diamond-ends")
    met = paths.join(twice, "ends").select("bottom", "top", "mid")
    left, right = met.withColumnRenamed("mid", "left_mid"), met.withColumnRenamed("mid", "right_mid")
    return left.join(right, ["bottom", "top"]).where("left_mid < right_mid").select("top", "left_mid", "right_mid", "bottom")


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, id, hops) for paths of exactly 1..k edges, distinct per length. k joins, no visited set."""
    reached = seeds.select(F.col("id").alias("seed"), "id")
    out = None
    step = edges.select(F.col("src").alias("id"), F.col("dst").alias("nxt")).distinct()
    for hops in range(1, k + 1):
        reached = reached.join(step, "id").select("seed", F.col("nxt").alias("id")).distinct()
        part = reached.withColumn("hops", F.lit(hops))
        out = part if out is None else out.unionByName(part)
    return out


def cross_community_calls(calls: DataFrame, members: DataFrame) -> DataFrame:
    """(from_comm, to_comm, calls) of calls between different communities; members (id, comm)."""
    a = members.select(F.col("id").alias("src"), F.col("comm").alias("from_comm"))
    b = members.select(F.col("id").alias("dst"), F.col("comm").alias("to_comm"))
    return calls.join(a, "src").join(b, "dst").where("from_comm <> to_comm").groupBy("from_comm", "to_comm").agg(F.count(F.lit(1)).alias("calls"))


def module_edges(calls: DataFrame, members: DataFrame) -> DataFrame:
    return cross_community_calls(calls, members).orderBy(F.desc("calls"), "from_comm", "to_comm")


def union_distinct(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of edge lists, one row per key."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.dropDuplicates(keys)


# ---- range and theta joins ------------------------------------------------------------------------------------


def range_overlap_join(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of equal key whose closed ranges overlap: left (key, start, end, ..), right (key, r_start, r_end, ..).

    Ranges are cut into bins of the given width and joined on (key, bin), so it stays an equi join; a pair is
    kept only in the bin where its overlap begins, so no distinct is needed. Choose the width near the usual range.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("long"), F.floor(F.col(b) / width).cast("long")))
    x = left.where(F.col("start") <= F.col("end")).withColumn("__bin", bins("start", "end"))
    y = right.where(F.col("r_start") <= F.col("r_end")).withColumn("__bin", bins("r_start", "r_end"))
    joined = x.join(y, [key, "__bin"]).where((F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")))
    return joined.where(F.col("__bin") == F.floor(F.greatest("start", "r_start") / width)).drop("__bin")


def overlapped(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """Rows of right (key, r_start, r_end, ..) whose closed range overlaps some range of left (key, start, end), once each.

    No pairs are made and no range is cut into bins: a row is met if of the ranges that start before its end one reaches
    its start. That is a running maximum over bins of positions, and before them one over the bins' own maxima.
    """
    bin_of = lambda c: F.floor(F.col(c) / width).cast("long").alias("__bin")
    x = left.where(F.col("start") <= F.col("end")).select(key, F.col("start").alias("__at"), bin_of("start"), F.lit(0).alias("__kind"), F.col("end").alias("__reach"))
    y = right.where(F.col("r_start") <= F.col("r_end")).select("*", F.col("r_end").alias("__at"), bin_of("r_end"), F.lit(1).alias("__kind"))
    rows = x.unionByName(y, allowMissingColumns=True).where(F.col(key).isNotNull())
    earlier = Window.partitionBy(key).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(key, "__bin").agg(F.max("__reach").alias("__reach")).select(key, "__bin", F.max("__reach").over(earlier).alias("__before"))
    inside = Window.partitionBy(key, "__bin").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumn("__reach", F.max("__reach").over(inside)).where("__kind = 1").join(carried, [key, "__bin"])
    return run.where(F.greatest("__reach", "__before") >= F.col("r_start")).select(*right.columns)


def innermost(sites: DataFrame, scopes: DataFrame, width: int = 256) -> DataFrame:
    """For each site (file, pos, site) the scope (file, r_start, r_end, scope) that starts last around it."""
    points = sites.withColumn("start", F.col("pos")).withColumn("end", F.col("pos"))
    w = Window.partitionBy("site").orderBy(F.desc("r_start"), "r_end", "scope")
    return range_overlap_join(points, scopes, "file", width).withColumn("n", F.row_number().over(w)).where("n = 1").select("site", "scope")


def longest_prefix(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(path, prefix): the deepest prefix directory above each path, null without one.

    Every path is exploded into its own ancestors (a handful), so this is an equi join, whatever the number of prefixes.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    every = paths.select("path").distinct().withColumn("prefix", F.explode(ancestors))
    hit = every.join(prefixes.select("prefix").distinct(), "prefix").groupBy("path").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return paths.join(hit, "path", "left")


def _segments(path: str) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _masked(segments: Column, mask: Column) -> Column:
    """The segments as one key, dynamic positions left open."""
    return F.array_join(F.zip_with(segments, mask, lambda s, open_: F.when(open_, "*").otherwise(s)), "/")


def _keyed_matches(urls: DataFrame, known: DataFrame) -> DataFrame:
    """(fetch, route, seq): urls (fetch, n, s) of n segments s against routes (route, seq, n, mask, key) with the same n."""
    shapes = known.select("n", "mask").distinct()
    few = shapes.limit(MAX_SHAPES + 1).count() <= MAX_SHAPES
    tried = urls.join(F.broadcast(shapes) if few else shapes, "n").withColumn("key", _masked(F.slice("s", F.lit(1), F.col("n")), F.col("mask")))
    return tried.join(known.select("route", "seq", "mask", "key"), ["mask", "key"]).select("fetch", "route", "seq")


#: Shapes of routes (which segments are dynamic) that are broadcast at most.
MAX_SHAPES = 10_000


def first_route_match(fetches: DataFrame, routes: DataFrame, matcher) -> DataFrame:
    """Fetches (fetch) with the first route (route, seq) that matches; matcher(fetch column, route column) -> Column.

    Routes have few shapes: which of their segments are dynamic. A fetch is tried once for each shape of its length, and
    joined by its literal segments, so the join is on equal keys however many routes there are. Catch-all routes are
    keyed by the segments in front. Fetches with dynamic segments of their own (templates) are compared by length.
    """
    urls = fetches.select("fetch").distinct().withColumn("s", _segments("fetch"))
    template = F.exists("s", lambda x: x.startswith("["))
    known = routes.select("route", "seq").withColumn("s", _segments("route"))
    rest = F.coalesce(F.try_element_at("s", F.lit(-1)).startswith("[...") | F.try_element_at("s", F.lit(-1)).startswith("[[..."), F.lit(False))
    known = known.withColumn("rest", rest).withColumn("s", F.when(rest, F.slice("s", F.lit(1), F.greatest(F.size("s") - 1, F.lit(0)))).otherwise(F.col("s")))
    known = known.withColumn("n", F.size("s")).withColumn("mask", F.transform("s", lambda x: x.startswith("["))).withColumn("key", _masked(F.col("s"), F.col("mask")))
    plain, odd = urls.where(~template), urls.where(template)
    fixed = _keyed_matches(plain.withColumn("n", F.size("s")), known.where("NOT rest"))
    open_end = _keyed_matches(plain.withColumn("n", F.explode(F.sequence(F.lit(0), F.size("s")))), known.where("rest"))
    lengths = known.select("route", "seq", "rest", F.col("n").alias("least"))
    by_length = odd.withColumn("least", F.explode(F.sequence(F.lit(0), F.size("s")))).join(lengths, "least").where(F.col("rest") | (F.col("least") == F.size("s"))).select("fetch", "route", "seq")
    found = fixed.unionByName(open_end).unionByName(by_length.where(matcher(F.col("fetch"), F.col("route"))))
    w = Window.partitionBy("fetch").orderBy("seq", "route")
    return found.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def typed_as(props: DataFrame, names: DataFrame) -> DataFrame:
    """Properties whose declared type is a name, or has it as type or generic argument: T, T<..>, ..<T>.

    The identifiers of the declared type are exploded, so the join is on equality instead of a nested loop.
    """
    words = props.withColumn("name", F.explode(F.array_distinct(F.regexp_extract_all("declaredType", F.lit(r"([A-Za-z_$][A-Za-z0-9_$.]*)"), 1))))
    fits = (F.col("declaredType") == F.col("name")) | F.col("declaredType").startswith(F.concat("name", F.lit("<"))) | F.col("declaredType").contains(F.concat(F.lit("<"), "name", F.lit(">")))
    return words.join(names.select("name").distinct(), "name").where(fits)


def hash_diff(current: DataFrame, stored: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, status): added, deleted, changed or unchanged."""
    c, s = current.select(key, F.col(value).alias("__new")), stored.select(key, F.col(value).alias("__old"))
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "changed").otherwise("unchanged")
    return c.join(s, key, "full").select(key, status.alias("status"))


# ---- ranking --------------------------------------------------------------------------------------------------


def best_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    return top_per_key(df, key, order, 1)


def top_per_key(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    """At most k rows per key. The rank filter is pushed below the exchange (partial group limit)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def top3_sum(hits: DataFrame, key: str, score: str = "score", tie: str = "node_id") -> DataFrame:
    """(key, score): the sum of each key's three best scores."""
    return top_per_key(hits, key, [F.desc(score), tie], 3).groupBy(key).agg(F.sum(score).alias(score))


def mode_label(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties to the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    return best_per_key(counts, key, [F.desc("n"), value])


def common_prefix(low: Column, high: Column) -> Column:
    """Common prefix of the smallest and the largest of some strings, hence of all of them."""
    lengths = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.length(low), F.length(high))))
    agree = F.filter(lengths, lambda n: F.substr(low, F.lit(1), n) == F.substr(high, F.lit(1), n))
    return F.coalesce(F.substr(low, F.lit(1), F.coalesce(F.array_max(agree), F.lit(0))), F.lit(""))


def clear_winner(candidates: DataFrame, key: str, score: str = "score", order: list | None = None) -> DataFrame:
    """(key, status, best): ok for one candidate or a clear lead (>= 0.95 and more than 0.09 ahead), else ambiguous."""
    w = Window.partitionBy(key).orderBy(*(order or [F.desc(score), "id"]))
    ranked = candidates.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead(score).over(w))
    clear = F.col("second").isNull() | ((F.col(score) >= 0.95) & (F.col(score) - F.col("second") > 0.09))
    return ranked.where("n = 1").select(key, F.when(clear, "ok").otherwise("ambiguous").alias("status"), F.col("id").alias("best"), F.col(score))


def carry_forward(df: DataFrame, key: str, order: list, marker: Column, name: str) -> DataFrame:
    """The last non-null marker so far, per key."""
    return df.withColumn(name, F.last(marker, ignorenulls=True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
