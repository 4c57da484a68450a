"""Iterative dataflow: breadth-first searches, closures, levels and trace enumeration.

Each level is a join of the frontier with the edges and an anti join with what was seen, checkpointed in the shared
folder (lineage stays short, a lost executor costs one level). Nothing of the graph reaches the driver but counts.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable
from itertools import count
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, ensure_checkpoint_dir

#: Rounds after which the parts of a result that grows in rounds are written as one, so that its plan stays small.
MAX_PARTS = 50


def bfs(edges: DataFrame, seeds: DataFrame, direction: str = "up", max_depth: int = 3, node_filter: DataFrame | None = None, per_seed: bool = False) -> DataFrame:
    """(id, depth, parent, type, confidence) of what the seeds (id) reach, seeds excluded; with per_seed also (seed).

    direction up follows edges against their sense (who depends on a node), down along it. Of several edges that
    reach a node first at the same depth the one with the highest confidence, then type, then parent is reported.
    Nodes outside node_filter (id) are neither reported nor walked through.
    """
    near, far = ("dst", "src") if direction == "up" else ("src", "dst")
    keys = ["seed", "id"] if per_seed else ["id"]
    step = edges.select(F.col(near).alias("parent"), F.col(far).alias("id"), "type", "confidence")
    if node_filter is not None:
        step = step.join(node_filter.select("id").distinct(), "id", "left_semi")
    start = seeds.select(*([F.col("id").alias("seed")] if per_seed else []), "id").distinct()
    columns = [*keys, "depth", "parent", "type", "confidence"]
    seen = start.select(*keys, F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("double").alias("confidence"))
    frontier = seen
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("confidence"), "type", "parent")
    for depth in range(1, max_depth + 1):
        hop = frontier.select(*(["seed"] if per_seed else []), F.col("id").alias("parent")).join(step, "parent").join(seen.select(*keys), keys, "left_anti")
        frontier = cut(hop.withColumn("n", F.row_number().over(best)).where("n = 1").withColumn("depth", F.lit(depth)).select(*columns))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def closure(edges: DataFrame, seeds: DataFrame, direction: str, max_depth: int) -> tuple[DataFrame, bool]:
    """(reached incl. seeds, complete?): complete is false if a further level would add nodes."""
    found = bfs(edges, seeds, direction, max_depth)
    whole = found.select("id", "depth").unionByName(seeds.select("id", F.lit(0).alias("depth"))).groupBy("id").agg(F.min("depth").alias("depth"))
    near, far = ("dst", "src") if direction == "up" else ("src", "dst")
    border = whole.where(F.col("depth") == max_depth).select(F.col("id").alias(near))
    further = edges.join(border, near, "left_semi").select(F.col(far).alias("id")).join(whole, "id", "left_anti")
    return whole, further.isEmpty()


def include_closure(includes: DataFrame, seeds: DataFrame, cap: int = 5_000, max_depth: int = 64) -> DataFrame:
    """Per seed, files reached by includes in breadth-first order; the cap is the reference semantics' own limit."""
    found = bfs(includes, seeds, "down", max_depth, per_seed=True)
    w = Window.partitionBy("seed").orderBy("depth", "parent", "id")
    return found.withColumn("position", F.row_number().over(w)).where(F.col("position") <= cap).select("seed", "id", "depth", "position")


def ancestors(heritage: DataFrame) -> DataFrame:
    """(child, ancestor, depth): every ancestor with its smallest distance, however far; heritage (child, parent, ..)."""
    rows = hierarchy(heritage).select("child", F.explode(F.arrays_zip(F.col("near").alias("ancestor"), F.col("depth").alias("depth"))).alias("a"))
    own = heritage.where("child = parent").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct()
    return rows.select("child", "a.ancestor", "a.depth").unionByName(own)


def _met(heritage: DataFrame, roots: DataFrame) -> DataFrame:
    """(child, ancestor, depth) for the children in roots (child), level by level, through circles too; nobody is its own ancestor.

    The tables that meet are as large as the closure but are estimated from the files, so none may be sent to all tasks.
    """
    step = heritage.select(F.col("child").alias("mid"), F.col("parent").alias("ancestor")).distinct()
    seen = cut(heritage.where("child <> parent").join(roots, "child", "left_semi").select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    frontier = seen
    for depth in count(2):
        hop = frontier.select("child", F.col("ancestor").alias("mid")).join(step.hint("merge"), "mid").where("child <> ancestor").select("child", "ancestor").distinct()
        frontier = cut(hop.join(seen.select("child", "ancestor").hint("merge"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def hierarchy(heritage: DataFrame, linear: Callable | None = None) -> DataFrame:
    """(child, near, depth, order): all ancestors of each class breadth first (near, with their smallest distances in depth).

    heritage (child, parent, seq or none); parents count in the order of seq, then name. order is what ``linear``, called
    with the parents' names and their own orders, makes of them; null where it gives None, where a parent has none, and on
    or above a circle.

    Classes are done by levels, bases first: the ancestors of a class are merged from those of its parents, which are
    handed to its level's folder as soon as they are known, so each is shuffled once for each class below it and nothing
    is looked up again. Only classes on or above a circle are searched level by level.
    """
    spark = heritage.sparkSession
    seq = F.min("seq") if "seq" in heritage.columns else F.lit(0)
    links = heritage.where("child <> parent").groupBy("child", "parent").agg(seq.alias("seq"))
    levels = topological_levels(heritage.select(F.col("child").alias("src"), F.col("parent").alias("dst")))
    own = levels.withColumnRenamed("id", "child")
    above = levels.withColumnsRenamed({"id": "parent", "level": "from"})
    links = cut(links.join(own.hint("merge"), "child").join(above.hint("merge"), "parent"))
    self_made = cut(heritage.where("child = parent").select("child").distinct().withColumn("own", F.lit(True)))
    unordered = not self_made.isEmpty()
    shape = "near array<string>, depth array<int>, order array<string>"

    @F.arrow_udf(f"struct<{shape}>")
    def merged(children: pa.Array, parents: pa.Array) -> pa.Array:
        # lists as flat values and offsets: a class has few ancestors, but there are many classes
        each, starts = parents.values, parents.offsets.to_pylist()
        names, seqs = each.field("parent").to_pylist(), each.field("seq").to_pylist()
        flat = {c: (each.field(c).values.to_numpy(zero_copy_only=False).tolist(), each.field(c).offsets.to_pylist()) for c in ("near", "depth", "order")}
        known = each.field("order").is_valid().to_pylist()
        part = lambda c, i: flat[c][0][flat[c][1][i] : flat[c][1][i + 1]]
        near, depth, order = [], [], []
        for child, first, last in zip(children.to_pylist(), starts, starts[1:]):
            rows = sorted(range(first, last), key=lambda i: (seqs[i], names[i]))
            pairs = [(0, names[i]) for i in rows]
            for i in rows:
                pairs.extend(zip(part("depth", i), part("near", i)))
            pairs.sort(key=itemgetter(0))  # stable: of equal distances the earlier parent's come first
            met: dict[str, int] = {}
            for d, a in pairs:
                if a not in met:
                    met[a] = d + 1
            met.pop(child, None)
            near.append(list(met))
            depth.append(list(met.values()))
            order.append(linear([names[i] for i in rows], [part("order", i) for i in rows]) if linear and all(known[i] for i in rows) else None)
        return pa.StructArray.from_arrays([pa.array(near, pa.list_(pa.string())), pa.array(depth, pa.list_(pa.int32())), pa.array(order, pa.list_(pa.string()))], ["near", "depth", "order"])

    top = links.agg(F.max("level").alias("top")).first()["top"]
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/hierarchy-{uuid.uuid4().hex}"
    none = F.array().cast("array<string>")
    done = above.where("from = 0").select(F.col("parent").alias("child"), none.alias("near"), F.array().cast("array<int>").alias("depth"), none.alias("order"))
    if unordered:
        done = done.join(self_made, "child", "left").withColumn("order", F.when(F.col("own").isNull(), F.col("order"))).drop("own")
    for level in range(1, (top or 0) + 1):
        near = links.where((F.col("from") == level - 1) & (F.col("level") > 0))
        handed = near.join(done.withColumnRenamed("child", "parent").hint("merge"), "parent").select("child", "level", "parent", "seq", "near", "depth", "order")
        handed.write.mode("append").partitionBy("level").parquet(f"{path}/handed")
        ready = spark.read.schema(handed.drop("level").schema).parquet(f"{path}/handed/level={level}")
        rows = ready.groupBy("child").agg(F.collect_list(F.struct("parent", "seq", "near", "depth", "order")).alias("parents"))
        done = rows.select("child", merged.asNondeterministic()("child", "parents").alias("m")).select("child", "m.*")
        if unordered:
            done = done.join(self_made, "child", "left").withColumn("order", F.when(F.col("own").isNull(), F.col("order"))).drop("own")
        done.write.parquet(f"{path}/made/at={level}")
        done = spark.read.schema(done.schema).parquet(f"{path}/made/at={level}")
    out = spark.createDataFrame([], f"child string, {shape}") if not top or top < 0 else spark.read.schema(done.schema).parquet(f"{path}/made").drop("at")
    circle = own.where("level = -1").select("child")
    if circle.isEmpty():
        return out
    return out.unionByName(_breadth_first(heritage, circle, shape))


def _breadth_first(heritage: DataFrame, roots: DataFrame, shape: str) -> DataFrame:
    """What hierarchy gives for classes on or above a circle: each one's ancestors' edges are collected and walked."""
    scope = _met(heritage, roots).unionByName(roots.select("child", F.col("child").alias("ancestor"), F.lit(0).alias("depth")))
    seq = F.min("seq") if "seq" in heritage.columns else F.lit(0)
    step = heritage.groupBy(F.col("child").alias("ancestor"), "parent").agg(seq.alias("seq"))
    edges = scope.join(step.hint("merge"), "ancestor").groupBy("child").agg(F.sort_array(F.collect_list(F.struct("ancestor", "seq", "parent"))).alias("edges"))

    @F.arrow_udf("struct<near array<string>, depth array<int>>")
    def walked(children: pa.Array, edges: pa.Array) -> pa.Array:
        out = []
        for child, rows in zip(children.to_pylist(), edges.to_pylist()):
            parents: dict[str, list[str]] = {}
            for r in rows:
                parents.setdefault(r["ancestor"], []).append(r["parent"])
            met, queue = {child: 0}, deque([child])
            while queue:
                x = queue.popleft()
                for y in parents.get(x, []):
                    if y not in met:
                        met[y] = met[x] + 1
                        queue.append(y)
            del met[child]
            out.append({"near": list(met), "depth": list(met.values())})
        return pa.array(out, pa.struct([("near", pa.list_(pa.string())), ("depth", pa.list_(pa.int32()))]))

    return edges.select("child", walked.asNondeterministic()("child", "edges").alias("m")).select("child", "m.near", "m.depth", F.lit(None).cast("array<string>").alias("order"))


def topological_levels(edges: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(id, level): level 0 has no outgoing edge, each next level only points to lower ones; cycles get level -1.

    edges: src depends on dst. Nodes on or above a cycle can't be ordered and are reported last.
    More than max_levels levels, if it is given, are an error.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    levels = None
    for level in count():
        blocked = left.select(F.col("src").alias("id")).distinct()
        ready = cut(nodes.join(blocked.hint("merge"), "id", "left_anti"))
        if ready.isEmpty():
            break
        if level == max_levels:
            raise RuntimeError(f"more than {max_levels} levels")
        part = ready.withColumn("level", F.lit(level))
        levels = part if levels is None else levels.unionByName(part)
        if level % MAX_PARTS == MAX_PARTS - 1:
            levels = cut(levels)
        nodes = cut(nodes.join(ready.hint("merge"), "id", "left_anti"))
        left = cut(left.join(ready.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst"))
    rest = nodes.withColumn("level", F.lit(-1))
    return rest if levels is None else levels.unionByName(rest)


def adjacency(calls: DataFrame, branching: int, order: list | None = None) -> DataFrame:
    """(src, dst, branch): the first callees of each node, in a stated order (insertion order has no meaning here)."""
    w = Window.partitionBy("src").orderBy(*(order or ["dst"]))
    return calls.select("src", "dst", *[c for c in calls.columns if c not in ("src", "dst")]).withColumn("branch", F.row_number().over(w)).where(F.col("branch") <= branching).select("src", "dst", "branch")


def traces(calls: DataFrame, entries: DataFrame, max_depth: int = 10, branching: int = 4, per_entry: int = 12, min_steps: int = 3, order: list | None = None) -> DataFrame:
    """(entry, path, rank): paths from each entry that end in a leaf, at the depth limit, or where only cycles are left.

    Queue order is (length, branch numbers along the path); the first per_entry finished paths of an entry count,
    of which those shorter than min_steps are dropped. All per_entry work is a window per entry.
    """
    near = adjacency(calls, branching, order)
    has_out = calls.select(F.col("src").alias("tip")).distinct().withColumn("__out", F.lit(True))
    alive = entries.select(F.col("id").alias("entry"), F.array("id").alias("path"), F.array().cast("array<int>").alias("order"), F.col("id").alias("tip"))
    done = None

    def finish(part: DataFrame) -> None:
        nonlocal done
        part = part.select("entry", "path", "order")
        done = part if done is None else done.unionByName(part)

    for length in range(1, max_depth + 1):
        marked = alive.join(has_out, "tip", "left")
        if length == max_depth:
            finish(marked)
            break
        finish(marked.where("__out IS NULL"))
        open_paths = marked.where("__out")
        grown = open_paths.join(near.withColumnRenamed("src", "tip"), "tip").where(~F.array_contains("path", F.col("dst")))
        # an array comparison in the anti join keeps the paths all of whose branches close a cycle
        finish(open_paths.join(grown.select("entry", "path").distinct(), ["entry", "path"], "left_anti"))
        alive = cut(grown.select("entry", F.concat("path", F.array("dst")).alias("path"), F.concat("order", F.array("branch")).alias("order"), F.col("dst").alias("tip")))
        if alive.isEmpty():
            break
    # finished paths only count for the cap if they are long enough, as the queue never keeps shorter ones
    kept = done.where(F.size("path") >= min_steps)
    w = Window.partitionBy("entry").orderBy(F.size("path"), "order", "path")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_entry).select("entry", "path", "rank")


def drop_contained(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths that are no contiguous part of a longer one.

    Every path is exploded into its proper parts (traces are short), and a path equal to some part goes: an equi join
    on whole paths, so a node that all paths share is no hot key.
    """
    keyed = paths.select(F.col(path).alias("p")).distinct()
    n = F.size("p")
    cuts = F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda at: F.slice("p", at, size))))
    parts = keyed.where(n > 1).select(F.explode(cuts).alias("p")).distinct()
    return keyed.join(parts, "p", "left_anti").select(F.col("p").alias(path))


def longest_per_ends(paths: DataFrame, path: str = "path") -> DataFrame:
    """The longest path of each (first, last) pair; ties to the smaller path."""
    ends = paths.withColumn("__a", F.col(path)[0]).withColumn("__b", F.element_at(path, -1))
    w = Window.partitionBy("__a", "__b").orderBy(F.desc(F.size(path)), path)
    return ends.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__a", "__b", "__n")


def _lists(edges: DataFrame, near: str, far: str, wide: int = 1_000) -> DataFrame:
    """(id, next): what follows each node, in lists of up to ``wide``."""
    piece = F.floor((F.row_number().over(Window.partitionBy(near).orderBy(far)) - 1) / wide)
    return edges.withColumn("piece", piece).groupBy(F.col(near).alias("id"), "piece").agg(F.collect_list(far).alias("next")).select("id", "next")


def _reached(lists: DataFrame, root: DataFrame) -> DataFrame:
    """(id): the root and all that lists (id, next) lead to. Only a node reached for the first time sends its lists on."""
    hit = frontier = cut(root)
    while True:
        near = lists.join(frontier, "id").select(F.explode("next").alias("id")).distinct()
        frontier = cut(near.join(hit, "id", "left_anti"))
        if frontier.isEmpty():
            return hit
        hit = cut(hit.unionByName(frontier))


def strongly_connected(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, scc): scc is the smallest id of the component. Forward-backward colouring in rounds.

    The first round takes the component of the node with the most pairs of edges in and out, which is the giant one if
    there is one: what it reaches and what reaches it, each edge followed once. Each further round spreads the largest id forward until it is stable; the nodes that reach their colour's root backwards
    form its component and leave the graph. Before each round nodes without edges in or out, components of their own,
    are taken off until there are none. More than max_rounds rounds of colouring, if it is given, are an error.
    """
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct())
    out, parts = None, 0

    def add(part: DataFrame) -> None:
        nonlocal out, parts
        out, parts = part if out is None else out.unionByName(part), parts + 1
        if parts % MAX_PARTS == 0:
            out = cut(out)

    outward, inward = cut(_lists(left, "src", "dst")), cut(_lists(left, "dst", "src"))
    degree = lambda lists, name: lists.groupBy("id").agg(F.sum(F.size("next")).alias(name))
    root = degree(outward, "o").join(degree(inward, "i"), "id").orderBy(F.desc(F.col("o") * F.col("i")), "id").select("id").limit(1)
    giant = cut(_reached(outward, root).join(_reached(inward, root), "id", "left_semi"))
    if not giant.isEmpty():
        add(giant.crossJoin(F.broadcast(giant.agg(F.min("id").alias("scc")))))
        nodes = cut(nodes.join(giant, "id", "left_anti"))
        left = cut(left.join(giant.withColumnRenamed("id", "src"), "src", "left_anti").join(giant.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))

    for number in count(1):
        while True:
            inner = left.select(F.col("src").alias("id")).intersect(left.select(F.col("dst").alias("id")))
            alone = cut(nodes.join(inner, "id", "left_anti"))
            if alone.isEmpty():
                break
            add(alone.withColumn("scc", F.col("id")))
            nodes = cut(nodes.join(alone, "id", "left_anti"))
            left = cut(left.join(alone.withColumnRenamed("id", "src"), "src", "left_anti").join(alone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
        if nodes.isEmpty():
            break
        if number == max_rounds:
            raise RuntimeError(f"components left after {max_rounds} rounds")
        colour = cut(nodes.withColumn("c", F.col("id")))
        while True:
            pushed = left.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("in_c"))
            new = cut(colour.join(pushed, "id", "left").select("id", F.greatest("c", F.coalesce("in_c", "c")).alias("c"), (F.coalesce("in_c", "c") > F.col("c")).alias("moved")))
            moved = not new.where("moved").isEmpty()
            colour = new.select("id", "c")
            if not moved:
                break
        same = left.join(colour.select(F.col("id").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("b")), "dst").where("a = b").select("src", "dst")
        roots = colour.where("id = c")
        hit = roots
        frontier = roots
        while True:
            back = same.join(frontier.select(F.col("id").alias("dst"), "c"), "dst").select(F.col("src").alias("id"), "c").distinct()
            frontier = cut(back.join(hit, ["id", "c"], "left_anti"))
            if frontier.isEmpty():
                break
            hit = cut(hit.unionByName(frontier))
        add(hit.join(hit.groupBy("c").agg(F.min("id").alias("scc")), "c").select("id", "scc"))
        nodes = cut(nodes.join(hit.select("id"), "id", "left_anti"))
        gone = hit.select("id")
        left = cut(left.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"))
    return out if out is not None else nodes.withColumn("scc", F.col("id"))


def depth_buckets(found: DataFrame) -> DataFrame:
    """(depth, n, ids): what a search found, by depth."""
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))


def min_depth(found: DataFrame, by: list[str]) -> DataFrame:
    return found.groupBy(*by).agg(F.min("depth").alias("depth"))


