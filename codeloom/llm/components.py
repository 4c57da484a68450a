"""Connected components over an edge table, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Edges for each file of a checkpoint, about.
EDGES_PER_FILE = 100_000
#: Tasks over which the rows of one key are spread.
SALTS = 32


def with_total(df: DataFrame, key: str, by: Column, each: Column, all_of, name: str, salts: int = SALTS) -> DataFrame:
    """df with a column ``name``: an aggregate over all rows of the same key, without a task that holds one key's rows.

    Rows are dealt by (key, salt of ``by``). ``each`` is the aggregate of a salt's rows, ``all_of`` (a function
    of a column) puts a key's few salts together; the result goes back to the salts. Rows of a null key get null.
    """
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).repartition(key, "__salt")
    cells = dealt.groupBy(key, "__salt").agg(each.alias("__part"))
    whole = cells.withColumn(name, all_of(F.col("__part")).over(Window.partitionBy(key))).select(F.col(key).alias("__key"), F.col("__salt").alias("__cell"), name)
    return dealt.join(whole, (F.col(key) == F.col("__key")) & (F.col("__salt") == F.col("__cell")), "left").drop("__salt", "__key", "__cell")


def with_least(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the smallest value of each key's rows."""
    return with_total(df, key, F.col(value), F.min(value), F.min, name)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the smallest node reachable from node. Input: (a, b), any order, repeats allowed.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each replaces a node's edges by edges to
    its smallest neighbour, so the edge count never grows and every component becomes a star in a number of
    rounds that is logarithmic in its size. The neighbours of a centre are spread over SALTS tasks. Each round is
    checkpointed in the shared folder. Nodes without edges are not returned. Components that aren't finished after
    max_rounds are an error, never a result.
    """
    current = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(current.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # large star: each larger neighbour of u gets an edge to the smallest of u and its neighbours
        near = with_least(both, "u", "v", "m").withColumn("m", F.least("m", "u"))
        large = near.where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: smaller neighbours of u, and u itself, get an edge to the smallest neighbour
        linked = with_least(large, "b", "a", "m")
        small = linked.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        # edges never grow in number, so the last count bounds the next one: few edges don't need many small files
        current = cut(small.coalesce(max(1, -(-before[0] // EDGES_PER_FILE))) if before is not None else small)
        # A star forest is a fixpoint: its fingerprint (a few numbers) no longer changes.
        now = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not finished after {max_rounds} rounds")
    stars = current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp"))
    centres = current.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    return stars.unionByName(centres)
