"""Conversation prefix trie, built level by level.

A node of depth d is a distinct sequence of d turns (role and text); its members are the conversations that start with
it. Construction is level-synchronous: at each depth the live conversations are grouped by (parent node, next turn),
and the smallest conv_id of a group names the node. A node whose members all go on alike (one conversation, or exact
copies) is a path: its conversations leave the loop and the nodes below it are made in bulk, so the number of levels is
the depth to which different conversations agree, not their length. Reverse level-by-level joins of children on their
parents then roll up leaves and savings.

Hot groups: groups are pre-aggregated before they are shuffled. The join that brings a node back to its conversations
moves about 100 bytes for each; the rows of a first turn that a third of all conversations share meet in one of its tasks
(as a sorted stream against a single row, nothing is held), since no exchange stands between the aggregate and the join
where the adaptive skew join could split them; storing the groups first splits them, but takes too many small jobs. Turn positions and sums
of bytes are taken in two steps, inside range buckets and over the buckets' sums, so no conversation is one task.
``ends_sha256`` is a stream of the members' ids in order: SHA-256 can't be computed in parts, so the ids (8 bytes each)
of copies that end at one node meet in one task, never in memory.

Turns are compared by 128 bits of MD5, whole conversations by two 64-bit sums (exclusive or) of their turns in place, besides their lengths.

Defined results: turns are ordered by turn (null first), ties by the MD5 of role and text; a null role or text is empty;
repeated rows are turns of their own. Rows without a conv_id belong to no conversation and take no part. Texts of any
length count whole. Without conversations there are no nodes. Other columns are never read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, stored
from .textops import batched, rows_of

#: Turns that the query's rebuilt conversations may take from another conversation.
MOST_SHARED = 8


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, said, bytes, sums of bytes up to here) of conversations (conv_id, turn, role, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("bytes"))
    order = ["conv_id", "turn", "said", "copy"]
    dealt = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("bucket", F.spark_partition_id())
    inside = Window.partitionBy("conv_id", "bucket").orderBy("turn", "said", "copy").rowsBetween(Window.unboundedPreceding, 0)
    said_in = stored(dealt.withColumn("place", F.count(F.lit(1)).over(inside)).withColumn("sum", F.sum("bytes").over(inside)).drop("turn", "copy"), "trie-turns")
    cells = said_in.groupBy("conv_id", "bucket").agg(F.max("place").alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select("conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    return said_in.join(bases, ["conv_id", "bucket"]).select("conv_id", (F.col("n0") + F.col("place")).alias("pos"), "said", "bytes", (F.col("b0") + F.col("sum")).alias("upto"))


def rebuilt(placed: DataFrame, ids: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """Turns of conversations whose openings come from another conversation, with the same columns as ``placed``.

    ids: (conv_id, source, h). A conversation gets the first h turns of source (h at most ``most``), then its own
    turns behind its first h.
    """
    openings = placed.where(F.col("pos") <= most).select(F.col("conv_id").alias("source"), "pos", "said", "bytes", "upto")
    taken = ids.join(openings, "source").where("pos <= h")
    head = taken.groupBy("conv_id").agg(F.count(F.lit(1)).alias("head"), F.sum("bytes").alias("head_bytes"))
    skipped = placed.where(F.col("pos") <= most).select(F.col("conv_id").alias("c"), F.col("pos").alias("h"), F.col("upto").alias("skipped"))
    facts = ids.join(head, "conv_id", "left").join(skipped, (F.col("conv_id") == F.col("c")) & (skipped["h"] == ids["h"]), "left")
    facts = facts.select("conv_id", ids["h"].alias("h"), *[F.coalesce(x, F.lit(0)).alias(x) for x in ("head", "head_bytes", "skipped")])
    # the facts of a conversation go to each bucket of its positions, so its turns are not joined in one task
    spot = F.floor(F.col("pos") / F.lit(10_000))
    own = placed.withColumn("spot", spot)
    spots = own.groupBy("conv_id", "spot").agg(F.max("pos").alias("last"))
    tail = own.join(spots.join(facts, "conv_id"), ["conv_id", "spot"]).where("pos > h")
    tail = tail.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "said", "bytes", (F.col("upto") - F.col("skipped") + F.col("head_bytes")).alias("upto"))
    return taken.select("conv_id", "pos", "said", "bytes", "upto").unionByName(tail)


def _grouped(rows: DataFrame) -> DataFrame:
    """Each group (parent, said) gives its rows their node: smallest conv_id, members, and whether all members are the same.

    The groups are added up before they are shuffled, and are the small side of the join back.
    """
    groups = rows.groupBy(F.col("parent").alias("p"), F.col("said").alias("s")).agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), (F.min("whole") == F.max("whole")).alias("path"))
    return rows.join(groups, (F.col("parent") == F.col("p")) & (F.col("said") == F.col("s"))).drop("p", "s", "said")


def _digests(batches):
    """One row for each node (depth, node) with the SHA-256 of its members' ids, which come in order."""

    def rows():
        last, digest = None, None
        for depth, node, conv in rows_of(batches):
            if (depth, node) != last:
                if digest is not None:
                    yield (*last, digest.hexdigest())
                last, digest = (depth, node), hashlib.sha256()
                digest.update(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if digest is not None:
            yield (*last, digest.hexdigest())

    return batched(rows(), pa.schema([("depth", pa.int64()), ("conv_id", pa.int64()), ("sha", pa.string())]))


def trie(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of all conversations (``ids``: conv_id) whose turns are (conv_id, pos, said, bytes, upto).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over the
    subtree, each node's members less one times the bytes of its last text), ends_sha256 (of the members that end here).
    """
    placed = stored(placed.repartitionByRange("pos", "conv_id"), "trie-rebuilt")
    sums = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"), F.max("upto").alias("total"), F.bit_xor(F.xxhash64("pos", "said")).alias("x"), F.bit_xor(F.xxhash64("said", "pos")).alias("y"))
    all_of = ids.select("conv_id").join(sums, "conv_id", "left")
    convs = all_of.select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("total", F.lit(0)).alias("total"), F.struct(F.coalesce("len", F.lit(0)), F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))).alias("whole"))
    state = ["conv_id", "len", "total", "whole"]
    live = cut(_grouped(convs.withColumn("parent", F.lit(0).cast("long")).withColumn("said", F.lit(b"")).withColumn("bytes", F.lit(0).cast("long")).withColumn("upto", F.lit(0).cast("long"))))
    levels, left, ends, depth = [], [], [], 0
    while not live.isEmpty():
        at = F.lit(depth).cast("long")
        # a node's smallest member stands for it
        levels.append(live.where("conv_id = node").select("node", "parent", "n", "path", "bytes", "upto", "len", "total").withColumn("depth", at))
        left.append(levels[-1].where(F.col("path") & (F.col("len") > at)).select(F.col("node").alias("conv_id"), at.alias("d"), "n", "len", "total"))
        ends.append(live.where(F.col("path") | (F.col("len") == at)).select(F.col("len").alias("depth"), "node", "conv_id"))
        next_turn = placed.where(F.col("pos") == depth + 1).select("conv_id", "said", "bytes", "upto")
        going = live.where(~F.col("path") & (F.col("len") > at)).select(*state, F.col("node").alias("parent")).join(next_turn, "conv_id")
        live = cut(_grouped(going))
        depth += 1
    if not levels:
        return _result(placed.sparkSession)
    return _rolled_up(placed, levels, _union(left), _union(ends))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _result(spark) -> DataFrame:
    return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def _rolled_up(placed: DataFrame, levels: list[DataFrame], paths: DataFrame, ends: DataFrame) -> DataFrame:
    copies = F.col("n") - 1
    done, below = [], None
    for nodes in reversed(levels):
        # a path's subtree is known: one leaf, and its members less one times all bytes from its own last text on
        known = nodes.withColumn("path_saved", copies * (F.col("total") - F.col("upto") + F.col("bytes")))
        if below is None:
            up = known.withColumn("c", F.lit(0).cast("long")).withColumn("l", F.lit(0).cast("long")).withColumn("s", F.lit(0).cast("long"))
        else:
            rolled = below.groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("c"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
            up = known.join(rolled, F.col("node") == F.col("p"), "left").drop("p")
        below = cut(
            up.select(
                "node", "parent", "depth", "n",
                F.when(F.col("path"), (F.col("len") > F.col("depth")).cast("long")).otherwise(F.coalesce("c", F.lit(0))).alias("children"),
                F.when(F.col("path"), F.lit(1)).otherwise(F.coalesce("l", F.lit(0))).cast("long").alias("leaves"),
                F.when(F.col("path"), F.col("path_saved")).otherwise(copies * F.col("bytes") + F.coalesce("s", F.lit(0))).alias("saved"),
            )
        )
        done.append(below)
    branching = _union(done).select(F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    # the nodes below the last branching: one for each further turn of a path's first member, joined by stretches of it
    spotted = placed.withColumn("spot", F.floor(F.col("pos") / F.lit(10_000)))
    spots = spotted.groupBy("conv_id", "spot").agg(F.max("pos").alias("last"))
    tail = spotted.join(spots.join(paths, "conv_id").where("last > d"), ["conv_id", "spot"]).where("pos > d")
    bulk = tail.select(
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"), (F.col("pos") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), (copies * (F.col("total") - F.col("upto") + F.col("bytes"))).alias("saved_tokens"),
    )
    shas = ends.repartition("depth", "node").sortWithinPartitions("depth", "node", "conv_id").mapInArrow(_digests, "depth long, conv_id long, sha string")
    whole = branching.unionByName(bulk).join(shas, ["depth", "conv_id"], "left")
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def build(df: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    return trie(turns(df), df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct())


def build_rebuilt(df: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations: conversation c opens with the first h turns of c - c % 5, h = crc32(c) % 9."""
    ids = df.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    ids = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("source"), (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).alias("h"))
    return trie(rebuilt(turns(df), ids), ids)
