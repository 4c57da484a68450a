"""Chat formatting: a dialogue seen by each of its participants.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others
as named users. The result is one row per perspective and message: the rendered piece, where it stands in the
rendered dialogue, and the part of it that counts for the loss (the assistant's words and the closing mark).
Concatenating the pieces of a perspective in order gives the training text; no row grows with the dialogue.

Messages are ordered by turn (null first), then speaker, then text. Exact repeats of a message (same conversation,
turn, speaker and text) are one message with a count. Messages of a context role (system) stay context in every
perspective. A null speaker is called ``unknown``, a null text is empty; a null conversation is a conversation.
Texts of any length are rendered whole. A text or name can't forge a turn: MARK in either gets a blank behind its first
character, and line ends in names become blanks. An empty table gives no rows; other columns are never read.

Offsets are prefix sums in two steps: the messages are sorted once by range, each range being a bucket, and summed
within buckets and over the buckets' sums. So a conversation that holds a third of all rows is spread over many tasks,
even if all its turns are null or equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

CONTEXT_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What the marks of a turn begin with.
MARK = "<|im_"


def _speaker_head(own: Column, speaker: Column, context: Column) -> Column:
    """The first line of a message: its role and, for others, the name."""
    return F.when(context, F.lit(f"{OPEN}system\n")).when(own, F.lit(f"{OPEN}assistant\n")).otherwise(F.concat(F.lit(f"{OPEN}user name="), speaker, F.lit("\n")))


def _safe(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(f"{MARK[0]} {MARK[1:]}"))


def messages(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """(conv_id, turn, speaker, text, copies, context): distinct messages."""
    named = df.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        _safe(F.translate(F.coalesce(F.col(role).cast("string"), F.lit("unknown")), "\r\n", "  ")).alias("speaker"),
        _safe(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )
    distinct = named.groupBy("conv_id", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.withColumn("context", F.col("speaker").isin(*context_roles))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per conversation, perspective and message.

    conv_id, perspective, seq (from 0), turn, speaker, chat_role, rendered, char_start, char_end, loss_start,
    loss_end (equal where nothing counts), copies. Offsets are code points from the start of the dialogue.
    """
    sorted_once = messages(df, conv, turn, role, text, context_roles).repartitionByRange("conv_id", "turn", "speaker", "text")
    said = stored(sorted_once.withColumn("bucket", F.spark_partition_id()), "dialogue-messages")
    as_user = F.length(_speaker_head(F.lit(False), F.col("speaker"), F.col("context"))) + F.length("text") + len(CLOSE)
    as_self = F.length(_speaker_head(F.lit(True), F.col("speaker"), F.col("context"))) + F.length("text") + len(CLOSE)
    # sums of each bucket and speaker; null keys are made joinable
    cells = said.groupBy("conv_id", "bucket", "speaker", "context").agg(F.sum(as_user).alias("user_chars"), F.sum(as_self - as_user).alias("gain"), F.count(F.lit(1)).alias("n"))
    people = cells.where(~F.col("context")).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    whole = cells.groupBy("conv_id", "bucket").agg(F.sum("user_chars").alias("user_chars"), F.sum("n").alias("n"))
    own = cells.where(~F.col("context")).select(F.col("conv_id").alias("c"), F.col("bucket").alias("b"), F.col("speaker").alias("p"), "gain")
    spread = whole.alias("w").join(people.alias("q"), F.col("w.conv_id").eqNullSafe(F.col("q.conv_id"))).select("w.conv_id", "w.bucket", "q.perspective", "w.user_chars", "w.n")
    lengths = spread.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("bucket").eqNullSafe(F.col("b")) & (F.col("perspective") == F.col("p")), "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = lengths.select(
        "conv_id",
        "bucket",
        "perspective",
        F.coalesce(F.sum(F.col("user_chars") + F.coalesce("gain", F.lit(0))).over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq_base"),
    )
    joined = said.alias("s").join(bases.alias("o"), F.col("s.conv_id").eqNullSafe(F.col("o.conv_id")) & F.col("s.bucket").eqNullSafe(F.col("o.bucket")))
    own_turn = F.col("speaker") == F.col("perspective")
    head = _speaker_head(own_turn, F.col("speaker"), F.col("context"))
    shown = joined.select("s.conv_id", "perspective", "s.bucket", "turn", "speaker", "context", "copies", "text", "base", "seq_base", head.alias("head"))
    shown = shown.withColumn("chars", F.length("head") + F.length("text") + len(CLOSE))
    inside = Window.partitionBy("conv_id", "perspective", "bucket").orderBy("turn", "speaker", "text")
    placed = shown.withColumn("char_end", (F.col("base") + F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0))).cast("long")).withColumn("seq", (F.col("seq_base") + F.row_number().over(inside) - 1).cast("long"))
    start = F.col("char_end") - F.col("chars")
    counts = (F.col("speaker") == F.col("perspective")) & ~F.col("context")
    return placed.select(
        "conv_id",
        "perspective",
        "seq",
        "turn",
        "speaker",
        F.when(F.col("context"), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user").alias("chat_role"),
        F.concat("head", "text", F.lit(CLOSE)).alias("rendered"),
        start.cast("long").alias("char_start"),
        "char_end",
        F.when(counts, start + F.length("head")).otherwise(F.col("char_end")).cast("long").alias("loss_start"),
        F.col("char_end").alias("loss_end"),
        "copies",
    )


def assemble(pieces: DataFrame, max_chars: int) -> DataFrame:
    """(conv_id, perspective, window, text, loss array): training texts of about max_chars, whole messages each.

    A dialogue is cut into windows of max_chars by where its messages start, so a row never grows with it.
    """
    cut = pieces.withColumn("window", F.floor(F.col("char_start") / max_chars))
    rows = cut.groupBy("conv_id", "perspective", "window").agg(F.array_sort(F.collect_list(F.struct("seq", "rendered", "char_start", "loss_start", "loss_end"))).alias("m"))
    first = F.col("m")[0]["char_start"]
    return rows.select(
        "conv_id",
        "perspective",
        "window",
        F.array_join(F.transform("m", lambda x: x["rendered"]), "").alias("text"),
        F.transform(F.filter("m", lambda x: x["loss_start"] < x["loss_end"]), lambda x: F.struct((x["loss_start"] - first).alias("start"), (x["loss_end"] - first).alias("end"))).alias("loss"),
    )
