"""Sharding by histogram sort: shards of near-equal bytes, in one global order, with a single exchange.

Rows are ordered by (hash of the text, doc_id), so equal texts lie side by side. Splitters between the shards
are found without sorting: every round counts, in each partition, the exact bytes below some candidate keys, sums
the counts (a few hundred numbers) and moves the probes between the nearest keys on either side of each target.
A splitter is settled when the bytes below it are within the tolerance. Where even neighbouring text hashes are
further apart than that (a large group of equal texts), the search goes on inside the group, over doc_id. Then
the rows are exchanged once, to their place in the order.

Each shard is cut by further splitters, found in the same rounds, into pieces of at most PIECE_BYTES of text.
The rows below each piece are counted exactly, so a row's slot is the piece's offset plus its place in the piece
and no task ever holds a whole shard.

Law ``bytes``: a shard's size differs from the mean by at most twice the tolerance, or by one key's rows if that
is more. Size of a row: UTF-8 bytes of the text (null: none) plus 8, whole however long the text. A null text counts as
hash 0, a null doc_id sorts first; rows equal in both are one key, in any order. An empty table gives no rows. Columns
that clash with an output column are replaced; others are kept whatever they are called. A search that isn't settled
after max_rounds is an error. Beyond MAX_PIECES * PIECE_BYTES, 1.5 TB, pieces grow in proportion: at 100 TB 2 GB of text,
of which a task sorts only the columns asked for.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .textops import fresh

#: Share of a shard's mean size by which a splitter may miss its target.
TOLERANCE = 0.0005
#: Candidate keys counted for each open splitter in a round.
PROBES = 32
PIECE_BYTES = 32 << 20
#: Pieces at most, so that the splitters that go to all tasks stay small.
MAX_PIECES = 48_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def _place(main: np.ndarray, minor: np.ndarray, keys: list[tuple[int, int]]) -> np.ndarray:
    """How many of the sorted keys are <= (main, minor), for each row."""
    heads, tails = (np.array([k[i] for k in keys], np.int64) for i in (0, 1))
    out, right = np.searchsorted(heads, main, "left"), np.searchsorted(heads, main, "right")
    tied = np.flatnonzero(out < right)
    for head in np.unique(main[tied]):
        rows = tied[main[tied] == head]
        lo, hi = out[rows[0]], right[rows[0]]
        out[rows] = lo + np.searchsorted(tails[lo:hi], minor[rows], "right")
    return out


def _histogram(keys: list[tuple[int, int]]):
    def run(batches):
        totals = np.zeros((3, len(keys) + 1), np.int64)
        for batch in batches:
            main, minor, size = (np.asarray(c) for c in batch.columns)
            at = _place(main, minor, keys)
            totals[0] += np.bincount(at, size, len(keys) + 1).astype(np.int64)
            totals[1] += np.bincount(at, minlength=len(keys) + 1)
        used = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(totals[0][used]), pa.array(totals[1][used])], ["bucket", "bytes", "rows"])

    return run


def below(narrow: DataFrame, keys: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows strictly below each of the sorted keys."""
    rows = narrow.mapInArrow(_histogram(keys), "bucket bigint, bytes bigint, rows bigint").groupBy("bucket").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r")).collect()
    size, count = np.zeros(len(keys) + 1, np.int64), np.zeros(len(keys) + 1, np.int64)
    for row in rows:
        size[row["bucket"]], count[row["bucket"]] = row["b"], row["r"]
    return np.cumsum(size)[:-1].tolist(), np.cumsum(count)[:-1].tolist()


class _Splitter:
    """Search for one key with about ``target`` bytes below it, between a key with less and a key with more."""

    def __init__(self, target: float, tolerance: float, total: int):
        self.target, self.tolerance = target, tolerance
        self.low, self.high = (_LOW, _LOW), (_HIGH, _HIGH)
        self.best, self.error = ((_LOW, _LOW), abs(target)) if abs(target) <= abs(total - target) else ((_HIGH, _HIGH), abs(total - target))
        self.done = total == 0

    def probes(self, n: int) -> list[tuple[int, int]]:
        """Keys strictly inside the bracket: over the hash while that can be divided, then over doc_id."""
        (a, x), (b, y) = self.low, self.high
        if b - a > 1:
            keys = {(a + (b - a) * k // (n + 1), _LOW) for k in range(1, n + 1)}
        else:
            top = y if a == b else _HIGH
            keys = {(a, x + (top - x) * k // (n + 1)) for k in range(1, n + 1)} | ({(b, _LOW)} if a < b else set())
        return sorted(k for k in keys if self.low < k < self.high)

    def take(self, key: tuple[int, int], size: int) -> None:
        if abs(size - self.target) < self.error:
            self.best, self.error = key, abs(size - self.target)
        if size <= self.target:
            self.low = max(self.low, key)
        else:
            self.high = min(self.high, key)

    def settle(self) -> None:
        self.done = self.error <= self.tolerance or not self.probes(1)


def find_splitters(narrow: DataFrame, targets: list[tuple[float, float]], total: int, probes: int = PROBES, max_rounds: int = 160) -> list[tuple[int, int]]:
    """Keys whose bytes below are within each target's tolerance, or as near as keys allow.

    One probe a splitter and round halves its bracket, so 128 rounds always do; more probes need about 26.
    """
    splitters = [_Splitter(t, tolerance, total) for t, tolerance in targets]
    for _ in range(max_rounds):
        still = [s for s in splitters if not s.done]
        if not still:
            return [s.best for s in splitters]
        each = max(1, min(probes, 32_768 // len(still)))
        keys = sorted({k for s in still for k in s.probes(each)})
        sizes, _ = below(narrow, keys)
        for s in still:
            for i in range(bisect_right(keys, s.low), bisect_left(keys, s.high)):
                s.take(keys[i], sizes[i])
            s.settle()
    raise RuntimeError(f"splitters not settled after {max_rounds} rounds")


def _bucket_udf(keys: list[tuple[int, int]]):
    @F.arrow_udf(T.IntegerType())
    def run(main: pa.Array, minor: pa.Array) -> pa.Array:
        return pa.array(_place(np.asarray(main), np.asarray(minor), keys).astype(np.int32))

    return run


def shard_by_bytes(df: DataFrame, n_shards: int, doc_id: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """df with size, text_crc32, shard and slot, laid out in shard order by one exchange.

    Only the columns asked for later travel in the exchange: Spark prunes the others, the text included.
    """
    outputs = ("size", "text_crc32", "shard", "slot")
    held = [c for c in df.columns if c not in outputs]
    main, minor, piece, rank, base = (fresh(c, df) for c in ("key_main", "key_minor", "piece", "piece_rank", "piece_base"))
    raw = F.col(text).cast("binary")
    keyed = df.select(
        *held,
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
        F.when(raw.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(raw)).alias(main),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LOW)).alias(minor),
    )
    narrow = stored(keyed.select(main, minor, "size"), "shard-keys")
    total, n_rows = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    cuts = max(1, min(MAX_PIECES // n_shards, -(-total // (n_shards * piece_bytes))))
    mean = total / (n_shards * cuts)
    targets = [(mean * k, (tolerance if k % cuts == 0 else 0.1) * mean * (cuts if k % cuts == 0 else 1)) for k in range(1, n_shards * cuts)]
    keys = sorted(find_splitters(narrow, targets, total)) if n_rows else []
    offsets = [0, *below(narrow, keys)[1]] if keys else [0]
    bases = [offsets[p] - offsets[p - p % cuts] for p in range(len(keys) + 1)]
    placed = keyed.withColumn(piece, _bucket_udf(keys)(F.col(main), F.col(minor)) if keys else F.lit(0))
    placed = placed.withColumn(rank, F.row_number().over(Window.partitionBy(piece).orderBy(main, minor)))
    if len(bases) <= 256:
        placed = placed.withColumn(base, F.element_at(F.array(*[F.lit(int(b)).cast("long") for b in bases]), F.col(piece) + 1))
    else:
        table = df.sparkSession.createDataFrame([(i, int(b)) for i, b in enumerate(bases)], f"{piece} int, {base} long")
        placed = placed.join(F.broadcast(table), piece)  # at most MAX_PIECES rows
    return placed.select(*held, "size", "text_crc32", F.floor(F.col(piece) / cuts).cast("int").alias("shard"), (F.col(base) + F.col(rank) - 1).alias("slot"))
