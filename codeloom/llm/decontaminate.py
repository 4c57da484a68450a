"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items: ten consecutive words, or all words of a shorter item. The
searcher slides a window of the pattern length over a text. The last two words of the window (the block) look up
how far it may move: a block that no pattern holds lets it jump past itself, so most positions are never
examined. Where the shift is 0, the block's bucket lists the patterns that end in it, and a direct comparison of
all words decides. Patterns of different length go to searchers of their own, so that a short item does not
shorten everybody's jumps.

The benchmark's repeats are taken out, and the rest is split into blocks of at most MAX_BLOCK_BYTES of text by sums of
their bytes; an item that is longer than half a block is cut into stretches that overlap by a window less a word, so it
has the same windows. One block is broadcast and searched in the same pass that writes the result. More blocks are taken
one after the other: the texts are written once with a row number, and once more as their words alone, which is all that
the blocks read; each block is broadcast, its hits (rows with hits only) are written, and the broadcast is destroyed
before the next; then the hits are put together by row. So what is alive at once on the driver and in a worker is
bounded however large the benchmark is and however often an item stands in it.

Null, empty and blank texts have no words and no hits; texts of any length are searched whole; items without words have
no windows. An item_id of null counts as the string ``null``; repeated item_ids count once, repeated rows each for
themselves. Empty tables give no rows or no hits. Columns that clash with an output column are replaced by ``report``;
others are kept whatever they are called.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .textops import alnum_words, fresh

WINDOW = 10
#: UTF-8 bytes of item texts that one broadcast holds at most.
MAX_BLOCK_BYTES = 16 << 20


def windows(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    """All windows of an item; one shorter window for a short item; none without words."""
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class WuManber:
    """Search for equally long word patterns."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.length = length = len(next(iter(patterns)))
        self.block = block = min(2, length)
        self.far = length - block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for pattern, items in patterns.items():
            for end in range(block, length + 1):
                key = pattern[end - 1] if block == 1 else (pattern[end - 2], pattern[end - 1])
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets[pattern[-1] if block == 1 else pattern[-2:]][pattern] = items

    def find(self, words: list[bytes]):
        """(start, items) of every occurrence."""
        end, last, length, far, shift = self.length - 1, len(words), self.length, self.far, self.shift.get
        single = self.block == 1
        while end < last:
            key = words[end] if single else (words[end - 1], words[end])
            jump = shift(key, far)
            if jump:
                end += jump
                continue
            items = self.buckets[key].get(tuple(words[end - length + 1 : end + 1])) if key in self.buckets else None
            if items:
                yield end - length + 1, items
            end += 1


class Searcher:
    """Wu-Manber searchers, one for each pattern length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for item, raw in items:
            for pattern in dict.fromkeys(windows(alnum_words(raw), width)):
                by_length[len(pattern)][pattern].append(item)
        self.parts = [WuManber(patterns) for patterns in by_length.values()]

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """Starts and ends (exclusive) of hit stretches, merged, and the items found."""
        spans, found = [], set()
        for part in self.parts:
            for start, items in part.find(words):
                spans.append((start, start + part.length))
                found.update(items)
        return *merge(spans), found


def merge(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _stretches(width: int, max_bytes: int):
    """Rows (item, text): long texts cut into stretches of words that overlap by width - 1 words."""

    def run(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                raw = text.as_py()
                if len(raw) <= max_bytes:
                    items.append(item)
                    texts.append(raw)
                    continue
                words, at = alnum_words(raw), 0
                while at < len(words):
                    end, size = at, 0
                    while end < len(words) and (size < max_bytes or end - at < width):
                        size += len(words[end]) + 1
                        end += 1
                    items.append(item)
                    texts.append(b" ".join(words[at:end]))
                    if end == len(words):
                        break
                    at = end - width + 1
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())], ["item", "text"])

    return run


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", max_bytes: int = MAX_BLOCK_BYTES, width: int = WINDOW) -> list[DataFrame]:
    """The benchmark's distinct items in blocks whose texts hold at most max_bytes each.

    Items are summed up inside buckets of a hash and over the buckets' sums, so no task holds all items; a block ends
    where the sum passes the next half of max_bytes, and no stretch is longer than the other half.
    """
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("string").alias("text")).where(F.col(text).isNotNull()).distinct()
    total, longest = rows.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (total or 0) <= max_bytes:
        return [rows]
    half = max(1, max_bytes // 2)
    if longest > half:
        # a stretch ends behind the word that fills it; a window of width words may be longer than half a block
        rows = rows.mapInArrow(_stretches(width, max(1, half // 2)), "item string, text string").distinct()
    sized = rows.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(-(-2 * total // max_bytes)))).withColumn("size", F.octet_length("text").cast("long"))
    inside = Window.partitionBy("bucket").orderBy("item", F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, 0)
    sums = sized.groupBy("bucket").agg(F.sum("size").alias("whole"))
    before = sums.select("bucket", (F.sum("whole").over(Window.orderBy("bucket")) - F.col("whole")).alias("before"))  # a row for each half block
    placed = stored(sized.withColumn("upto", F.sum("size").over(inside)).join(before, "bucket").select("item", "text", F.floor((F.col("before") + F.col("upto") - F.col("size")) / half).alias("block")), "benchmark-blocks")
    return [placed.where(F.col("block") == r["block"]).select("item", "text") for r in placed.select("block").distinct().orderBy("block").collect()]


_SEARCHERS: dict[str, Searcher] = {}

_HITS = "struct<n_words:bigint,starts:array<int>,ends:array<int>,items:array<string>>"


def _marker(shared, width: int):
    """A UDF text -> hits for one broadcast block of items."""
    key = uuid.uuid4().hex

    @F.arrow_udf(_HITS)
    def run(texts: pa.Array) -> pa.Array:
        if key not in _SEARCHERS:
            _SEARCHERS.clear()
            _SEARCHERS[key] = Searcher(shared.value, width)
        searcher, out = _SEARCHERS[key], []
        for value in texts.cast(pa.large_binary()):
            words = alnum_words(value.as_py())
            starts, ends, items = searcher.scan(words)
            out.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(items)})
        return pa.array(out, _ARROW)

    return run.asNondeterministic()


def _spelled():
    """A UDF text -> its words with a blank between; searching these finds the same words."""

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([b" ".join(alnum_words(t.as_py())) for t in texts.cast(pa.large_binary())], pa.binary())

    return run.asNondeterministic()


def _broadcast(df: DataFrame, block: DataFrame):
    """The items of one block; a bound on them is the block's."""
    return df.sparkSession.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in block.toLocalIterator()])


def mark(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW, max_bytes: int = MAX_BLOCK_BYTES, name: str = "hits") -> DataFrame:
    """df with a column ``name``: struct(n_words, starts, ends, items), word positions of the hit stretches.

    With a benchmark of one block no row of df is shuffled; with more, df is written once and joined with its hits.
    """
    blocks = item_blocks(benchmark, item, item_text, max_bytes, width)
    if len(blocks) == 1:
        return df.withColumn(name, _marker(_broadcast(df, blocks[0]), width)(text))
    row, each = fresh("row_number", df), fresh("row_hits", df)
    table = stored(df.withColumn(row, F.monotonically_increasing_id()), "numbered-texts")
    words = stored(table.select(F.col(row).alias("row"), _spelled()(text).alias("words")), "text-words")
    found = None
    for block in blocks:
        shared = _broadcast(df, block)
        hits = words.select(F.col("row").alias(row), _marker(shared, width)("words").alias(each))
        hits = hits.where(F.size(f"{each}.starts") > 0) if found is not None else hits  # the first block brings the word counts
        part = stored(hits, "block-hits")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    spans = F.flatten(F.collect_list(F.arrays_zip(F.col(f"{each}.starts").alias("a"), F.col(f"{each}.ends").alias("b"))))
    whole = found.groupBy(row).agg(F.max(f"{each}.n_words").alias("n_words"), spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{each}.items")))).alias("items"))

    @F.arrow_udf("struct<starts:array<int>,ends:array<int>>")
    def merged(column: pa.Array) -> pa.Array:
        pairs = [merge([(s["a"], s["b"]) for s in row]) for row in column.to_pylist()]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], kind) for k in (0, 1)], ["starts", "ends"])

    put = whole.withColumn("m", merged("spans")).select(row, F.struct("n_words", "m.starts", "m.ends", "items").alias(name))
    return table.drop(name).join(put, row).drop(row)


_ARROW = pa.struct([("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def n_hit(name: str = "hits"):
    return F.aggregate(F.zip_with(f"{name}.ends", f"{name}.starts", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)


def _outputs(name: str) -> dict:
    return {
        "n_words": F.col(f"{name}.n_words"),
        "n_hit": n_hit(name),
        "n_items": F.size(f"{name}.items").cast("long"),
        "items_sha256": F.sha2(F.array_join(f"{name}.items", ","), 256),
        "contaminated": F.size(f"{name}.starts") > 0,
        "items": F.col(f"{name}.items"),
        "starts": F.col(f"{name}.starts"),
        "ends": F.col(f"{name}.ends"),
    }


def report(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Columns of df plus n_words, n_hit, n_items, items_sha256, contaminated, items, starts, ends."""
    outputs = _outputs("hits")
    held, name, text = [c for c in df.columns if c not in outputs], fresh("hits", df), options.get("text", "text")
    marked = mark(df.select(*held, *([text] if text not in held else [])), benchmark, name=name, **options)
    return marked.select(*held, *(c.alias(n) for n, c in _outputs(name).items()))


def clean(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark passage, with the columns of df."""
    name = fresh("hits", df)
    return mark(df, benchmark, name=name, **options).where(F.size(f"{name}.starts") == 0).select(*df.columns)


def brute_force(text: str | None, items: list[tuple[str, str | None]], width: int = WINDOW) -> tuple[int, int, int, str]:
    """The same result for one text, position by position; for tests."""
    words, hit, found = alnum_words(text.encode() if text else None), set(), set()
    for item, body in items:
        for pattern in windows(alnum_words(body.encode() if body else None), width):
            for i in range(len(words) - len(pattern) + 1):
                if tuple(words[i : i + len(pattern)]) == pattern:
                    hit.update(range(i, i + len(pattern)))
                    found.add(item)
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


__all__ = ["Searcher", "WuManber", "brute_force", "clean", "mark", "report"]
