"""Language-model scores of Brown classes.

Every word of the training texts belongs to one class. A text's probability is the product, over its tokens, of a class
transition P(class | class before) and a word emission P(word | class); the end of a text is a token with a class of its
own, and it also stands before the first word. Classes are found by exchange: each round counts, for every word, the
classes that follow it and that come before it, and moves it to the class that raises the mutual information of
neighbouring classes most, given the class counts of the round before. All words take part at every size.

Smoothing: transitions get PRIOR pseudo-counts dealt by the classes' own frequencies; a word not met in training takes
the share (words met once + 1) / (tokens + 2) of the whole, and behind it the classes' own frequencies hold. So the
probabilities of all known words and of the unknown word add up to one in every context.

How it is spread: no table of word pairs is made, whose rows would be half the corpus. Texts are cut once into chunks
that are numbered by a dictionary of their own (bounded bytes and words, whatever the texts), and the vocabulary into
shards by a hash of the word (bounded words). Then chunks and shards exchange messages: a shard tells a chunk the
classes of its words, a chunk tells a shard the neighbours' classes of its words, already added up. A word is in a
chunk's message once, however often it stands there, so no word is hot. The chunks are a bucketed table and stay where
they are; only the messages are shuffled. Only the counts of class pairs (CLASSES squared)
and the seeds (CLASSES words) come to the driver.

Defined results: A-Z are lower-cased, words are cut at blank, tab, line and page ends; a null or empty text is its end
alone. A null doc_id counts as an empty text of an id. Repeated rows count as often as they stand. Without training texts
every token is unknown and scores are 0. Texts of any length count whole. An empty table gives no rows; other columns are
never read. Results don't depend on how the rows are dealt.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, stored
from .textops import LOWER_TABLE, batched, rows_of, texts

CLASSES = 32
ROUNDS = 3
PRIOR = 16.0
#: A chunk ends behind the text that reaches either bound.
CHUNK_BYTES, CHUNK_WORDS = 16 << 20, 300_000
#: Words of a shard, at most about, even if no two chunks share a word.
SHARD_WORDS = 100_000
#: Class of the end of a text, and what stands for the class of a word not met in training.
END, UNKNOWN = 0, 255


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: equal places of the numbers lie together, so small ones cost little."""
    wide = 4 if not len(values) or int(values.max()) < 1 << 31 else 8
    planes = np.ascontiguousarray(values, f"<i{wide}").view(np.uint8).reshape(-1, wide).T.tobytes()
    return bytes([wide]) + len(values).to_bytes(7, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    wide, n = blob[0], int.from_bytes(blob[1:8], "little")
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * wide, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(wide, n).T).view(f"<i{wide}").ravel()


class _Numbers(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


_CHUNK = pa.schema(
    [("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int64())), ("n_words", pa.int64()), ("codes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())]
)
_CHUNK_DDL = "chunk long, ids array<long>, held array<boolean>, lens array<long>, n_words long, codes binary, words binary, counts binary"


def _chunks(batches):
    """Texts as numbers of a chunk's own dictionary; counts: how often each word stands in the chunk's training texts."""

    def rows():
        task, seq = TaskContext.get().partitionId(), 0
        numbers, ids, held, codes, size = _Numbers(), [], [], [], 0

        def done():
            flat = [c for c, out in zip(codes, held, strict=True) if not out]
            counts = np.bincount(np.concatenate(flat), minlength=len(numbers)) if flat else np.zeros(len(numbers), np.int64)
            blob = pa.compress(b" ".join(numbers), codec="zstd", asbytes=True)
            words = len(b" ".join(numbers)).to_bytes(8, "little") + blob
            return ((task << 32) + seq, ids, held, [len(c) for c in codes], len(numbers), pack(np.concatenate(codes)), words, pack(counts))

        for batch in batches:
            for doc, out, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                found = raw.translate(LOWER_TABLE).split() if raw else []
                codes.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
                ids.append(doc)
                held.append(out)
                size += len(raw or b"")
                if size >= CHUNK_BYTES or len(numbers) >= CHUNK_WORDS:
                    yield done()
                    seq, numbers, ids, held, codes, size = seq + 1, _Numbers(), [], [], [], 0
        if ids:
            yield done()

    return batched(rows(), _CHUNK, max_rows=1)


def _words(blob: bytes) -> list[bytes]:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).split(b" ")


_MESSAGE = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_MESSAGE_DDL = "shard int, chunk long, a binary, b binary, c binary"


def _spell(batches, shards: int):
    """Chunks tell the shards their words: (shard, chunk, numbers in the chunk, words, counts)."""

    def rows():
        for chunk, n_words, words, counts in rows_of(batches):
            if not n_words:
                continue
            spelled, n = _words(words), unpack(counts)
            shard = np.fromiter((zlib.crc32(w) % shards for w in spelled), np.int64, n_words)
            order = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.diff(shard[order])) + 1
            for part in np.split(order, cuts):
                own = b" ".join([spelled[i] for i in part])
                yield int(shard[part[0]]), chunk, pack(part), own, pack(n[part])

    return batched(rows(), _MESSAGE, max_rows=500)


def _vocabulary(batches):
    """Shards number their words. Back to each chunk: (shard, chunk, numbers there, numbers here); last the shard's own row: words, counts, halves."""

    def rows():
        last, numbers, total = None, None, None

        def done():
            spelled = list(numbers)
            half = np.fromiter(((zlib.crc32(w) >> 15) & 1 for w in spelled), np.int64, len(spelled))
            return last, -1, b" ".join(spelled), pack(total[: len(spelled)]), pack(half)

        for shard, chunk, there, own, n in rows_of(batches):
            if shard != last:
                if last is not None:
                    yield done()
                last, numbers, total = shard, _Numbers(), np.zeros(1024, np.int64)
            spelled = own.split(b" ")
            here = np.fromiter(map(numbers.__getitem__, spelled), np.int64, len(spelled))
            if len(numbers) > len(total):
                total = np.concatenate([total, np.zeros(max(len(numbers), 2 * len(total)) - len(total), np.int64)])
            total[here] += unpack(n)  # a chunk names a word once
            yield shard, chunk, there, pack(here), b""
        if last is not None:
            yield done()

    return batched(rows(), _MESSAGE, max_rows=500)


def _facts(batches, most: int):
    """Of each shard its most frequent words, and sums: tokens, words, words met once."""

    def rows():
        for own, packed in rows_of(batches):
            spelled, n = own.split(b" "), unpack(packed)
            ties = sorted(range(len(n)), key=lambda i: (-int(n[i]), spelled[i]))[:most]
            for i in ties:
                if n[i]:
                    yield "word", spelled[i], int(n[i])
            yield "tokens", b"", int(n.sum())
            yield "words", b"", int((n > 0).sum())
            yield "once", b"", int((n == 1).sum())

    return batched(rows(), pa.schema([("what", pa.string()), ("word", pa.binary()), ("n", pa.int64())]))


_STATE = pa.schema([("shard", pa.int32()), ("counts", pa.binary()), ("halves", pa.binary()), ("classes", pa.binary())])
_STATE_DDL = "shard int, counts binary, halves binary, classes binary"


def _start(batches, seeds: dict[bytes, int], rest: int):
    """Each of the most frequent words is a class of its own, all others are one class."""

    def rows():
        for shard, own, counts, halves in rows_of(batches):
            classes = np.fromiter((seeds.get(w, rest) for w in own.split(b" ")), np.uint8)
            classes[unpack(counts) == 0] = UNKNOWN
            yield shard, counts, halves, classes.tobytes()

    return batched(rows(), _STATE, max_rows=50)


def _replies(batches, counted: bool):
    """Shards tell the chunks the classes of their words: (chunk, shard, numbers there, numbers here, classes and counts)."""

    def rows():
        classes = counts = None
        for shard, chunk, there, here, own in rows_of(batches):
            if chunk < 0:
                classes, counts = np.frombuffer(own, np.uint8), unpack(there)
                continue
            at = unpack(here)
            yield shard, chunk, there, here, classes[at].tobytes() + (pack(counts[at]) if counted else b"")

    return batched(rows(), _MESSAGE, max_rows=500)


def _learned(chunk: pa.Table, replies: pa.Table, counted: bool):
    """Classes, shards and numbers there (and counts) of a chunk's words."""
    n = chunk.column("n_words")[0].as_py()
    classes, shard, number = np.full(n, UNKNOWN, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    counts = np.zeros(n, np.int64)
    for s, there, here, own in zip(*(replies.column(c).to_pylist() for c in ("shard", "a", "b", "c")), strict=True):
        at = unpack(there)
        classes[at] = np.frombuffer(own[: len(at)], np.uint8)
        shard[at], number[at] = s, unpack(here)
        if counted:
            counts[at] = unpack(own[len(at) :])
    return classes, shard, number, counts


def _flat(chunk: pa.Table, want) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers of the wanted texts, each text followed by -1; and where each text ends."""
    codes = unpack(chunk.column("codes")[0].as_py())
    lens = np.array(chunk.column("lens")[0].as_py(), np.int64)
    ends = np.cumsum(lens)
    whole = np.insert(codes.astype(np.int64), ends, -1)
    keep = np.repeat(want, lens + 1)
    return whole[keep], np.cumsum((lens + 1)[want])


_COUNT_DDL = f"{_MESSAGE_DDL}, cell int, n long"


def _count(chunk: pa.Table, replies: pa.Table, classes: int, vectors: bool) -> pa.Table:
    """What a chunk tells: counts of class pairs (cell, n) and, to each shard, (word, neighbour's class, n) added up.

    A neighbour's class is counted as it is behind the word, plus ``classes`` before it; twice ``classes`` is the word itself.
    """
    out = {"shard": [], "chunk": [], "a": [], "b": [], "c": []}
    cells = np.zeros(classes * classes, np.int64)
    if chunk.num_rows:
        known, shard, number, _ = _learned(chunk, replies, False)
        flat, _ = _flat(chunk, ~np.array(chunk.column("held")[0].as_py(), bool))
        if len(flat):
            now = np.where(flat < 0, END, known[flat] if len(known) else END)
            before = np.concatenate([[END], now[:-1]])
            cells = np.bincount(before * classes + now, minlength=classes * classes)
            if vectors and len(known):
                _tell(out, chunk.column("chunk")[0].as_py(), _vectors(flat, now, before, len(known), classes), shard, number)
    filled = np.flatnonzero(cells)
    n, k = len(out["shard"]), len(filled)
    arrays = [pa.array(out[f.name] + [None] * k, f.type) for f in _MESSAGE]
    return pa.table([*arrays, pa.array([None] * n + filled.tolist(), pa.int32()), pa.array([None] * n + cells[filled].tolist(), pa.int64())], names=[*_MESSAGE.names, "cell", "n"])


def _vectors(flat: np.ndarray, now: np.ndarray, before: np.ndarray, words: int, classes: int):
    """(word, slot, n) of a chunk, sorted by word."""
    spot = np.flatnonzero(flat >= 0)
    own, wide = flat[spot], 2 * classes + 1
    itself = spot[flat[spot + 1] == own]  # behind every word stands a word or an end
    keys = np.concatenate([own * wide + now[spot + 1], own * wide + classes + before[spot], flat[itself] * wide + 2 * classes])
    keys, n = np.unique(keys, return_counts=True)
    return keys // wide, keys % wide, n


def _tell(out: dict, chunk: int, vectors: tuple, shard: np.ndarray, number: np.ndarray) -> None:
    word, slot, n = vectors
    order = np.argsort(shard[word], kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(shard[word][order])) + 1):
        out["shard"].append(int(shard[word[part[0]]]))
        out["chunk"].append(chunk)
        for name, values in zip("abc", (number[word[part]], slot[part], n[part]), strict=True):
            out[name].append(pack(values))


def information(pairs: np.ndarray) -> float:
    """What the classes of neighbours tell about each other, up to a constant: the exchange makes it grow."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(0)).sum() - _xlogx(pairs.sum(1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_classes(vectors: np.ndarray, counts: np.ndarray, own: np.ndarray, pairs: np.ndarray, at_once: int = 4_000) -> np.ndarray:
    """For each word the class in which it tells most, its own class first among equals.

    vectors: (words, 2 classes + 1) as counted by chunks; pairs: counts of class pairs. A word is weighed for another
    class as an addition to that class, and for its own as what the class loses without it.
    """
    k = len(pairs)
    pairs, total = pairs.astype(np.float64), pairs.sum(1).astype(np.float64)
    f, ft, diagonal = _xlogx(pairs), _xlogx(total), np.diag(pairs)
    out = own.copy()
    for begin in range(0, len(own), at_once):
        block = slice(begin, begin + at_once)
        v, mine, n = vectors[block].astype(np.float64), own[block], counts[block].astype(np.float64)
        rows, self_pairs = np.arange(len(mine)), v[:, 2 * k]
        right, left = v[:, :k].copy(), v[:, k : 2 * k].copy()
        right[rows, mine] -= self_pairs
        left[rows, mine] -= self_pairs
        gain = np.zeros((len(mine), k))
        for side, table, full in ((right, pairs, f), (left, pairs.T, f.T)):
            word, slot = np.nonzero(side)
            if len(word):
                # the same (slot, count) adds the same to a class wherever it stands
                key, at = np.unique(np.stack([slot, side[word, slot].astype(np.int64)]), axis=1, return_inverse=True)
                each = _xlogx(table[:, key[0]] + key[1]) - full[:, key[0]]
                starts = np.flatnonzero(np.diff(word, prepend=-1))
                gain[word[starts]] += np.add.reduceat(each.T[at.ravel()], starts, axis=0)
        s = self_pairs[:, None]
        gain += _xlogx(diagonal + right + left + s) - _xlogx(diagonal + right) - _xlogx(diagonal + left) + np.diag(f)
        gain -= 2 * (_xlogx(total + n[:, None]) - ft)
        # staying: what the own class has from the word
        row, column = pairs[mine], pairs.T[mine]
        cell = pairs[mine, mine]
        r, l, s = right[rows, mine], left[rows, mine], self_pairs
        stay = (_xlogx(row) - _xlogx(row - right)).sum(1) - (_xlogx(cell) - _xlogx(cell - r))
        stay += (_xlogx(column) - _xlogx(column - left)).sum(1) - (_xlogx(cell) - _xlogx(cell - l))
        stay += _xlogx(cell) - _xlogx(cell - r - l - s) - 2 * (ft[mine] - _xlogx(total[mine] - n))
        gain[:, END] = -np.inf
        gain[rows, mine] = stay
        best = gain.argmax(1)
        out[block] = np.where(gain[rows, best] > stay + 1e-9 * np.abs(stay), best, mine)
    return out


def _move(batches, pairs: np.ndarray, half: int | None):
    """Shards add up what the chunks told, and move the words of the half whose turn it is (None: all)."""
    wide = 2 * len(pairs) + 1

    def rows():
        state = vectors = None

        def done():
            shard, counts, halves, classes = state
            n, own = unpack(counts), np.frombuffer(classes, np.uint8).astype(np.int64)
            moving = n > 0
            if half is not None:
                moving &= unpack(halves) == half
            at = np.flatnonzero(moving)
            own[at] = best_classes(vectors[at], n[at], own[at], pairs)
            return shard, counts, halves, own.astype(np.uint8).tobytes()

        for shard, chunk, a, b, c in rows_of(batches):
            if chunk < 0:
                if state is not None:
                    yield done()
                state, vectors = (shard, a, b, c), np.zeros((len(c), wide), np.int64)
            else:
                np.add.at(vectors.reshape(-1), unpack(a).astype(np.int64) * wide + unpack(b), unpack(c))
        if state is not None:
            yield done()

    return batched(rows(), _STATE, max_rows=50)


@dataclass
class Model:
    """Chunked texts, vocabulary, classes of all words, counts of class pairs, tokens, words met once, words."""

    chunks: DataFrame
    vocabulary: DataFrame
    state: DataFrame
    pairs: np.ndarray
    history: list[float]
    once: int
    words: int

    @property
    def tokens(self) -> int:
        return int(self.pairs.sum())


def _asked(model_state: DataFrame, vocabulary: DataFrame, counted: bool) -> DataFrame:
    both = model_state.select("shard", F.lit(-1).cast("long").alias("chunk"), F.col("counts").alias("a"), F.col("halves").alias("b"), F.col("classes").alias("c")).unionByName(vocabulary.where("chunk >= 0"))
    return both.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(partial(_replies, counted=counted), _MESSAGE_DDL)


def _visit(chunks: DataFrame, state: DataFrame, vocabulary: DataFrame, function, ddl: str, counted: bool) -> DataFrame:
    """Each chunk meets the classes of its words."""
    return chunks.groupBy("chunk").cogroup(_asked(state, vocabulary, counted).groupBy("chunk")).applyInArrow(function, ddl)


def _pairs(told: DataFrame, classes: int) -> np.ndarray:
    out = np.zeros(classes * classes, np.int64)
    for r in told.where("cell IS NOT NULL").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out.reshape(classes, classes)


def _bucketed(chunks: DataFrame) -> DataFrame:
    """Chunks stored in buckets by their id in the shared folder, so that no round shuffles them again."""
    spark = chunks.sparkSession
    ensure_checkpoint_dir(spark)
    name = f"lm_chunks_{uuid.uuid4().hex}"
    writer = chunks.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk")
    writer.option("path", f"{spark.sparkContext.getCheckpointDir()}/{name}").saveAsTable(name)
    return spark.table(name)


def fit(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id", classes: int = CLASSES, rounds: int = ROUNDS) -> Model:
    """Classes of all words of the texts that aren't held out; of all rounds the one that tells most is kept."""
    if not 4 <= classes < UNKNOWN:
        raise ValueError(f"classes must lie between 4 and {UNKNOWN - 1}")
    narrow = docs.select(F.col(doc_id).cast("long").alias("i"), held.alias("h"), F.col(text).cast("string").alias("t"))
    chunks = _bucketed(narrow.mapInArrow(_chunks, _CHUNK_DDL))
    shards = max(1, -(-(chunks.agg(F.sum("n_words")).first()[0] or 0) // SHARD_WORDS))
    spelled = chunks.select("chunk", "n_words", "words", "counts").mapInArrow(partial(_spell, shards=shards), _MESSAGE_DDL)
    vocabulary = stored(spelled.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(_vocabulary, _MESSAGE_DDL), "lm-vocabulary")
    own = vocabulary.where("chunk < 0")
    facts = stored(own.select("a", "b").mapInArrow(partial(_facts, most=classes - 2), "what string, word binary, n long"), "lm-facts")
    sums = {r["what"]: r["n"] for r in facts.where("what <> 'word'").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    top = facts.where("what = 'word'").orderBy(F.desc("n"), "word").limit(classes - 2).collect()
    seeds = {bytes(r["word"]): i for i, r in enumerate(top, 1)}
    state = stored(own.select("shard", "a", "b", "c").mapInArrow(partial(_start, seeds=seeds, rest=classes - 1), _STATE_DDL), "lm-classes")
    narrow_chunks = chunks.select("chunk", "held", "lens", "n_words", "codes")
    history: list[float] = []
    best = None
    for k in range(rounds + 1):
        told = _visit(narrow_chunks, state, vocabulary, partial(_count, classes=classes, vectors=k < rounds), _COUNT_DDL, False)
        told = told.persist(StorageLevel.DISK_ONLY)
        pairs = _pairs(told, classes)
        history.append(information(pairs))
        if best is None or history[-1] > best[0]:
            best = (history[-1], state, pairs)
        if k < rounds:
            mail = state.select("shard", F.lit(-1).cast("long").alias("chunk"), F.col("counts").alias("a"), F.col("halves").alias("b"), F.col("classes").alias("c")).unionByName(told.where("cell IS NULL").select("shard", "chunk", "a", "b", "c"))
            moved = mail.repartition("shard").sortWithinPartitions("shard", "chunk").mapInArrow(partial(_move, pairs=pairs, half=(k - 1) % 2 if k else None), _STATE_DDL)
            state = stored(moved, "lm-classes")
        told.unpersist(blocking=True)
    return Model(chunks, vocabulary, best[1], best[2], history, sums.get("once", 0), sums.get("words", 0))


def word_classes(model: Model) -> DataFrame:
    """(word, n, class) of all words met in training."""

    def rows(batches):
        def each():
            for own, counts, classes in rows_of(batches):
                for w, n, c in zip(own.split(b" "), unpack(counts).tolist(), classes, strict=True):
                    if n:
                        yield w.decode("utf-8", "replace"), n, c

        return batched(each(), pa.schema([("word", pa.string()), ("n", pa.int64()), ("class", pa.int32())]))

    own = model.vocabulary.where("chunk < 0").select("shard", F.col("a").alias("own"))
    return own.join(model.state, "shard").select("own", "counts", "classes").mapInArrow(rows, "word string, n long, class int")


def transitions(pairs: np.ndarray, once: int) -> tuple[np.ndarray, float]:
    """log10 P(class | class before) with a last row for behind an unknown word, and log10 of an unknown word's share."""
    tokens = pairs.sum()
    if not tokens:
        return np.zeros((len(pairs) + 1, len(pairs))), 0.0
    new = (once + 1) / (tokens + 2)
    share = pairs.sum(0) / tokens
    smooth = (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
    with np.errstate(divide="ignore"):
        return np.log10(np.vstack([smooth, share]) * (1 - new)), float(np.log10(new))


_SCORE_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(chunk: pa.Table, replies: pa.Table, pairs: np.ndarray, once: int, words: int) -> pa.Table:
    classes, tokens = len(pairs), int(pairs.sum())
    if not chunk.num_rows:
        names = [x.split()[0] for x in _SCORE_DDL.split(", ")]
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
    known, _, _, counts = _learned(chunk, replies, True)
    held = np.array(chunk.column("held")[0].as_py(), bool)
    flat, ends = _flat(chunk, np.ones(len(held), bool))
    steps, new = transitions(pairs, once)
    total = pairs.sum(0)
    met = tokens > 0
    # the end stands last, so that -1 finds it
    kind = np.append(np.where(known == UNKNOWN, classes, known), END if met else classes)[flat]
    n = np.append(counts, total[END])[flat]
    emission = np.log10(np.maximum(n, 1) / np.maximum(np.append(total, 1)[kind], 1))
    before = np.concatenate([[END if met else classes], kind[:-1]])
    each = np.where(kind == classes, new, steps[before, np.minimum(kind, classes - 1)] + emission)
    base = np.log10((n + 1) / (tokens + (words + met + 1)))
    starts = np.concatenate([[0], ends[:-1]])
    sums = lambda x: np.add.reduceat(x, starts)
    out = (chunk.column("ids")[0].as_py(), held.tolist(), sums(np.ones(len(flat), np.int64)), sums((n > 0).astype(np.int64)), np.full(len(held), tokens), sums(base), sums(each))
    return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in _SCORE_DDL.split(", ")])


def apply(model: Model) -> DataFrame:
    """One row per text: tokens, known ones, training tokens, add-one unigram base, log10 probability by classes."""
    chunks = model.chunks.select("chunk", "ids", "held", "lens", "n_words", "codes")
    return _visit(chunks, model.state, model.vocabulary, partial(_score, pairs=model.pairs, once=model.once, words=model.words), _SCORE_DDL, True)


def held_out(doc_id: str = "doc_id") -> Column:
    """A seventh of all documents, by the crc32 of their ids."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2


def score(docs: DataFrame, held: Column | None = None) -> DataFrame:
    """All documents scored by classes learned from those that aren't held out."""
    return apply(fit(docs, held_out() if held is None else held))
