"""Exact Jaccard join of n-gram sets with a prefix tree, and the components of its links.

Two documents link when the Jaccard similarity of their sets of 5-word shingles is at least 80 percent. The join
never forms all pairs of a group:

1. ``chunks`` - each task turns its texts into sets of 64-bit shingle hashes and packs chunks of some thousand
   documents. Equal sets of a chunk are folded into one. Each chunk deals its distinct shingles, delta coded, to
   hash ranges: one compact row per chunk and range, whatever the frequency of a shingle. The number of ranges
   follows from the bytes of the texts, and a chunk grows with it, so rows stay worth their overhead.
2. ``document frequency`` - each range counts in how many places a shingle occurs and sends the shared ones back
   to their chunks. A set less than 80 percent of whose shingles occur elsewhere can't link and is done.
3. ``classes`` - sets of one size that share the same shingles with others are equally similar to any other set, so
   one of them stands for all: a passage that many documents hold besides words of their own costs one set. Classes
   are told apart by 128 bits and numbered by their first set, so no two of them are ever taken for one another.
4. ``prefix`` - classes are ordered globally, rarest shingle first. Linked sets must share a shingle of
   their prefixes (n - ceil(0.8 n) + 1 shingles). Sets that share a prefix shingle fall into one candidate
   family, found by connected components over star edges (linear in the prefixes, not in the pairs).
5. ``trie`` - each family's sets go to one task once (large families: see _large_links). There they are stored in a
   prefix tree in the global order; a probe walks the tree, shares the overlap of common branches, and leaves a
   subtree when its overlap so far plus the shorter of the remaining lengths can't reach what 80 percent needs,
   or when all sets below it are already in the probe's component. Overlaps are exact.
6. ``components`` - links found (a spanning forest of each task) are closed by connected components.

Shingles are compared by 64-bit hashes: a result can only err where two different shingles of one text or of one
compared pair collide (about 1e-14 for sets of 500). Documents without words (null, empty, blank) have no set and link
with nothing. Documents with equal sets always link. Repeated rows are rows of their own. An empty table gives no rows.
Other columns, whatever their names, are not read.

Limits of the layout: up to some 2 TB of text a range holds RANGE_BYTES of text; beyond, MAX_CHUNK_TOKENS bounds the
number of ranges and a range grows in proportion (at 100 TB 400 MB of text, about 0.7 GB packed, in a task).
"""

from __future__ import annotations

import itertools
import struct

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .components import SALTS, connected_components, with_least, with_total
from .textops import LOWER_TABLE, fresh

SHINGLE = 5
PERCENT = 80
HASH_BITS = 64
#: A chunk closes at so many documents or shingles. It bounds a task's memory, not the result.
CHUNK_DOCS, CHUNK_TOKENS, MAX_CHUNK_TOKENS = 8_192, 1_000_000, 16_000_000
#: Text for each hash range, about, and shingles of a chunk for each range, at least.
RANGE_BYTES, RANGE_TOKENS = 8 << 20, 64
#: Shingles in one trie task; larger families are cut into blocks.
FAMILY_TOKENS = 1_000_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(raw: bytes | None, known: dict[bytes, int], size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words, one for the whole sequence."""
    words = raw.translate(LOWER_TABLE).split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    digest = xxhash.xxh64_intdigest
    codes = []
    for word in words:
        code = known.get(word)
        if code is None:
            code = known[word] = digest(word)
        codes.append(code)
    if len(known) > 200_000:
        known.clear()
    codes = np.array(codes, np.uint64)
    n = len(codes) - size + 1
    total = codes[:n] * np.uint64(_ODD[0])
    for k in range(1, size):
        total = _mix(total) + codes[k : k + n] * np.uint64(_ODD[k % len(_ODD)])
    return np.unique(_mix(total))


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together: the high ones are nearly constant and pack well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _unplanes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers; the first must be sorted and is delta coded."""
    first, rest = arrays[0].astype(np.uint64), arrays[1:]
    gaps = np.diff(first, prepend=np.uint64(0))
    wide = bool(len(gaps)) and int(gaps.max()) >> 32 != 0
    parts = [_planes(gaps if wide else gaps.astype(np.uint32))] + [_planes(a) for a in rest]
    kinds = [b"8" if wide else b"4"] + [a.dtype.char.encode() for a in rest]
    return b"".join(kinds) + b"|" + _PACK.compress(struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    kinds, body = blob.split(b"|", 1)
    body = _UNPACK.decompress(body)
    sizes, at, out = struct.unpack_from(f"<{len(kinds)}I", body), 4 * len(kinds), []
    for k, (kind, size) in enumerate(zip(kinds.decode(), sizes)):
        part, at = body[at : at + size], at + size
        if k == 0:
            out.append(np.cumsum(_unplanes(part, np.uint64 if kind == "8" else np.uint32).astype(np.uint64), dtype=np.uint64) if size else np.empty(0, np.uint64))
        else:
            out.append(_unplanes(part, np.dtype(kind)) if size else np.empty(0, np.dtype(kind)))
    return out


# ---- 1 chunks -------------------------------------------------------------------------------------------------

_SEVERAL = 0xFFFF
#: Sets that one task can number: a set's number is the task's partition and its place there.
_TASK_BITS = 40

_CHUNK_ROW = pa.schema([("chunk", pa.int64()), ("range", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("keys", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("nodes", pa.list_(pa.int64())), ("blob", pa.binary())])
_CHUNK_DDL = "chunk bigint, range int, doc_ids array<bigint>, keys array<string>, sizes array<bigint>, nodes array<bigint>, blob binary"


class _Chunk:
    """Some thousand documents of one task. Its name and its sets' numbers come from the task's partition, so a rerun repeats them."""

    def __init__(self, name: int, first: int):
        self.name, self.first = name, first
        self.sets: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.n = 0

    def add(self, doc_id, key, hashes: np.ndarray) -> None:
        node = None
        if len(hashes):
            place = self.sets.setdefault(xxhash.xxh3_128_digest(hashes.tobytes()), len(self.sets))
            node = self.first + place
            if place == len(self.tokens):
                self.tokens.append(hashes)
                self.n += len(hashes)
        self.docs.append((doc_id, key, len(hashes), node))

    def rows(self, ranges: int):
        """The documents with the shingles that several sets of the chunk hold; then each range's distinct shingles.

        A range row has (hash, set, number of sets); the set is _SEVERAL where there are several, so a frequent
        shingle costs one entry a chunk.
        """
        several, parts = b"", []
        if self.tokens:
            tokens = np.concatenate(self.tokens)
            owner = np.repeat(np.arange(len(self.tokens), dtype=np.uint16), [len(t) for t in self.tokens])
            at = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[at], owner[at]
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(first, len(tokens)))
            many = np.repeat(counts > 1, counts)
            several = pack(tokens[many], owner[many])
            tokens, owner = tokens[first], np.where(counts > 1, _SEVERAL, owner[first]).astype(np.uint16)
            counts = counts.astype(np.uint16)
            cuts = np.searchsorted(tokens, np.array([(r << HASH_BITS) // ranges for r in range(1, ranges)], np.uint64))
            parts = [(r, pack(tokens[lo:hi], owner[lo:hi], counts[lo:hi])) for r, (lo, hi) in enumerate(itertools.pairwise([0, *cuts.tolist(), len(tokens)])) if hi > lo]
        yield self.name, -1 - self.name % ranges, *([d[k] for d in self.docs] for k in range(4)), several
        for r, blob in parts:
            yield self.name, r, None, None, None, None, blob


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_CHUNK_ROW)], schema=_CHUNK_ROW)


def _chunker(ranges: int, size: int, chunk_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        known: dict[bytes, int] = {}
        start = TaskContext.get().partitionId() << _TASK_BITS
        names, chunk = itertools.count(start + 1), _Chunk(start, start)
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.large_binary())):
                chunk.add(doc_id.as_py(), key.as_py(), shingle_hashes(text.as_py(), known, size))
                if len(chunk.docs) >= CHUNK_DOCS or chunk.n >= chunk_tokens:
                    for row in chunk.rows(ranges):
                        yield _batch([row])
                    chunk = _Chunk(next(names), chunk.first + len(chunk.sets))
        if chunk.docs:
            for row in chunk.rows(ranges):
                yield _batch([row])

    return run


# ---- 2 document frequency -------------------------------------------------------------------------------------


def _frequencies(table: pa.Table) -> pa.Table:
    """One hash range: send each chunk its shingles that other sets hold as well, with their frequencies."""
    if table.column("range")[0].as_py() < 0:
        return table
    chunks, blobs = table.column("chunk").to_pylist(), [unpack(b.as_py()) for b in table.column("blob")]
    distinct = np.concatenate([b[0] for b in blobs])
    distinct.sort()
    distinct = distinct[np.concatenate([[True], distinct[1:] != distinct[:-1]])]
    df = np.zeros(len(distinct), np.uint32)
    for hashes, _, count in blobs:  # a chunk names a shingle once
        df[np.searchsorted(distinct, hashes)] += count
    df = np.minimum(df, 65_535).astype(np.uint16)
    rows = []
    for chunk, (hashes, owner, _) in zip(chunks, blobs):
        own = df[np.searchsorted(distinct, hashes)]
        shared = own > 1
        if shared.any():
            rows.append((chunk, 0, None, None, None, None, pack(hashes[shared], owner[shared], own[shared])))
    return pa.Table.from_batches([_batch(rows)], schema=_CHUNK_ROW)


# ---- 3 classes that can link ----------------------------------------------------------------------------------

_SET_ROW = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("n", pa.int64()), ("node", pa.int64()), ("same", pa.binary()), ("alike", pa.bool_()), ("blob", pa.binary()), ("prefix", pa.list_(pa.int64()))])
_SET_DDL = "doc_id bigint, key string, n bigint, node bigint, same binary, alike boolean, blob binary, prefix array<bigint>"


def _needed(percent: int, n: int) -> int:
    """The least overlap of a set of n with any partner: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def _assembler(percent: int):
    def run(table: pa.Table) -> pa.Table:
        """One chunk: rows of its documents (blob null) and of its sets that can link (with blob).

        ``same`` names the class; ``alike`` tells whether sets of the class link with each other.
        """
        tokens, owner, df, several = [], [], [], None
        docs: list[tuple] = []
        for row in table.to_pylist():
            if row["doc_ids"] is not None:
                docs = list(zip(row["doc_ids"], row["keys"], row["sizes"], row["nodes"]))
                several = unpack(row["blob"]) if row["blob"] else None
            else:
                a, b, c = unpack(row["blob"])
                tokens.append(a)
                owner.append(b)
                df.append(c)
        classes: dict[int, tuple] = {}
        sets = []
        if tokens:
            tokens, owner, df = map(np.concatenate, (tokens, owner, df))
            if several is not None and len(several[0]):
                known = owner == _SEVERAL
                at = np.argsort(tokens[known])
                names, counts = tokens[known][at], df[known][at]
                tokens = np.concatenate([tokens[~known], several[0]])
                df = np.concatenate([df[~known], counts[np.searchsorted(names, several[0])]])
                owner = np.concatenate([owner[~known], several[1]])
            sizes = {node: n for _, _, n, node in docs if node is not None}
            at = np.lexsort((tokens, df, owner))
            tokens, owner, df = tokens[at], owner[at], df[at]
            bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
            for k, (node, n) in enumerate(sizes.items()):
                lo, hi = int(bounds[k]), int(bounds[k + 1])
                if hi - lo < _needed(percent, n):
                    continue
                mine = tokens[lo:hi]
                width = n - _needed(percent, n) + 1 - (n - len(mine))
                by_hash = np.argsort(mine)
                ordered = mine[by_hash]
                same = xxhash.xxh3_128_digest(ordered.tobytes() + struct.pack("<q", n))
                classes[node] = same, (100 + percent) * len(mine) >= 2 * percent * n
                sets.append((None, None, n, node, *classes[node], pack(ordered, df[lo:hi][by_hash]), mine[:width].view(np.int64)))
        rows = [(doc_id, key, n, node, *classes.get(node, (None, None)), None, None) for doc_id, key, n, node in docs] + sets
        arrays = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SET_ROW)]
        return pa.Table.from_arrays(arrays, schema=_SET_ROW)

    return run


# ---- 5 trie ---------------------------------------------------------------------------------------------------


class _Branch:
    """A path of the tree: a stretch of shingle ranks, what hangs below, and bounds on the sets below."""

    __slots__ = ("below", "ends", "least", "left", "mixed", "most", "one", "path")

    def __init__(self, path, left: int):
        self.path, self.below, self.ends = path, {}, []
        self.left, self.least, self.most = left, 1 << 60, 0
        self.one, self.mixed = -1, False


class TrieJoin:
    """Incremental exact join of sets in one global order: probe, link, insert."""

    def __init__(self, ranks: int, percent: int = PERCENT):
        self.percent, self.root = percent, _Branch(np.empty(0, np.int32), 0)
        self.inside = np.zeros(ranks + 1, np.uint8)
        self.parent: list[int] = []
        self.sizes: list[int] = []
        self.visits = 0

    def find(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def new(self, size: int) -> int:
        self.parent.append(len(self.parent))
        self.sizes.append(size)
        return len(self.parent) - 1

    def probe(self, k: int, path: np.ndarray):
        """Link set k with every stored set that is similar enough; yields the partners that were in other components."""
        n, percent, inside = self.sizes[k], self.percent, self.inside
        inside[path] = 1
        stack = [(self.root, 0, len(path))]
        while stack:
            branch, overlap, rest = stack.pop()
            self.visits += 1
            if 100 * branch.most < percent * n or percent * branch.least > 100 * n:
                continue
            need = -(-percent * (n + max(branch.least, _needed(percent, n))) // (100 + percent))
            if len(branch.path):
                rest = min(rest, len(path) - int(np.searchsorted(path, branch.path[0])))
            if overlap + min(rest, branch.left) < need:
                continue
            if not branch.mixed and branch.one >= 0 and self.find(branch.one) == self.find(k):
                continue
            if len(branch.path):
                overlap += int(np.count_nonzero(inside[branch.path]))
            for other in branch.ends:
                if (100 + percent) * overlap >= percent * (n + self.sizes[other]):
                    a, b = self.find(k), self.find(other)
                    if a != b:
                        self.parent[max(a, b)] = min(a, b)
                        yield other
            stack.extend((b, overlap, rest) for b in branch.below.values())
        inside[path] = 0

    def insert(self, k: int, path: np.ndarray) -> None:
        branch, at = self.root, 0
        while True:
            self._cover(branch, k, len(path) - at)
            at += len(branch.path)
            if at == len(path):
                branch.ends.append(k)
                return
            nxt = branch.below.get(int(path[at]))
            if nxt is None:
                leaf = _Branch(path[at:], 0)
                self._cover(leaf, k, len(path) - at)
                leaf.ends.append(k)
                branch.below[int(path[at])] = leaf
                return
            rest = path[at : at + len(nxt.path)]
            differ = np.flatnonzero(nxt.path[: len(rest)] != rest)
            common = int(differ[0]) if len(differ) else len(rest)
            if common < len(nxt.path):
                upper = _Branch(nxt.path[:common], nxt.left)
                upper.least, upper.most, upper.one, upper.mixed = nxt.least, nxt.most, nxt.one, nxt.mixed
                nxt.path = nxt.path[common:]
                nxt.left -= common
                upper.below[int(nxt.path[0])] = nxt
                branch.below[int(path[at])] = upper
                nxt = upper
            branch = nxt

    def _cover(self, branch: _Branch, k: int, left: int) -> None:
        branch.left = max(branch.left, left)
        branch.least, branch.most = min(branch.least, self.sizes[k]), max(branch.most, self.sizes[k])
        if branch.one < 0:
            branch.one = k
        elif not branch.mixed and self.find(branch.one) != self.find(k):
            branch.mixed = True


def join_family(members: list[tuple], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (a, b) that connect what similarity connects. Members: (side, node, n, known, packed (hash, frequency)).

    Sets of side 1 are only probed against those of side 0; without side 1 all are joined with each other. Sets
    with the same ``known`` component are connected already and cost no comparison.
    """
    members = sorted({(m[0], m[1]): m for m in members}.values(), key=lambda m: (m[0], m[2], m[1]))
    packed = [unpack(m[4]) for m in members]
    lengths = [len(p[0]) for p in packed]
    tokens, frequency = (np.concatenate([p[k] for p in packed]) for k in (0, 1))
    distinct, first_place, ranks, counts = np.unique(tokens, return_index=True, return_inverse=True, return_counts=True)
    by_frequency = np.lexsort((distinct, frequency[first_place]))
    useful = np.empty(len(distinct), np.int64)
    useful[by_frequency] = np.cumsum(counts[by_frequency] > 1) - 1  # a shingle of one set alone can't be in an overlap
    alive, ranks = counts[ranks] > 1, useful[ranks].astype(np.int32)
    tree, links, at, cross = TrieJoin(int(useful.max()) + 1 if len(useful) else 0, percent), [], 0, members[-1][0] == 1
    first: dict[int, int] = {}
    for (_, _, n, known, _) in members:
        k = tree.new(n)
        if known is not None:
            tree.parent[k] = first.setdefault(known, k)
    for k, ((side, node, _, _, _), length) in enumerate(zip(members, lengths)):
        path = np.sort(ranks[at : at + length][alive[at : at + length]])
        at += length
        if not cross or side == 1:
            links.extend((members[other][1], node) for other in tree.probe(k, path))
        if side == 0:
            tree.insert(k, path)
    return links


def _trie_tasks(percent: int):
    def run(batches):
        key, members = None, []

        def links():
            found = join_family(members, percent) if len(members) > 1 else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:2] != key:
                    if members:
                        yield links()
                    key, members = row[:2], []
                members.append(row[2:])
        if members:
            yield links()

    return run


def _join_tasks(tasks: DataFrame, percent: int) -> DataFrame:
    """Links of tasks (comp, task, side, node, n, known, blob)."""
    columns = ("comp", "task", "side", "node", "n", "known", "blob")
    return tasks.select(*columns).repartition("comp", "task").sortWithinPartitions("comp", "task").mapInArrow(_trie_tasks(percent), "a bigint, b bigint")


def _task(*parts) -> Column:
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _blocks(sets: DataFrame, group: str, family_tokens: int) -> DataFrame:
    """sets with ``blocks``, how many tasks the shingles of their group need, and ``block``, which of them is theirs."""
    weighed = with_total(sets, group, F.col("node"), F.sum("n"), F.sum, "weight")
    counted = weighed.withColumn("blocks", F.ceil(F.col("weight") / family_tokens).cast("int")).drop("weight")
    return counted.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))


def _main_part(large: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links inside the blocks of large families and between one leader of each block, and the sets with their
    component so far (``known``) and whether it is their family's largest (``main``)."""
    none = F.lit(None).cast("bigint")
    inside = stored(_join_tasks(large.select("comp", _task(F.col("block")).alias("task"), F.lit(0).alias("side"), "node", "n", none.alias("known"), "blob"), percent), "block-links")
    local = large.select("comp", "block", "node").join(connected_components(inside).withColumnRenamed("comp", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    sizes = local.groupBy("comp", "block", "known").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("node"))
    leaders = sizes.groupBy("comp", "block").agg(F.max_by("node", F.struct("size", "node")).alias("node"))
    met = _join_tasks(large.join(leaders.select("node"), "node", "left_semi").select("comp", _task("leaders").alias("task"), F.lit(0).alias("side"), "node", "n", none.alias("known"), "blob"), percent)
    links = stored(inside.unionByName(met), "leader-links")
    known = large.select("comp", "node").join(connected_components(links).withColumnRenamed("comp", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    largest = known.groupBy("comp", "known").agg(F.count(F.lit(1)).alias("size")).groupBy("comp").agg(F.max_by("known", F.struct("size", "known")).alias("largest"))
    mains = known.join(largest.select(F.col("largest").alias("known"), F.lit(True).alias("main")), "known", "left")
    return links, large.join(mains.select("node", "known", F.coalesce("main", F.lit(False)).alias("main")), "node")


def _rest_tasks(marked: DataFrame, family_tokens: int) -> DataFrame:
    """Trie tasks that compare what is outside the main components with all it can link with.

    Sets that link share a prefix shingle, so a set outside its family's main component meets, for each of its prefix
    shingles, only the sets with that shingle. Which sets meet is settled on (node, shingle) rows without the sets
    themselves. Shingles of little weight are packed: as many of a family's as fit a task share one, where a set stands
    once however many of them it has. A shingle whose sets don't fit one task is cut into blocks, each of which
    meets the sets outside. Only then a set is shipped, once for each task that needs it.
    """
    pairs = marked.select("comp", "node", "n", "main", F.explode("prefix").alias("token"))
    wanted = pairs.where("NOT main").select("comp", "token").distinct()
    met = stored(pairs.join(wanted, ["comp", "token"], "left_semi"), "rest-pairs")
    weights = met.groupBy("comp", "token").agg(F.sum("n").alias("weight"))
    light = F.col("weight") <= family_tokens
    packs = weights.where(light).groupBy("comp").agg(F.ceil(F.sum("weight") / family_tokens).cast("long").alias("packs"))
    named = F.when(light, _task("pack", F.pmod(F.xxhash64("token"), F.col("packs")))).otherwise(_task("token", F.col("token")))
    groups = stored(weights.join(packs, "comp", "left").select("comp", "token", named.alias("name")), "rest-groups")
    # stored, so that the join is one of two exchanges, in which a hot shingle's rows are split by the adaptive skew join
    whole = met.join(groups, ["comp", "token"]).select("comp", "name", "node", "n", "main").distinct()
    cut = _blocks(whole.withColumn("group", F.concat_ws("/", "comp", "name")), "group", family_tokens)
    own = cut.select("comp", _task("own", F.col("name"), F.col("block")).alias("task"), F.lit(0).alias("side"), "node")
    several = cut.where("blocks > 1")
    here = several.select("comp", _task("away", F.col("name"), F.col("block")).alias("task"), F.lit(0).alias("side"), "node")
    away = several.where("NOT main").withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).where("other <> block")
    tasks = own.unionByName(here).unionByName(away.select("comp", _task("away", F.col("name"), F.col("other")).alias("task"), F.lit(1).alias("side"), "node"))
    return tasks.join(marked.select("node", "n", "known", "blob"), "node")


def _large_links(large: DataFrame, percent: int, family_tokens: int) -> DataFrame:
    """Links of the families that don't fit one task: (comp, node, n, blob, prefix, blocks, block).

    Each block is joined in itself, and one leader of the largest component of each block with the other leaders.
    That connects nearly all of a family of near copies; two sets of one component need no comparison, so its main
    component is never compared with itself again. What is left goes through _rest_tasks.
    """
    links, marked = _main_part(large, percent)
    marked = stored(marked, "families-so-far")
    return links.unionByName(_join_tasks(_rest_tasks(marked, family_tokens), percent))


# ---- the whole join -------------------------------------------------------------------------------------------


def _grouped(docs: DataFrame, doc_id: str, text: str, key: Column, percent: int, size: int, family_tokens: int) -> DataFrame:
    """(doc_id, key, n, group) of every row: rows of one group are linked; without words the group is null."""
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), key.cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    size_of_all = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(MAX_CHUNK_TOKENS // RANGE_TOKENS, -(-size_of_all // RANGE_BYTES)))
    chunk_tokens = max(CHUNK_TOKENS, RANGE_TOKENS * ranges)
    chunks = narrow.mapInArrow(_chunker(ranges, size, chunk_tokens), _CHUNK_DDL)
    many = ranges > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # more ranges than the session's partitions: a task for each
    chunks = chunks.repartition(ranges, "range") if many else chunks
    shared = chunks.groupBy("range").applyInArrow(_frequencies, _CHUNK_DDL)
    shared = shared.repartition(ranges, "chunk") if many else shared
    table = stored(shared.groupBy("chunk").applyInArrow(_assembler(percent), _SET_DDL), "shingle-sets")
    rows, sets = table.where("blob IS NULL").select("doc_id", "key", "n", "node", "same", "alike"), table.where("blob IS NOT NULL")
    classes = stored(sets.groupBy("same").agg(F.min("node").alias("class")), "shingle-classes")
    sets = sets.select("node", "n", "blob", "prefix").join(classes.select(F.col("class").alias("node")), "node", "left_semi")

    pairs = sets.select("node", F.explode("prefix").alias("token"))
    stars = with_least(pairs, "token", "node", "head").select(F.col("head").alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    families = connected_components(stars)

    dealt = stored(_blocks(sets.join(families, "node"), "comp", family_tokens), "families")
    small = dealt.where("blocks = 1").select("comp", _task("all").alias("task"), F.lit(0).alias("side"), "node", "n", F.lit(None).cast("bigint").alias("known"), "blob")
    links = _join_tasks(small, percent)
    large = dealt.where("blocks > 1")
    if not large.select("comp").isEmpty():
        links = links.unionByName(_large_links(large, percent, family_tokens))
    linked = connected_components(links)

    named = classes.join(linked.withColumnRenamed("node", "class"), "class", "left")
    grouped = _join_salted(rows, named)
    # a class whose sets are not alike and that links with no other is no group: its rows keep their own sets
    return grouped.select("doc_id", "key", "n", "node", F.coalesce("comp", F.when(F.col("alike"), F.col("class")), "node").alias("group"))


def _join_salted(rows: DataFrame, named: DataFrame) -> DataFrame:
    """rows with (class, comp) of their class. A class may hold a third of all rows: its rows are spread by salts."""
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "node", "key"), F.lit(SALTS)).cast("int"))
    present = dealt.where("same IS NOT NULL").select("same", "salt").distinct().join(named, "same")
    return dealt.join(present, ["same", "salt"], "left")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, family_tokens: int = FAMILY_TOKENS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id reachable by links, its own included.

    Rows with a null or repeated doc_id keep their rows; a null doc_id never becomes a component's name unless
    all of its component are null. docs must give the same rows per partition when it is read again (a table).
    """
    found = _grouped(docs, doc_id, text, F.lit(None), percent, size, family_tokens)
    named = with_total(found, "group", F.struct("doc_id", "node"), F.min("doc_id"), F.min, "component")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE, family_tokens: int = FAMILY_TOKENS) -> DataFrame:
    """One row of each component stays, with the columns of docs: that of the smallest doc_id (nulls last), then of the
    smallest MD5 of its text; of rows equal in both the one with the smallest hash of all its columns.

    Rows are told apart by doc_id and text, so repeated and null doc_ids lose no text of another component. Rows
    without words link with nothing and all stay.
    """
    columns, name, mark = docs.columns, fresh("key", docs), fresh("copies", docs)
    digest = F.md5(F.col(text).cast("binary"))
    found = _grouped(docs, doc_id, text, digest, percent, size, family_tokens).where(F.col("group").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    best = found.groupBy("group", "doc_id", "key").agg(F.count(F.lit(1)).alias("copies")).groupBy("group").agg(F.min_by(F.struct("doc_id", "key", "copies"), order).alias("r"))
    keepers = stored(best.select("r.*"), "keepers").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies"))
    keyed = docs.withColumn(name, digest)
    blank = ~F.coalesce(F.col(text).cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")

    def match(part: DataFrame) -> DataFrame:
        return keyed.join(part, (F.col(name) == F.col("__key")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__id")), "left_semi")

    out = match(keepers.where("__copies = 1")).select(*columns).unionByName(docs.where(blank))
    repeated = keepers.where("__copies > 1")
    if not repeated.isEmpty():
        again = match(repeated).withColumn(mark, F.struct(F.xxhash64(*columns).alias("h"), F.struct(*columns).alias("r")))
        out = out.unionByName(again.groupBy(doc_id, name).agg(F.min_by(f"{mark}.r", f"{mark}.h").alias(mark)).select(f"{mark}.*"))
    return out
