"""An inverted-file index over vectors: cells around centroids, searched near the query first.

The number of cells follows the rows (about their square root, MAX_CELLS at most). The centroids are fitted on a bounded
sample (SAMPLE_ROWS, chosen by a hash of the key); every row is put into the cell of its nearest centroid, and the rows
are stored in folders by cell, so a search opens only the files of the cells nearest to the query. All queries of a
batch are searched in one job: blocks of queries meet blocks of the rows of their cells, each pair of blocks as one
product of matrices. ``recall`` measures against the exact scan what the cells not read would have given. Null vectors
and those of other lengths than the first are kept in a cell of their own that every search reads.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .search import vector_distances

SAMPLE_ROWS = 20_000
MAX_CELLS, ROUNDS = 4_096, 12
#: Share of the cells that a search reads unless told otherwise, and how many at least.
PROBE_SHARE, MIN_PROBES = 0.25, 4
#: Recall that a search should reach, and the queries by which that is measured.
TARGET, TRIALS = 0.9, 50
_ODD = -1
#: Rows and queries of a block (what a task holds at a time), queries of one product, rows of a cell that go into one file.
BLOCK_ROWS, BLOCK_QUERIES, SLICE, FILE_ROWS = 4_096, 2_048, 256, 65_536


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; the same sample gives the same centroids. Empty cells keep theirs."""
    x = _unit(sample.astype(np.float64))
    centroids = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        moved = _unit(np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, sums, centroids))
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


@dataclass
class VectorIndex:
    """Stored rows in folders by cell, and the centroids (cells * dimensions numbers).

    least_probes None: measured with ``trials``, once, when a search first asks how many cells it should read.
    """

    rows: DataFrame
    centroids: np.ndarray
    key: str
    vec: str
    least_probes: int | None = MIN_PROBES
    trials: list[tuple[int, list[float]]] = field(default_factory=list)
    target: float = TARGET

    @property
    def probes(self) -> int:
        if self.least_probes is None:
            queries = self.rows.sparkSession.createDataFrame(self.trials, "query long, vector array<double>")
            self.least_probes = enough_probes(self, queries, target=self.target)
        return min(len(self.centroids), max(self.least_probes, math.ceil(PROBE_SHARE * len(self.centroids))))

    def near(self, query, probes: int) -> list[int]:
        """The cells to read for a query, the odd one among them."""
        order = np.argsort(-(self.centroids @ np.asarray(query, float)), kind="stable")[:probes]
        return [_ODD, *map(int, order)]

    def search(self, query: list[float], k: int, probes: int | None = 0, max_distance: float = 2.5) -> DataFrame:
        """The k nearest rows of the ``probes`` cells nearest to the query (0: the index's own number; None: all cells)."""
        rows = self.rows
        if probes is not None and len(self.centroids):
            rows = rows.where(F.col("cell").isin(self.near(query, probes or self.probes)))
        return vector_distances(rows, query, self.vec, max_distance).orderBy("distance", self.key).limit(k)

    def search_all(self, queries: DataFrame, k: int, probes: int | None = 0, digits: int | None = None) -> DataFrame:
        """(query, key, distance, rank, near): the k nearest rows of each query (query, vector), all in one job.

        Each query is sent to the blocks of its own cells, and of each block only its k best rows go on, so the shuffle
        carries k rows for each query and block. near says how many cells have to be read to find the row (0: none but
        the odd one). With digits distances are rounded first, and equal ones ranked by their keys.
        """
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        schema = f"query {kind(queries, 'query')}, key {kind(self.rows, self.key)}, distance double, near int"
        sizes = {r["cell"]: r["n"] for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each cell
        first, parts, n_units = _units([sizes.get(c, 0) for c in range(_ODD, len(self.centroids))])
        n_blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
        tasks = min(1_000, n_units * n_blocks)

        @F.arrow_udf("int")
        def unit(cell: pa.Array, salt: pa.Array) -> pa.Array:
            at = cell.to_numpy() - _ODD
            return pa.array(first[at] + salt.to_numpy() % parts[at], pa.int32())

        asked = queries.where("vector IS NOT NULL").select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int").alias("block"))
        number = len(self.centroids) if probes is None else probes or self.probes
        sent = asked.mapInArrow(_to_units(self.centroids, number, first, parts), f"query {kind(queries, 'query')}, vector {kind(queries, 'vector')}, block int, unit int, start int, places array<int>")
        rows = self.rows.select(F.col(self.key).alias("key"), F.col(self.vec).alias("v"), "cell").where("v IS NOT NULL")
        rows = rows.withColumn("unit", unit.asNondeterministic()("cell", F.pmod(F.xxhash64("key"), F.lit(1 << 30)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        met = rows.repartition(tasks, "unit", "block").groupBy("unit", "block").cogroup(sent.repartition(tasks, "unit", "block").groupBy("unit", "block"))
        best = met.applyInArrow(_nearest(k, digits), schema)
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).where(F.col("rank") <= k).select("query", "key", "distance", "rank", "near")


def _units(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, int]:
    """First unit and number of units of each cell, and of all: small neighbours share one, a large cell is spread over several."""
    first, parts, unit, held = [], [], 0, 0
    for n in sizes:
        if held and held + n > BLOCK_ROWS:
            unit, held = unit + 1, 0
        first.append(unit), parts.append(max(1, math.ceil(n / BLOCK_ROWS)))
        unit, held = (unit + parts[-1], 0) if parts[-1] > 1 else (unit, held + n)
    return np.array(first), np.array(parts), unit + 1


def _places(centroids: np.ndarray, vectors: list, number: int) -> np.ndarray:
    """How many cells a search has to read until it reads this one, for each query and cell (the odd one first); -1: never.

    A query that can't be compared with the centroids meets all cells at once.
    """
    out = np.zeros((len(vectors), 1 + len(centroids)), np.int32)
    width = centroids.shape[1]
    known = [i for i, v in enumerate(vectors) if len(centroids) and len(v) == width and None not in v]
    if known:
        order = np.argsort(-(np.array([vectors[i] for i in known], float) @ centroids.T), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(1, 1 + len(centroids))[None, :], 1)
        out[known, 1:] = np.where(place <= number, place, -1)
    return out


def _to_units(centroids: np.ndarray, number: int, first: np.ndarray, parts: np.ndarray):
    """Queries, once for each unit that has one of their cells, with the places of the unit's cells from its first cell on."""
    spans = [(int(u), int(p), int(lo), int(hi)) for u in np.unique(first) for lo, hi in [np.flatnonzero(first == u)[[0, -1]]] for p in [parts[hi]]]

    def send(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                places = _places(centroids, some["vector"].to_pylist(), number)
                for unit, n, lo, hi in spans:
                    own = places[:, lo : hi + 1]
                    who = np.flatnonzero((own >= 0).any(1))
                    if not len(who):
                        continue
                    taken, flat = some.take(pa.array(who)), pa.array(own[who].ravel(), pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * own.shape[1], pa.int32()), flat)
                    for part in range(unit, unit + n):
                        whole = lambda x: pa.array(np.full(len(who), x), pa.int32())  # noqa: B023, E731
                        yield pa.RecordBatch.from_arrays([taken["query"], taken["vector"], taken["block"], whole(part), whole(lo), lists], ["query", "vector", "block", "unit", "start", "places"])

    return send


def _padded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of one matrix, zeros for nulls and behind their ends, and their lengths."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(int)
    values = pc.fill_null(lists.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), max(1, lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out, lengths


def _distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """1 - cosine over the common length of each pair; 1 if either has no length."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if len(la) and len(lb) and la.min() == la.max() == lb.min() == lb.max():
        norm = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
    else:
        inside = lambda n: (np.arange(width) < n[:, None]).astype(float)
        norm = np.sqrt((a * a) @ inside(lb).T) * np.sqrt(inside(la) @ (b * b).T)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norm == 0, 1.0, 1 - (a @ b.T) / norm)


def _nearest(k: int, digits: int | None):
    """The k best rows of a block for each query of another, among the rows of the query's own cells."""

    def nearest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query": asked["query"][:0], "key": rows["key"][:0], "distance": pa.array([], pa.float64()), "near": pa.array([], pa.int32())})
        rows = rows.take(pc.sort_indices(rows["key"], null_placement="at_start"))  # of equal distances the smaller key is first
        b, lb = _padded(rows["v"])
        a, la = _padded(asked["vector"])
        cell = rows["cell"].to_numpy() - _ODD - asked["start"][0].as_py()
        places = pc.list_flatten(asked["places"]).to_numpy().reshape(len(a), -1)
        queries, keys, distances, nears = [], [], [], []
        for start in range(0, len(a), SLICE):
            d = _distances(a[start : start + SLICE], la[start : start + SLICE], b, lb)
            if digits is not None:
                d = np.floor(d * 10.0**digits + 0.5) / 10.0**digits
            near = places[start : start + SLICE, cell]
            cost = np.where((near >= 0) & ~np.isnan(d), d, np.inf)  # what is no number comes last, as in Spark's order
            last = np.partition(cost, k - 1, axis=1)[:, k - 1 : k] if cost.shape[1] > k else np.full((len(d), 1), np.inf)
            q, r = np.nonzero((near >= 0) & (cost <= last))
            order = np.lexsort((r, cost[q, r], q))
            q, r = q[order], r[order]
            best = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, r = q[best], r[best]
            queries.append(start + q), keys.append(r), distances.append(d[q, r]), nears.append(near[q, r])
        at = lambda parts: pa.array(np.concatenate(parts))
        return pa.table({"query": asked["query"].take(at(queries)), "key": rows["key"].take(at(keys)), "distance": at(distances), "near": at(nears).cast(pa.int32())})

    return nearest


def build(vectors: DataFrame, key: str, vec: str = "embedding", cells: int | None = None, sample_rows: int = SAMPLE_ROWS, target: float | None = TARGET) -> VectorIndex:
    """Fit on the sample, then put every row into its cell and the cells into folders.

    How many cells a search reads by itself is measured when the first search asks for it: as many as reach the target
    recall for TRIALS rows of the sample as queries (None: PROBE_SHARE of the cells, not measured).
    """
    some = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample_rows).select(vec).collect()
    width = len(some[0][0]) if some else 0
    sample = np.array([r[0] for r in some if len(r[0]) == width and None not in r[0]], float).reshape(-1, max(1, width))
    rows = vectors.count()
    cells = cells or max(1, min(MAX_CELLS, math.isqrt(rows)))
    centroids = fit_centroids(sample, cells) if width and len(sample) else np.zeros((0, width))

    @F.arrow_udf("int")
    def cell(column: pa.Array) -> pa.Array:
        out = np.full(len(column), _ODD, np.int32)
        at = np.flatnonzero(pc.fill_null(pc.list_value_length(column), _ODD).to_numpy(zero_copy_only=False) == width)
        if len(at) and len(centroids):
            flat = column.take(pa.array(at)).flatten()
            whole = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(1)
            values = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).reshape(-1, width)
            out[at[whole]] = (values[whole] @ centroids.T).argmax(1)
        return pa.array(out)

    placed = vectors.withColumn("cell", cell.asNondeterministic()(vec))
    # a large cell is spread over several tasks and files, by its share of the sample; the odd one always, as the sample has none of it
    share = np.bincount((sample @ centroids.T).argmax(1), minlength=len(centroids)) / len(sample) if len(centroids) else np.zeros(0)
    files = np.array([8, *np.ceil(share * rows / FILE_ROWS).clip(1, 1_000)], int)

    @F.arrow_udf("int")
    def file(cells: pa.Array, salt: pa.Array) -> pa.Array:
        return pa.array(salt.to_numpy() % files[cells.to_numpy() - _ODD], pa.int32())

    spread = placed.withColumn("file", file.asNondeterministic()("cell", F.pmod(F.xxhash64(key), F.lit(1 << 30))))
    index = VectorIndex(stored(spread.repartition("cell", "file").drop("file"), "vector-index", "cell"), centroids, key, vec)
    if target is not None and len(sample):
        trials = [(i, sample[i].tolist()) for i in np.linspace(0, len(sample) - 1, min(TRIALS, len(sample))).astype(int).tolist()]
        index.least_probes, index.trials, index.target = None, trials, target
    return index


def recalls(index: VectorIndex, queries: DataFrame, probes: list[int], k: int = 10) -> list[float]:
    """For each number of probes the share of the exact k nearest rows that a search finds, over all queries (query, vector).

    One exact search: an exact neighbour in a cell that is read is among the k nearest of what is read, too, so the
    neighbours found are those whose cells are read.
    """
    found = index.search_all(queries, k, None)
    row = found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("near") <= p).alias(f"p{i}") for i, p in enumerate(probes)]).first()
    return [row[f"p{i}"] / row["n"] if row["n"] else 1.0 for i in range(len(probes))]


def recall(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = 0) -> float:
    """The share of the exact k nearest rows that the index finds over all queries (query, vector): one job."""
    return recalls(index, queries, [len(index.centroids) if probes is None else probes or index.probes], k)[0]


def steps(index: VectorIndex) -> list[int]:
    """Numbers of probes, doubled from the least on up to all cells."""
    out = [min(MIN_PROBES, len(index.centroids))]
    while 0 < out[-1] < len(index.centroids):
        out.append(min(len(index.centroids), 2 * out[-1]))
    return out


def enough_probes(index: VectorIndex, queries: DataFrame, k: int = 10, target: float = 0.9) -> int:
    """The fewest probes of these steps whose measured recall reaches the target; all cells if none less does."""
    tried = steps(index)
    return next((p for p, r in zip(tried, recalls(index, queries, tried, k), strict=True) if r >= target), len(index.centroids))
