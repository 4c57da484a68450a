"""Quality classifier by co-training of two views.

One view sees the text (how classes of characters follow each other, how words repeat), the other only the page's
metadata (language, source, length). Both are logistic regressions, fitted on the driver on a bounded sample of
labelled rows (MAX_LABELLED). In each round both views score every unlabelled text that they haven't handed over yet;
those that one view is surest about become pseudo-labels for the other view: for each class PER_ROUND or the square
root of the unlabelled texts, whichever is more, copies counted once and from one metadata profile
no more than a SPREAD-th while others are sure too. At the end each view's score
is calibrated on labelled rows that no round has seen, and the calibrated views are combined, as independent
evidence, into the score of every document.

The pseudo-label search covers all documents in every round; only the chosen rows (4 * the number above) reach the driver.
Ties are broken by a hash of the features and then by doc_id, so a rerun gives the same scores. Null texts and null
metadata are views without content and are scored like any other, empty texts likewise, and texts of any length are
read whole. Repeated rows are scored row by row; of rows with one labelled doc_id the one with the smallest text view
is fitted on, so no label brings more than one row to the driver. Columns of other names are kept whatever they are
called. An empty table gives no rows. Without labels of both classes every document gets the share of good labels (1.0
without labels) and is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .textops import fresh

#: Labelled rows, at most, that are used to fit and to calibrate; chosen by a hash of doc_id.
MAX_LABELLED = 8_000
ROUNDS = 3
#: Pseudo-labels that each view hands over, for each class and round, at least.
PER_ROUND = 100
#: Profiles over which they are spread.
SPREAD = 10
#: A document is rejected below this score. It leans to keeping: a doubtful document stays.
THRESHOLD = 0.2
HOLD_OUT = 4  # every fourth labelled row calibrates

_CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t\x0b\x0c", b".,;:'\"-()?", b"!", b"|", b"#$%&*<>")
_K = len(_CLASSES) + 2


def _class_table() -> bytes:
    table = bytearray([len(_CLASSES)] * 128 + [len(_CLASSES) + 1] * 128)
    for number, members in enumerate(_CLASSES):
        for byte in members:
            table[byte] = number
    return bytes(table)


_TABLE = _class_table()
N_TEXT = _K * _K + 4
_LANGS, _SOURCES, _LENGTHS = 8, 16, 20
N_META = _LANGS + _SOURCES + _LENGTHS


def text_view(raw: bytes | None) -> np.ndarray:
    """Square roots of the shares of class pairs, and four word ratios."""
    out = np.zeros(N_TEXT, np.float16)
    if not raw:
        return out
    codes = np.frombuffer(raw.translate(_TABLE), np.uint8)
    if len(codes) > 1:
        out[: _K * _K] = np.sqrt(np.bincount(codes[:-1] * np.uint8(_K) + codes[1:], minlength=_K * _K) / (len(codes) - 1))
    words = raw.split()
    n = max(1, len(words))
    out[-4:] = (len(set(words)) / n) ** 0.5, sum(map(bytes.__eq__, words, words[1:])) / n, min(1.0, len(raw) / n / 20), min(1.0, n / 20)
    return out


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(N_META, np.float32)
    out[xxhash.xxh32_intdigest((lang or "").encode()) % _LANGS] = 1
    out[_LANGS + xxhash.xxh32_intdigest((source or "").encode()) % _SOURCES] = 1
    out[_LANGS + _SOURCES + min(_LENGTHS - 1, int(np.log2(1 + max(0, n_chars or 0))))] = 1
    return out


@dataclass
class Logistic:
    """Standardised ridge logistic regression with a calibrated logit."""

    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x.astype(np.float64) - self.mean) / self.scale
        return self.slope * (z @ self.weights[:-1] + self.weights[-1]) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 5.0) -> Logistic:
    x = x.astype(np.float64)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    return Logistic(_newton((x - mean) / scale, y, ridge), mean, scale)


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on held-out rows, with smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    soft = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, shift = _newton(model.logit(x)[:, None], soft, 1e-3)
    model.slope, model.shift = float(max(slope, 0.0)), float(shift)


@dataclass
class CoTrained:
    text: Logistic | None
    meta: Logistic | None
    prior: float

    def parts(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text score, metadata score, combined score), rounded so that a last bit never decides."""
        if self.text is None:
            flat = np.full(len(text), round(self.prior, 6))
            return flat, flat, flat
        a, b = self.text.logit(text), self.meta.logit(meta)
        both = a + b - np.log(self.prior / (1 - self.prior))
        return tuple(np.round(1 / (1 + np.exp(-np.clip(v, -40, 40))), 6) for v in (a, b, both))


def _meta_matrix(lang, source, n_chars) -> np.ndarray:
    return np.array([meta_view(*row) for row in zip(lang.to_pylist(), source.to_pylist(), n_chars.to_pylist())], np.float32).reshape(-1, N_META)


def _text_matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs.to_pylist()), np.float16).reshape(-1, N_TEXT)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_chars, view): the text view of every document as packed numbers, stored once."""

    @F.arrow_udf("binary")
    def view(texts: pa.Array) -> pa.Array:
        return pa.array([text_view(t.as_py()).tobytes() for t in texts.cast(pa.large_binary())], pa.binary())

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), view.asNondeterministic()("text").alias("view")), "quality-features")


def _profile(meta: np.ndarray) -> np.ndarray:
    """The metadata profile as a number: its three one-hot positions."""
    lang, source, length = meta[:, :_LANGS], meta[:, _LANGS : _LANGS + _SOURCES], meta[:, _LANGS + _SOURCES :]
    return (lang.argmax(1) * _SOURCES + source.argmax(1)) * _LENGTHS + length.argmax(1)


def _top(sure: np.ndarray, ties: np.ndarray, profiles: np.ndarray, quota: int, n: int) -> np.ndarray:
    """Positions of the n surest of at most quota a profile, and of the n surest of all, which fill up where those are
    too few; a choice of pieces that is cut again when they are put together loses none of the whole's."""
    order = np.lexsort((ties, -sure))
    by_profile = order[np.argsort(profiles[order], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(profiles[by_profile]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.empty(len(order), np.int64)
    rank[by_profile] = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    spread = order[rank[order] < quota][:n]
    return np.concatenate([spread, np.setdiff1d(order[:n], spread)])


def _candidates(rows: DataFrame) -> DataFrame:
    """One row for each text view: copies are one candidate."""
    first = F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("r")
    return rows.groupBy("view").agg(first).select("r.*", "view")


def _best(table: DataFrame, text: Logistic, meta: Logistic, per_round: int, quota: int, taken: tuple[np.ndarray, np.ndarray]) -> list:
    """The rows that each view is surest about: per_round for each view and class, over all rows not taken (ties)."""
    columns = [("view_no", pa.int32()), ("class", pa.int32()), ("profile", pa.int64()), ("sure", pa.float64()), ("tie", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("view", pa.binary())]
    ddl = "view_no int, class int, profile bigint, sure double, tie bigint, lang string, source string, n_chars bigint, view binary"
    schema = pa.schema(columns)

    def run(batches):
        kept: dict[tuple[int, int], pa.Table] = {}
        for batch in batches:
            lang, source, n_chars, blobs = batch.columns
            metas = _meta_matrix(lang, source, n_chars)
            profiles = _profile(metas)
            ties = np.array([xxhash.xxh64_intdigest(b) >> 1 for b in blobs.to_pylist()], np.int64)
            for number, logits in enumerate((text.logit(_text_matrix(blobs)), meta.logit(metas))):
                logits, fresh = np.round(logits, 6), ~np.isin(ties, taken[number])
                for label in (0, 1):
                    sure = logits if label else -logits
                    at = np.flatnonzero(fresh & (sure > 0))
                    at = at[_top(sure[at], ties[at], profiles[at], quota, per_round)]
                    mine = pa.array(at)
                    new = pa.Table.from_arrays([pa.array(np.full(len(at), number), pa.int32()), pa.array(np.full(len(at), label), pa.int32()), pa.array(profiles[at], pa.int64()), pa.array(sure[at]), pa.array(ties[at]), *(c.take(mine) for c in (lang, source, n_chars, blobs))], schema=schema)
                    both = pa.concat_tables([kept[number, label], new]) if (number, label) in kept else new
                    best = _top(both["sure"].to_numpy(), both["tie"].to_numpy(), both["profile"].to_numpy(), quota, per_round)
                    kept[number, label] = both.take(pa.array(best)).combine_chunks()
        for part in kept.values():
            yield from part.to_batches(10_000)

    spread = Window.partitionBy("view_no", "class", "profile").orderBy(F.desc("sure"), "tie")
    best = Window.partitionBy("view_no", "class").orderBy(F.col("place") > quota, F.desc("sure"), "tie")
    found = table.select("lang", "source", "n_chars", "view").mapInArrow(run, ddl).withColumn("place", F.row_number().over(spread))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_round).orderBy("view_no", "class", "rank").collect()


def train(docs_features: DataFrame, labels: DataFrame, target: str = "quality", rounds: int = ROUNDS, per_round: int = PER_ROUND, max_labelled: int = MAX_LABELLED) -> CoTrained:
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).dropDuplicates(["doc_id"])
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    held_rows = docs_features.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("view", "lang", "source", "n_chars")).alias("r"))
    chosen = held_rows.select("doc_id", "y", "r.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # at most max_labelled rows
    y = np.array([r["y"] for r in chosen], float)
    if len(y) < 8 or y.min() == y.max():
        return CoTrained(None, None, float(y.mean()) if len(y) else 1.0)
    text = np.array([np.frombuffer(r["view"], np.float16) for r in chosen])
    meta = np.array([meta_view(r["lang"], r["source"], r["n_chars"]) for r in chosen])
    held = np.arange(len(y)) % HOLD_OUT == 0
    if y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held = np.zeros(len(y), bool)
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    sets = [(text[~held], y[~held]), (meta[~held], y[~held])]
    # rows with a label are no candidates; of the rest, each text may be handed over once by each view
    unlabelled = docs_features.join(known.select("doc_id"), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars", "view")
    open_rows = stored(_candidates(unlabelled), "unlabelled-features")
    per_round = max(per_round, math.isqrt(open_rows.count()))
    taken: list[list[int]] = [[], []]
    profiles = open_rows.select("lang", "source", F.floor(F.log2(F.greatest(F.lit(0), F.coalesce("n_chars", F.lit(0))) + 1))).distinct().limit(SPREAD).count()
    quota = -(-per_round // max(1, profiles))
    models = [fit(*s) for s in sets]
    for _ in range(rounds):
        fresh: list[list] = [[], []]
        for r in _best(open_rows, models[0], models[1], per_round, quota, tuple(np.array(t, np.int64) for t in taken)):
            taken[r["view_no"]].append(r["tie"])
            other = 1 - r["view_no"]
            row = np.frombuffer(r["view"], np.float16) if other == 0 else meta_view(r["lang"], r["source"], r["n_chars"])
            fresh[other].append((row, r["class"]))
        if not any(fresh):
            break
        sets = [(np.vstack([x, *[[row] for row, _ in new]]), np.concatenate([t, [label for _, label in new]])) if new else (x, t) for (x, t), new in zip(sets, fresh)]
        models = [fit(*s) for s in sets]
    on = held if held.any() else np.ones(len(y), bool)
    calibrate(models[0], text[on], y[on])
    calibrate(models[1], meta[on], y[on])
    return CoTrained(models[0], models[1], prior)


_SCORES = "struct<text_score:double,meta_score:double,score:double>"


def _scores(parts) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(p) for p in parts], ["text_score", "meta_score", "score"])


def score_features(table: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every row of features()."""

    @F.arrow_udf(_SCORES)
    def run(view: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        return _scores(model.parts(_text_matrix(view), _meta_matrix(lang, source, n_chars)))

    scored = table.select("doc_id", run.asNondeterministic()("view", "lang", "source", "n_chars").alias("s"))
    return scored.select("doc_id", "s.*", (F.col("s.score") >= threshold).alias("keep"))


def score_column(model: CoTrained) -> Column:
    """The scores straight from a documents table, without a join."""

    @F.arrow_udf(_SCORES)
    def run(texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        views = np.array([text_view(t.as_py()) for t in texts.cast(pa.large_binary())], np.float16).reshape(-1, N_TEXT)
        return _scores(model.parts(views, _meta_matrix(lang, source, n_chars)))

    return run.asNondeterministic()("text", "lang", "source", F.col("n_chars").cast("long"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) of every document."""
    table = features(docs)
    return score_features(table, train(table, labels, **options))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents with a score of at least the threshold, with the columns of docs. No shuffle of the texts."""
    model = train(features(docs), labels, **options)
    name = fresh("scores", docs)
    return docs.withColumn(name, score_column(model)).where(F.col(f"{name}.score") >= threshold).select(*docs.columns)
