"""Quality rules as a short-circuit cascade.

Every rule is a cheap test that may reject a document. A sample tells what each rule costs and how often it
rejects; the cascade then runs the rules in falling order of rejections per second and stops at the first that
rejects. The order only changes the work: the verdict is the same for every order, because a document is kept
only if no rule rejects it.

Nulls, empty and blank texts have no words and fail the base rule ``too_few_words``. Texts of any length are measured
whole, repeated rows each for themselves, and an empty table gives no rows. Ties in rejections per second are broken by
the rule's name. Columns of the input whose names clash with an output column are replaced by ``score``; ``keep``
returns the input's columns, whatever they are called.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import BLANKS, fresh, word_ids, window_ids

#: Rows, about, on which cost and selectivity are estimated. The verdict doesn't depend on them.
SAMPLE_ROWS = 2_000
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(0x41, 0x5B))
_LETTERS = _UPPER + bytes(range(0x61, 0x7B))


class Doc:
    """One text whose measures are worked out on first use and then kept."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    def __getattr__(self, name: str):
        value = MEASURES[name](self)
        setattr(self, name, value)
        return value


def _word_chars(doc: Doc) -> int:
    continuation = len(doc.raw) - len(doc.raw.translate(None, bytes(range(0x80, 0xC0))))
    return sum(map(len, doc.words)) - continuation


def _n_repeat_words(doc: Doc) -> int:
    import numpy as np

    windows = window_ids(word_ids(doc.words), WINDOW)
    if not len(windows):
        return 0
    starts = np.flatnonzero(np.bincount(windows)[windows] > 1)
    edges = np.zeros(len(doc.words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges) > 0).sum())


def _n_dup_lines(doc: Doc) -> int:
    return len(doc.lines) - len(set(doc.lines))


MEASURES: dict[str, Callable[[Doc], object]] = {
    "words": lambda d: d.raw.split(),
    "lines": lambda d: [x for x in d.raw.split(b"\n") if x.strip(BLANKS)],
    "n_words": lambda d: len(d.words),
    "word_chars": _word_chars,
    "n_symbols": lambda d: len(d.raw) - len(d.raw.translate(None, SYMBOLS)),
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
    "n_letters": lambda d: len(d.raw) - len(d.raw.translate(None, _LETTERS)),
    "n_upper": lambda d: len(d.raw) - len(d.raw.translate(None, _UPPER)),
    "n_stutters": lambda d: sum(map(bytes.__eq__, d.words, d.words[1:])),
}

#: name -> True if the document is rejected. Whole numbers only, so that any engine agrees on the verdict.
BASE_RULES: dict[str, Callable[[Doc], bool]] = {
    "too_few_words": lambda d: d.n_words < MIN_WORDS,
    "repeated_windows": lambda d: 100 * d.n_repeat_words > MAX_REPEAT_PERCENT * d.n_words,
}
MORE_RULES: dict[str, Callable[[Doc], bool]] = {
    "symbols": lambda d: 4 * d.n_symbols > d.n_words,
    "shouting": lambda d: 10 * d.n_upper > 4 * d.n_letters,
    "stutter": lambda d: 5 * d.n_stutters > d.n_words,
    "duplicate_lines": lambda d: 2 * d.n_dup_lines > len(d.lines),
    "word_length": lambda d: d.word_chars > 15 * d.n_words or d.word_chars < 2 * d.n_words,
}
RULES = BASE_RULES | MORE_RULES
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def estimate(df: DataFrame, text: str = "text", rules: dict | None = None, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds per document, share rejected) of each rule, each timed alone on fresh documents."""
    names = list(rules or RULES)
    total = df.count()
    if not total:
        return [(n, 0.0, 0.0) for n in names]
    sample = df.select(F.col(text).alias("t")).sample(False, min(1.0, 1.5 * sample_rows / total), 17)
    table = rules or RULES

    def measure(batches):
        for batch in batches:
            raws = [v.as_py() for v in batch.column(0).cast(pa.large_binary())]
            spent, rejected = [], []
            for name in names:
                rule, began = table[name], time.perf_counter()
                rejected.append(sum(bool(rule(Doc(r))) for r in raws))
                spent.append(time.perf_counter() - began)
            yield pa.RecordBatch.from_pydict({"rule": names, "s": spent, "hits": rejected, "docs": [len(raws)] * len(names)}, schema=schema)

    schema = pa.schema([("rule", pa.string()), ("s", pa.float64()), ("hits", pa.int64()), ("docs", pa.int64())])
    rows = sample.mapInArrow(measure, "rule string, s double, hits long, docs long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("docs").alias("docs")).collect()
    found = {r["rule"]: (r["s"] / max(1, r["docs"]), r["hits"] / max(1, r["docs"])) for r in rows}
    return [(n, *found.get(n, (0.0, 0.0))) for n in names]


def order(estimates: list[tuple[str, float, float]]) -> list[str]:
    """Rules in falling order of rejections per second."""
    return [n for n, cost, share in sorted(estimates, key=lambda e: (-(e[2] / (e[1] + 1e-9)), e[1], e[0]))]


def cascade_column(column: Column, sequence: list[str], measures: tuple[str, ...] = DIGEST, rules: dict | None = None) -> Column:
    """A struct: the measures asked for, base_failed, kept. Measures that no rule needed are worked out last."""
    table, base = rules or RULES, [r for r in sequence if r in BASE_RULES]

    @F.arrow_udf("struct<" + "".join(f"{m}:bigint," for m in measures) + "base_failed:boolean,kept:boolean>")
    def run(texts: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in measures]
        failed, kept = [], []
        for value in texts.cast(pa.large_binary()):
            doc = Doc(value.as_py())
            verdict = not any(table[r](doc) for r in sequence)
            failed.append(not verdict and any(table[r](doc) for r in base))
            kept.append(verdict)
            for values, name in zip(out, measures):
                values.append(getattr(doc, name))
        arrays = [pa.array(v, pa.int64()) for v in out] + [pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
        return pa.StructArray.from_arrays(arrays, [*measures, "base_failed", "kept"])

    return run.asNondeterministic()(column)


def score(df: DataFrame, text: str = "text", measures: tuple[str, ...] = DIGEST, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """df with the measures, base_failed and kept. One scan for the sample, one for the cascade, no shuffle."""
    sequence = order(estimate(df, text, sample_rows=sample_rows))
    outputs = [*measures, "base_failed", "kept"]
    held = [c for c in df.columns if c not in outputs]
    name = fresh("cascade", df)
    scored = df.select(*held, cascade_column(F.col(text), sequence, measures).alias(name))
    return scored.select(*held, *(F.col(f"{name}.{c}").alias(c) for c in outputs))


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with the columns of df."""
    sequence = order(estimate(df, text))
    name = fresh("cascade", df)
    return df.withColumn(name, cascade_column(F.col(text), sequence, ())).where(F.col(f"{name}.kept")).select(*df.columns)
