"""Small text helpers shared by the operators of this folder (no Spark here)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that separate plain words: blank, \t \n \v \f \r. ``bytes.split()`` cuts at exactly these.
BLANKS = b" \t\n\x0b\x0c\r"

#: Lower-case A-Z; every other ASCII byte that is no digit or letter becomes a blank.
ALNUM_TABLE = bytes(
    (b + 32) if 0x41 <= b <= 0x5A else b if (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256)
)
#: Lower-case A-Z and nothing else.
LOWER_TABLE = bytes((b + 32) if 0x41 <= b <= 0x5A else b for b in range(256))


def texts(column: pa.Array):
    """The UTF-8 bytes of each value (None for null), one at a time, so that a batch is never held twice."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py()


def alnum_words(raw: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return raw.translate(ALNUM_TABLE).split() if raw else []


def word_ids(words: list[bytes]) -> np.ndarray:
    """Dense ids: equal words get equal numbers, in order of first appearance."""
    seen: dict[bytes, int] = {}
    grow = seen.setdefault
    return np.fromiter((grow(w, len(seen)) for w in words), np.int64, len(words))


def window_ids(ids: np.ndarray, width: int) -> np.ndarray:
    """Exact ids of all windows of ``width`` symbols: prefix doubling, so equal ids mean equal windows."""
    if width < 1 or len(ids) < width:
        return np.empty(0, np.int64)
    have, current = 1, ids
    while have < width:
        step = min(have, width - have)
        left, right = current[: len(current) - step], current[step:]
        if not len(left):
            return np.empty(0, np.int64)
        pairs = left * (int(right.max()) + 1) + right
        current = np.unique(pairs, return_inverse=True)[1]
        have += step
    return current


def fresh(name: str, df) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def rows_of(batches):
    """The rows of Arrow batches as tuples, one batch alive at a time."""
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


def batched(rows, schema: pa.Schema, max_rows: int = 5_000, max_bytes: int = 16 << 20):
    """Arrow batches of tuples, cut by their number and by the bytes of their texts."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= max_rows or size >= max_bytes:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
