"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can come last in the BPE encoding of that prefix. The
encoder stores that token for each prefix length: token ``t`` is last at ``end`` if the last token before ``t``
and ``t`` are the encoding of their own joined bytes. Because each entry only depends on shorter prefixes, text
can be appended by going on from the stored entries (``Prefixes.append``), and an edit only throws away the
entries until they agree with the old ones again (``Prefixes.replace``). Reading the entries backwards gives the ids.
``TextPrefixes`` does the same for a whole text: an edit re-cuts the pieces around it until a cut falls on an old one.

A piece is one match of the tokenizer's pattern; pieces are encoded apart, and no special tokens exist. Nulls
and empty texts have no tokens; texts of any length are encoded whole, repeated rows each for themselves; an empty
table gives no rows, and other columns are never read. The vocabulary is read once on the driver and broadcast; its size is checked
against MAX_RANK_BYTES, a bound that doesn't depend on the data.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_RANK_BYTES = 64 << 20
#: What a worker keeps of pieces, prefixes and token pairs; a full store starts anew. It only bounds memory.
CACHE_PIECES = 400_000
CACHE_PIECE_BYTES = 48
CACHE_PREFIXES = 900_000
CACHE_PAIRS = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank (the id) of a tiktoken vocabulary file."""
    with open(path, "rb") as file:
        data = file.read(MAX_RANK_BYTES + 1)
    if len(data) > MAX_RANK_BYTES:
        raise ValueError(f"{path} holds more than {MAX_RANK_BYTES} bytes")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Bpe:
    """Encoder and decoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], prefixes: int = CACHE_PREFIXES):
        self.ranks, self.max_prefixes = ranks, prefixes
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.prefixes: dict[bytes, int] = {}
        self.names = {rank: b"%d" % rank for rank in ranks.values()}
        self.longest = max(map(len, ranks), default=1)
        #: tokens read backwards as a tree: byte -> [branch, the token that ends here or None]
        self.endings: dict[int, list] = {}
        for token, rank in ranks.items():
            if len(token) == 1 or self.split(rank):
                branch, node = self.endings, None
                for byte in reversed(token):
                    node = branch.setdefault(byte, [{}, None])
                    branch = node[0]
                node[1] = rank

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a token that no merge makes (a single byte)."""
        if token not in self.parts:
            self.parts[token] = self._split(self.tokens[token], token)
        return self.parts[token]

    def _split(self, raw: bytes, rank: int) -> tuple[int, int] | None:
        pieces = [raw[i : i + 1] for i in range(len(raw))]
        while len(pieces) > 2:
            merges = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:]))]
            best, at = min(merges)
            if best >= rank:
                return None
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return (self.ranks[pieces[0]], self.ranks[pieces[1]]) if len(pieces) == 2 else None

    def valid_pair(self, left: int, right: int) -> bool:
        """True if the bytes of the two tokens, joined, encode to just these two tokens.

        It takes the two apart step by step. A merge across the border happens before the ranks so far are
        reached if the border's bytes have a lower rank than the merges that built either side.
        """
        key = left << 24 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._valid_pair(left, right)
        return known

    def _valid_pair(self, left: int, right: int) -> bool:
        limit, a, b = float("inf"), left, right
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < limit:
                return False
            split_a, split_b = self.split(a), self.split(b)
            if split_a is None and split_b is None:
                return True
            # Undo the later of the two merges. On equal ranks the left text merged first, so the right goes first.
            if split_b is None or split_a is not None and a > b:
                limit, a = a, split_a[1]
            else:
                limit, b = b + 1, split_b[0]

    def ending_tokens(self, raw: bytes, end: int) -> list[tuple[int, int]]:
        """(begin, token) of all tokens that end there, shortest first; only the whole prefix if it is a token."""
        branch, begin, found = self.endings, end, []
        while begin:
            begin -= 1
            node = branch.get(raw[begin])
            if node is None:
                break
            branch, token = node
            if token is not None:
                if not begin:
                    return [(0, token)]
                found.append((begin, token))
        return found

    def last_token(self, raw: bytes, end: int) -> int:
        """The last token of raw[:end], from the shared entries; entries that it depends on are made on the way."""
        prefix = raw[:end]
        token = self.prefixes.get(prefix)
        if token is None:
            pairs = self.pairs
            for begin, token in reversed(self.ending_tokens(raw, end)):
                if not begin:
                    break
                left = self.last_token(raw, begin)
                valid = pairs.get(left << 24 | token)
                if valid or valid is None and self.valid_pair(left, token):
                    break
            else:
                raise ValueError("the vocabulary is no BPE vocabulary over all bytes")
            self.prefixes[prefix] = token
        return token

    def encode_piece(self, raw: bytes) -> list[int]:
        """Ids of one piece. The entries of short pieces' prefixes are shared by all pieces that begin alike."""
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        end = len(raw)
        if end > CACHE_PIECE_BYTES:
            return Prefixes(self).append(raw).ids()
        if len(self.prefixes) >= self.max_prefixes:
            self.prefixes.clear()
        out, tokens = [], self.tokens
        while end:
            token = self.last_token(raw, end)
            out.append(token)
            end -= len(tokens[token])
        out.reverse()
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The last token of each prefix of one piece, kept for appends and edits."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.raw, self.last = bpe, b"", [-1]
        #: Entries that the last change made anew.
        self.made = 0

    def _entry(self, end: int) -> int:
        bpe, last = self.bpe, self.last
        self.made += 1
        return next(token for begin, token in reversed(bpe.ending_tokens(self.raw, end)) if not begin or bpe.valid_pair(last[begin], token))

    def append(self, more: bytes) -> Prefixes:
        start, self.raw, self.made = len(self.raw), self.raw + more, 0
        for end in range(start + 1, len(self.raw) + 1):
            self.last.append(self._entry(end))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> Prefixes:
        """Put other bytes in the place of raw[start:stop]; entries before them stay, and so do those behind from where on they agree.

        An entry depends on the bytes of one token's length before it and on the entries there. So once as many entries
        in a row as the longest token has bytes equal the old ones, with no changed byte among theirs, all later ones do.
        """
        old, self.made = self.last, 0
        behind = old[stop + 1 :]
        self.raw = self.raw[:start] + new + self.raw[stop:]
        self.last = old[: start + 1]
        first, equal = start + len(new) + 1, 0
        for end in range(start + 1, len(self.raw) + 1):
            token = self._entry(end)
            self.last.append(token)
            equal = equal + 1 if end >= first and behind[end - first] == token else 0
            if equal >= self.bpe.longest and end - start - len(new) >= self.bpe.longest:
                self.last += behind[end - first + 1 :]
                break
        return self

    def replace_tail(self, keep: int, tail: bytes) -> Prefixes:
        """Keep the first bytes and their entries; encode the new tail behind them."""
        return self.replace(keep, len(self.raw), tail)

    def ids(self) -> list[int]:
        out, end = [], len(self.raw)
        while end:
            out.append(self.last[end])
            end -= len(self.bpe.tokens[self.last[end]])
        return out[::-1]


class TextPrefixes:
    """A whole text's pieces with their prefixes, kept for appends and edits anywhere."""

    def __init__(self, bpe: Bpe, pattern: str, text: str = ""):
        self.bpe, self.match = bpe, regex.compile(pattern).match
        self.text, self.cuts, self.pieces = "", [0], []
        #: Pieces that the last change encoded anew.
        self.made = 0
        self.replace(0, 0, text)

    def append(self, more: str) -> TextPrefixes:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> TextPrefixes:
        """Put another text in the place of text[start:stop].

        What a piece ends with depends on the characters up to the end of the white space behind it, so pieces that
        end before the white space in front of the edit stay. Behind the edit, cutting only looks forwards: from the
        first cut on that an old one falls on, everything is as it was.
        """
        near = start
        while near and self.text[near - 1].isspace():
            near -= 1
        keep = max(0, bisect_left(self.cuts, near) - 1)
        grown = len(new) - (stop - start)
        self.text = self.text[:start] + new + self.text[stop:]
        at, cuts, pieces = self.cuts[keep], self.cuts[: keep + 1], self.pieces[:keep]
        self.made, end = 0, len(self.text)
        while at < end:
            if at >= start + len(new):
                old = bisect_left(self.cuts, at - grown)
                if old < len(self.cuts) and self.cuts[old] == at - grown:
                    cuts += [c + grown for c in self.cuts[old + 1 :]]
                    pieces += self.pieces[old:]
                    break
            found = self.match(self.text, at)
            stretch = found.end() if found and found.end() > at else at + 1
            # characters that no match of the pattern takes are no tokens, as in findall
            pieces.append(Prefixes(self.bpe).append(self.text[at:stretch].encode()) if found and found.end() > at else Prefixes(self.bpe))
            at = stretch
            cuts.append(at)
            self.made += 1
        self.cuts, self.pieces = cuts, pieces
        return self

    def ids(self) -> list[int]:
        return [i for piece in self.pieces for i in piece.ids()]


class TextCoder:
    """Whole texts: pieces by pattern, each distinct piece encoded and decoded once while it is in the store."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, pieces: int = CACHE_PIECES, prefixes: int = CACHE_PREFIXES):
        self.bpe, self.find, self.pieces = Bpe(ranks, prefixes), regex.compile(pattern).findall, pieces
        self.store: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def piece(self, text: str) -> tuple[bytes, bytes]:
        """(ids as text, decoded bytes)"""
        entry = self.older.get(text)
        if entry is None:
            ids, names, tokens = self.bpe.encode_piece(text.encode()), self.bpe.names, self.bpe.tokens
            entry = (b",".join([names[i] for i in ids]), b"".join([tokens[i] for i in ids]))
        if len(text) <= CACHE_PIECE_BYTES:
            if len(self.store) >= self.pieces:
                self.store, self.older = {}, self.store
            self.store[text] = entry
        return entry

    def entries(self, text: str) -> list[tuple[bytes, bytes]]:
        found = self.find(text)
        out = list(map(self.store.get, found))
        if None in out:
            for i in [i for i, entry in enumerate(out) if entry is None]:
                out[i] = self.store.get(found[i]) or self.piece(found[i])
        return out

    def ids(self, text: str | None) -> np.ndarray:
        entries = self.entries(text) if text else []
        return _numbers(b",".join([e[0] for e in entries]))

    def digest(self, text: str | None) -> tuple[int, str, str, bytes]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded bytes, the ids as text)"""
        if not text:
            return 0, _EMPTY, _EMPTY, b""
        entries = self.entries(text)
        ids, decoded = b",".join([e[0] for e in entries]), b"".join([e[1] for e in entries])
        return ids.count(b",") + 1, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids


def _numbers(ids: bytes) -> np.ndarray:
    return np.array(ids.split(b","), np.int32) if ids else np.empty(0, np.int32)


_EMPTY = hashlib.sha256(b"").hexdigest()
_CODERS: dict[str, TextCoder] = {}


def _coder(key: str, shared, pattern: str, pieces: int) -> TextCoder:
    """One coder for each worker process, whatever number of tasks it runs."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = TextCoder(shared.value, pattern, pieces, 2 * pieces)
    return _CODERS[key]


def digest_column(spark: SparkSession, column: Column, path: str, pattern: str, with_ids: bool = False, pieces: int = CACHE_PIECES) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, ids]) of a text column. One pass, no shuffle."""
    shared, key = spark.sparkContext.broadcast(load_ranks(path)), uuid.uuid4().hex

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string" + (",ids:array<int>" if with_ids else "") + ">")
    def run(texts: pa.Array) -> pa.Array:
        coder = _coder(key, shared, pattern, pieces)
        counts, ids, decoded, lists = [], [], [], []
        for value in texts:
            text = value.as_py()
            n, a, b, joined = coder.digest(text)
            counts.append(n)
            ids.append(a)
            decoded.append(b)
            if with_ids:
                lists.append(_numbers(joined))
        arrays = [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
        names = ["n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays.append(pa.array(lists, pa.list_(pa.int32())))
            names.append("ids")
        return pa.StructArray.from_arrays(arrays, names)

    return run.asNondeterministic()(column)
