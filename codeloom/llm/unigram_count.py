"""Token counts of a unigram tokenizer: count-only Viterbi over Aho-Corasick matches.

An Aho-Corasick automaton over the vocabulary lists all pieces that end at each position; a dynamic program
carries, for every position, only the best score and the number of pieces on the best path. Ties follow the
tokenizer's own rule: among equal scores the path found first wins, which is the one whose last piece starts
first; a character that no single-character piece covers may be taken as unknown at (lowest score - 10), after all
pieces that end with it, and counts one piece for each of its UTF-8 bytes.

Where no piece holds a blank behind another character, the best path of a text is made of the best paths of its
words, so each distinct word is solved once while it is in the store. Scores are summed as doubles. Nulls and empty
texts have no tokens; texts of any length are counted whole, repeated rows each for themselves; an empty table gives no
rows, and other columns are never read. The vocabulary is read on the driver, checked against MAX_PIECES, and broadcast.
"""

from __future__ import annotations

import uuid

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_PIECES = 1_000_000
CACHE_WORDS = 150_000
CACHE_WORD_CHARS = 64
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
_NEVER = float("-inf")


def load_pieces(path: str) -> dict[str, float]:
    """piece -> score of the ordinary pieces of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if model.get_piece_size() > MAX_PIECES:
        raise ValueError(f"{path} has more than {MAX_PIECES} pieces")
    special = [model.is_unknown, model.is_control, model.is_byte, model.is_unused]
    return {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)}


class Counter:
    """Best segmentation of texts, as counts."""

    def __init__(self, pieces: dict[str, float]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.singles = {p for p in pieces if len(p) == 1}
        letters = set().union(*pieces)
        apart = all(SPACE not in p.lstrip(SPACE) for p in pieces)
        lone = "" if "\n" in letters else "\n"
        #: what can be solved on its own: a run of blanks with the word behind it, and line ends that no piece holds
        self.cut = regex.compile(rf"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + ("|\n" if lone else "")).findall if apart else lambda text: [text]
        self.store: dict[str, tuple[int, int, float]] = {}
        self.older: dict[str, tuple[int, int, float]] = {}

    def solve(self, word: str) -> tuple[int, int, float]:
        """(pieces, of which bytes of unknown characters, score) of the best path.

        Matches come by their end, for one end the longest (which starts first) before the shorter ones: the order
        in which the tie rule wants them.
        """
        if not self.singles.issuperset(word):
            return self._solve_with_unknown(word)
        n = len(word)
        best, count = [0.0] + [_NEVER] * n, [0] * (n + 1)
        for last, (length, score) in self.automaton.iter(word):
            last += 1
            start = last - length
            total = best[start] + score
            if total > best[last]:
                best[last], count[last] = total, count[start] + 1
        return count[n], 0, best[n]

    def _solve_with_unknown(self, word: str) -> tuple[int, int, float]:
        best, count, byte = [0.0] + [_NEVER] * len(word), [0] * (len(word) + 1), [0] * (len(word) + 1)
        ends: list[list] = [[] for _ in word]
        for last, found in self.automaton.iter(word):
            ends[last].append(found)
        for last, found in enumerate(ends):
            end = last + 1
            for length, score in found:
                total = best[end - length] + score
                if total > best[end]:
                    best[end], count[end], byte[end] = total, count[end - length] + 1, byte[end - length]
            if word[last] not in self.singles:
                total = best[last] + self.unknown
                if total > best[end]:
                    n = len(word[last].encode())
                    best[end], count[end], byte[end] = total, count[last] + n, byte[last] + n
        return count[-1], byte[-1], best[-1]

    def _word(self, word: str) -> tuple[int, int, float]:
        entry = self.store.get(word) or self.older.get(word) or self.solve(word)
        if len(word) <= CACHE_WORD_CHARS:
            if len(self.store) >= CACHE_WORDS:
                self.store, self.older = {}, self.store
            self.store[word] = entry
        return entry

    def count(self, text: str | None) -> tuple[int, int, float]:
        if not text:
            return 0, 0, 0.0
        words = self.cut(SPACE + text.replace(" ", SPACE))
        entries = list(map(self.store.get, words))
        if None in entries:
            for i in [i for i, entry in enumerate(entries) if entry is None]:
                entries[i] = self._word(words[i])
        return sum([e[0] for e in entries]), sum([e[1] for e in entries]), sum([e[2] for e in entries])


_COUNTERS: dict[str, Counter] = {}


def count_column(spark: SparkSession, column: Column, path: str) -> Column:
    """struct(n_tokens, n_byte_tokens, score) of a text column. One pass, no shuffle."""
    shared, key = spark.sparkContext.broadcast(load_pieces(path)), uuid.uuid4().hex

    @F.arrow_udf("struct<n_tokens:bigint,n_byte_tokens:bigint,score:double>")
    def run(texts: pa.Array) -> pa.Array:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(shared.value)
        rows = [_COUNTERS[key].count(t.as_py()) for t in texts]
        n, byte, score = zip(*rows) if rows else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(byte, pa.int64()), pa.array(score, pa.float64())], ["n_tokens", "n_byte_tokens", "score"])

    return run.asNondeterministic()(column)
