"""Licence notices in texts: exact base phrases, and short notices with a bounded number of edits.

A text is reduced to its words (A-Z lower-cased) joined by one blank. A notice of m characters may be misspelt by
k = max(1, m // CHARS_PER_EDIT) single-character edits. Cut into k + 1 pieces, a notice with at most k edits keeps
one piece whole; an Aho-Corasick automaton over all pieces finds these seeds in one pass. A seed allows an occurrence
to start at the words within k characters of where it points; from each such word the regex library's fuzzy matching
verifies the notice with rising bounds up to k, so the first match has the fewest edits. An occurrence begins and ends
with a word. Of overlapping occurrences of one notice those with fewer edits stay, then those that start first. What a
stretch of text gave is kept in a bounded store, so a repeated notice costs one verification: the work is linear.

Nulls, empty texts and texts without words have no places, no labels and score 0; texts of any length are searched
whole, repeated rows are rows of their own, an empty table gives no rows, and columns of the input that clash with an
output column are replaced. Base phrases count every place, overlaps included. score: 1 for a base phrase, else
1 - edits / m of the best notice, else 0.
"""

from __future__ import annotations

from bisect import bisect_left

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import alnum_words

#: Phrase -> label of the base scan.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices of public licences -> label of the fuzzy search.
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "under the terms of the gnu general public license": "gpl",
    "you should have received a copy of the gnu general public license": "gpl",
    "spdx license identifier gpl": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "spdx license identifier lgpl": "lgpl",
    "gnu affero general public license": "agpl",
    "spdx license identifier agpl": "agpl",
    "gnu free documentation license": "gfdl",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "www apache org licenses license": "apache",
    "spdx license identifier apache": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "spdx license identifier mit": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "spdx license identifier isc": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "redistributions of source code must retain the above copyright notice": "bsd",
    "licensed under the bsd license": "bsd",
    "spdx license identifier bsd": "bsd",
    "licensed under cc by 4 0": "cc-by",
    "creative commons attribution": "cc-by",
    "creativecommons org licenses by 4 0": "cc-by",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "creative commons attribution sharealike": "cc-by-sa",
    "creativecommons org licenses by sa": "cc-by-sa",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creativecommons org licenses by nc": "cc-by-nc",
    "creative commons attribution noderivs": "cc-by-nd",
    "creativecommons org licenses by nd": "cc-by-nd",
    "creativecommons org publicdomain zero": "cc0",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "boost software license": "boost",
    "academic free license": "afl",
    "open software license": "osl",
    "microsoft public license": "ms-pl",
    "python software foundation license": "psf",
    "sil open font license": "ofl",
    "open database license": "odbl",
    "server side public license": "sspl",
    "business source license": "busl",
    "do what the fuck you want to public license": "wtfpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "released into the public domain": "public-domain",
    "this software is provided as is without any express or implied warranty": "zlib",
    "all rights reserved": "all-rights-reserved",
}
CHARS_PER_EDIT = 14
#: Verified stretches that a worker keeps; a full store starts anew. It only bounds memory.
KEPT_STRETCHES = 50_000


class NoticeSearch:
    """Seeds and verifiers of a set of notices."""

    def __init__(self, notices: dict[str, str] | None = None, base: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT):
        self.base = {f" {phrase} ": label for phrase, label in (BASE if base is None else base).items()}
        self.notices = list((NOTICES if notices is None else notices).items())
        self.edits = [max(1, len(n) // chars_per_edit) for n, _ in self.notices]
        self.verify = [[regex.compile(rf"(?:{regex.escape(n)}){{e<={e}}}(?= |\Z)") for e in range(1, k + 1)] for (n, _), k in zip(self.notices, self.edits)]
        self.seen: dict[tuple[int, str], tuple[int, int] | None] = {}
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, ((notice, _), k) in enumerate(zip(self.notices, self.edits)):
            cuts = [len(notice) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(notice[a:b], []).append((number, a))
        for piece, where in places.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def starts(self, words: str) -> dict[int, set[int]]:
        """Per notice, the word starts at which a seed allows an occurrence."""
        found: dict[int, set[int]] = {}
        for last, (length, where) in self.seeds.iter(words):
            for number, offset in where:
                begin, k = last - length + 1 - offset, self.edits[number]
                at, places = max(0, begin - k), found.setdefault(number, set())
                if at == 0:
                    places.add(0)
                at = words.find(" ", max(0, at - 1), begin + k)
                while at >= 0:
                    places.add(at + 1)
                    at = words.find(" ", at + 1, begin + k)
        return found

    def occurrence(self, number: int, words: str, start: int) -> tuple[int, int] | None:
        """(end, edits) of the notice at a word start, with the fewest edits possible."""
        notice, k = self.notices[number][0], self.edits[number]
        end = start + len(notice)
        if words.startswith(notice, start) and (end == len(words) or words[end] == " "):
            return end, 0
        stretch = words[start : end + k + 1]
        key = number, stretch
        if key not in self.seen:
            if len(self.seen) >= KEPT_STRETCHES:
                self.seen.clear()
            tried = (pattern.match(stretch) for pattern in self.verify[number])
            # a blank behind the last character allowed tells a word's end from a cut
            self.seen[key] = next(((m.end(), sum(m.fuzzy_counts)) for m in tried if m and m.end() <= len(notice) + k), None)
        found = self.seen[key]
        return found and (start + found[0], found[1])

    def fuzzy(self, words: str) -> list[tuple[str, str, int, int, int]]:
        """(notice, label, start, end, edits) in the joined words; occurrences of one notice don't overlap."""
        out = []
        for number, places in self.starts(words).items():
            notice, label = self.notices[number]
            hits = [(edits, start, end) for start in places for end, edits in [self.occurrence(number, words, start) or (0, -1)] if edits >= 0]
            taken: list[tuple[int, int]] = []
            for edits, start, end in sorted(hits):
                at = bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (start, end))
                    out.append((notice, label, start, end, edits))
        return sorted(out, key=lambda m: (m[2], m[3], m[0]))

    def scan(self, raw: bytes | None) -> dict:
        listed = alnum_words(raw)
        words = b" ".join(listed).decode("utf-8", "replace")
        padded, places, base = f" {words} ", [], set()
        for phrase, label in self.base.items():
            at, seen, number = padded.find(phrase), 0, 0
            while at >= 0:
                number += padded.count(" ", seen, at)
                seen = at
                places.append(number)
                base.add(label)
                at = padded.find(phrase, at + 1)
        spans = self.fuzzy(words) if listed else []
        near = max((1 - edits / len(notice) for notice, _, _, _, edits in spans), default=0.0)
        return {
            "n_words": len(listed),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(base | {s[1] for s in spans})),
            "score": 1.0 if places else round(near, 6),
            "spans": self._by_word(words, spans),
        }

    @staticmethod
    def _by_word(words: str, spans: list[tuple]) -> list[dict]:
        """Spans by word numbers, counted once along the text."""
        number, seen, place = 0, 0, {}
        for at in sorted({x for s in spans for x in s[2:4]}):
            number += words.count(" ", seen, at)
            seen, place[at] = at, number
        return [{"notice": n, "label": label, "first_word": place[a], "last_word": place[b], "edits": e} for n, label, a, b, e in spans]


_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("notice", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int64())])))])
_DDL = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,spans:array<struct<notice:string,label:string,first_word:bigint,last_word:bigint,edits:bigint>>>"
_SEARCH: list[NoticeSearch] = []


def scan_column(column: Column) -> Column:
    """struct(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a text column. No shuffle."""

    @F.arrow_udf(_DDL)
    def run(texts: pa.Array) -> pa.Array:
        if not _SEARCH:
            _SEARCH.append(NoticeSearch())
        return pa.array([_SEARCH[0].scan(t.as_py()) for t in texts.cast(pa.large_binary())], _ARROW)

    return run.asNondeterministic()(column)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """df plus the columns of scan_column; columns of df with the same names are replaced."""
    outputs = [f.name for f in _ARROW]
    held = [c for c in df.columns if c not in outputs]
    return df.select(*held, scan_column(F.col(text)).alias("__scan")).select(*held, "__scan.*")
