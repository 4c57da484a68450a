"""The conversation trie against plain prefix counting."""

import hashlib
import random
import zlib
from collections import defaultdict

from codeloom.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    talks = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            talks[c].append((t, role or "", text or ""))
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest())
    return {c: tuple(r[1:] for r in sorted(talk, key=key)) for c, talk in talks.items()}


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, ())[:h] + own[h:]
    return out


def nodes(talks):
    members = defaultdict(list)
    for c in sorted(talks):
        for d in range(len(talks[c]) + 1):
            members[talks[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own) - 1) * (len(path[-1][1].encode()) if path else 0)
    return {
        (own[0], len(p), members[p[:-1]][0] if p else None, len(own), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in own if talks[c] == p).encode()).hexdigest())
        for p, own in members.items()
    }


def made(rng, convs):
    """Conversations that share openings, whole copies among them."""
    opening = [[(rng.choice(["user", "assistant"]), f"o{i}.{j}") for j in range(12)] for i in range(3)]
    rows = []
    for c in convs:
        talk = opening[rng.randrange(3)][: rng.randrange(13)] + [(rng.choice(["user", None]), rng.choice(["a", "b", None, "é\U0001f600"])) for _ in range(rng.randrange(3))]
        rows += [(c, t, *turn) for t, turn in enumerate(talk or [("user", "x")])]
    return rows


def got(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_trie_equals_prefix_counts(spark):
    rng = random.Random(3)
    rows = made(rng, list(range(40)) + [1001, 1003, 1007])  # 1000 and 1005 are absent, so some have no opening
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(conversation_trie.build(df)) == nodes(in_order(rows))
    assert got(conversation_trie.build_rebuilt(df)) == nodes(rebuilt(in_order(rows)))


def test_copies_and_odd_rows(spark):
    """Hot copies, equal and null turns, long texts, one long conversation, turnless rebuilt conversations, clashing columns."""
    rows = [(c, t, "user", f"copy {t}") for c in range(100, 160) for t in range(5)]
    rows += [(7, None, None, None), (7, None, None, None), (None, 1, "user", "nobody's"), (8, 3, "user", "x" * 200_000), (9, 3, "user", "x" * 200_000), (11, 1, "user", "only one")]
    rows += [(5000, t, "user", str(t % 3)) for t in range(300)] + [(5001, t, "user", str(t % 3)) for t in range(300)] + [(5002, 1, "user", "0"), (5002, 1, "user", "0")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'a' AS node", "2 AS bucket", "3 AS said")
    assert got(conversation_trie.build(df)) == nodes(in_order(rows))
    assert got(conversation_trie.build_rebuilt(df)) == nodes(rebuilt(in_order(rows)))
    empty = spark.createDataFrame([], SCHEMA)
    assert got(conversation_trie.build(empty)) == got(conversation_trie.build_rebuilt(empty)) == set()
