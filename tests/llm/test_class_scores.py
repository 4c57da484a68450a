"""Class scores against plain counting, probabilities that add up, classes that are found."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import class_scores

SCHEMA = "doc_id long, text string"


def words(text):
    return (text or "").encode().translate(bytes((b + 32) if 0x41 <= b <= 0x5A else b for b in range(256))).split()


def is_held(doc):
    return zlib.crc32(str(doc).encode() if doc is not None else b"") % 7 == 2


def expected(rows, classes, once_of=None):
    """Scores by plain counting, with the classes {word: class} as given."""
    train = [words(t) for d, t in rows if not is_held(d)]
    c = Counter(w for t in train for w in t)
    ends, n = len(train), sum(map(len, train)) + len(train)
    v = len(c) + (n > 0)
    pairs, total = Counter(), Counter()
    for t in train:
        seq = [0] + [classes[w] for w in t] + [0]
        pairs.update(zip(seq, seq[1:]))
        total.update(seq[1:])
    new = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    left = Counter()
    for (a, _), x in pairs.items():
        left[a] += x
    out = []
    for d, t in rows:
        base, score, before, known = 0.0, 0.0, 0, 0
        for w in [*words(t), None]:
            count = ends if w is None else c[w]
            base += math.log10((count + 1) / (n + v + 1))
            known += count > 0
            if not count:
                score += math.log10(new) if n else 0.0
                before = None
                continue
            k = 0 if w is None else classes[w]
            share = total[k] / n
            step = share if before is None else (pairs[before, k] + class_scores.PRIOR * share) / (left[before] + class_scores.PRIOR)
            score += math.log10((1 - new) * step * count / total[k])
            before = k
        out.append((d, is_held(d), len(words(t)) + 1, known, n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def rounded(df):
    return sorted(((*r[:5], round(r[5], 6), round(r[6], 6)) for r in map(tuple, df.collect())), key=str)


def made(rng, n):
    vocabulary = [f"w{i}" for i in range(40)] + ["É\U0001f600", "WORD", "word"]
    return [(i, " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(30)) + [f"rare{i}"] * (i % 4 == 0))) for i in range(n)]


ODD = [(900, None), (901, ""), (902, " \n\x0b\t "), (903, "Tab\tLINE\nend\x0cpage"), (None, "nobody's words"), (904, "same same same"), (904, "same same same"), (905, "long " * 100_000), (906, "a\x00b \x1f")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_plain_counts(spark, monkeypatch, small):
    rng = random.Random(4)
    rows = made(rng, 120) + ODD
    if small:  # many chunks and shards; the bound of a chunk is set in the worker
        path = class_scores._chunks

        def tiny(batches):
            class_scores.CHUNK_WORDS = 30
            return path(batches)

        monkeypatch.setattr(class_scores, "_chunks", tiny)
        monkeypatch.setattr(class_scores, "SHARD_WORDS", 20)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS chunk", "'x' AS held", "2 AS n")
    model = class_scores.fit(df.repartition(3 if small else 1), class_scores.held_out(), classes=6)
    found = {r["word"].encode(): r["class"] for r in class_scores.word_classes(model).collect()}
    assert set(found) == {w for d, t in rows if not is_held(d) for w in words(t)} and set(found.values()) <= set(range(1, 6))
    assert rounded(class_scores.apply(model)) == expected(rows, found)
    # the pairs are those of the classes that are kept, and what was kept tells most
    assert class_scores.information(model.pairs) == pytest.approx(max(model.history))
    whole = class_scores.fit(df, class_scores.held_out(), classes=6)
    assert {r["word"].encode(): r["class"] for r in class_scores.word_classes(whole).collect()} == found


def test_probabilities_add_up():
    pairs = np.array([[0, 3, 2], [1, 4, 0], [4, 0, 7]])
    steps, new = class_scores.transitions(pairs, 5)
    assert np.allclose((10.0**steps).sum(1) + 10.0**new, 1)


def test_nothing_to_learn_from(spark):
    assert class_scores.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [(i, "x y") for i in range(60) if is_held(i)]
    assert {r[1:] for r in rounded(class_scores.score(spark.createDataFrame(held, SCHEMA)))} == {(True, 3, 0, 0, 0.0, 0.0)}


def test_classes_are_found_and_held_out_texts_score_better(spark):
    """Words of two kinds that take turns: no class mixes them, and the model tells more than single words do."""
    rng = random.Random(6)
    kinds = [[f"a{i}" for i in range(12)], [f"b{i}" for i in range(12)]]
    rows = [(d, " ".join(rng.choice(kinds[i % 2]) for i in range(rng.randrange(10, 40)))) for d in range(400)]
    model = class_scores.fit(spark.createDataFrame(rows, SCHEMA), class_scores.held_out(), classes=8)
    found = {r["word"]: r["class"] for r in class_scores.word_classes(model).collect()}
    assert not {c for w, c in found.items() if w[0] == "a"} & {c for w, c in found.items() if w[0] == "b"}
    assert max(model.history) > model.history[0]
    held = class_scores.apply(model).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert (held["s"] - held["b"]) / held["n"] > 0.2


def test_moves_follow_the_information():
    """A word alone in its class goes where the information of the whole is largest, by trying every class."""
    rng = np.random.default_rng(7)
    k, words_of = 5, [1, 1, 2, 2, 3, 3, 4]
    for _ in range(40):
        seq = [0]
        for _ in range(60):
            seq += [int(x) + 1 for x in rng.integers(0, 7, rng.integers(1, 6))] + [0]
        at = lambda kinds: np.array([0, *kinds])[seq]
        count = lambda kinds: np.bincount(at(kinds)[:-1] * k + at(kinds)[1:], minlength=k * k).reshape(k, k)
        now = at(words_of)
        spots = [i for i, w in enumerate(seq) if w == 7]
        v = np.zeros((1, 2 * k + 1), np.int64)
        for i in spots:
            v[0, now[i + 1]] += 1
            v[0, k + now[i - 1]] += 1
            v[0, 2 * k] += seq[i + 1] == 7
        got = class_scores.best_classes(v, np.array([len(spots)]), np.array([4]), count(words_of))[0]
        tried = {c: class_scores.information(count([*words_of[:6], c])) for c in range(1, k)}
        assert got in sorted(tried, key=tried.get)[-2:]
