"""Structure repair against a search over all edits, with segments of any size."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from codeloom.llm import queries, structure_repair

SCHEMA = "conv_id long, turn long, role string, text string"
FORM = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        visible = BLANK.findall(text)
        out.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits in order of (cost, audit), by a queue over whole dialogues."""
    kinds = faults(rows)
    queue, done = [(0, "", 0, ())], set()
    while queue:
        cost, audit, i, lines = heapq.heappop(queue)
        letters = "".join(x.split(":")[0][:1] or "-" for x in lines)
        if i == len(rows) and FORM.fullmatch(letters):
            return cost, audit, lines
        if (i, letters, audit) in done or len(letters) > 2 * len(rows) + 4 or not any(FORM.fullmatch(letters + rest) for rest in ("", "a", "ua")):
            continue
        done.add((i, letters, audit))
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 3, audit + "I", i, (*lines, role + ":")))
        if i < len(rows):
            (role, text), fault = rows[i], kinds[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, (*lines, f"{new}:{text}")))


def expected(rows):
    """rows: (turn, role, text) in order, without nulls in role and text."""
    kinds = faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, lines = cheapest([r[1:] for r in rows])
    letters = [r[1][:1] for r in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: kinds.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def made(rng, n):
    texts = ["Yes.", "No!", "cut off", " \n", "Why?", "a.b", "end. \t", "é\U0001f600?"]
    return [(t, rng.choice(["user", "assistant", "system", "tool", "", "assistant", "user"]), rng.choice(texts) if rng.random() < 0.4 else f"text {rng.random()}.") for t in sorted(rng.sample(range(3 * n + 1), n))]


def test_costs_of_segments_compose():
    rng = random.Random(2)
    for _ in range(200):
        signs = "".join(rng.choice("suaxSUAXd") for _ in range(rng.randrange(12)))
        whole = structure_repair.costs(signs, structure_repair.END)[0]
        at = rng.randrange(len(signs) + 1)
        behind = structure_repair.costs(signs[at:], structure_repair.END)[0]
        cells = structure_repair.matrix(signs[:at])
        assert tuple(min(cells[4 * to + s] + behind[to] for to in range(4)) for s in range(4)) == whole
        audit, state = structure_repair.walk(signs, structure_repair.END, 0)
        first, between = structure_repair.walk(signs[:at], behind, 0)
        second, last = structure_repair.walk(signs[at:], structure_repair.END, between)
        assert (first + second, last) == (audit, state)


@pytest.mark.parametrize("turns", [structure_repair.SEGMENT_TURNS, 2, 1])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, turns):
    rng = random.Random(turns)
    talks = {c: made(rng, rng.randrange(1, 7)) for c in range(-2, 30)}
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    path = structure_repair._segments

    def small(batches):  # in the worker: segments of the tested size
        structure_repair.SEGMENT_TURNS = turns
        return path(batches)

    monkeypatch.setattr(structure_repair, "_segments", small)
    got = {r["conv_id"]: r.asDict() for r in structure_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {c: {"conv_id": c, **expected(talk)} for c, talk in talks.items()}


def test_repair_of_odd_rows(spark):
    rows = [
        (None, 1, "user", "Hi."), (None, None, None, "first"), (1, 5, "user", None), (2, 1, "user", "Same."), (2, 1, "user", "Same."), (2, 9, "assistant", "Ok."),
        (3, None, "user", "a."), (3, None, "user", "b."), (4, 2, "assistant", "x" * 300_000 + "."), (4, 1, "user", "q" * 9 + "?"),
    ]
    talks = {}
    for c, t, role, text in rows:
        talks.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    for talk in talks.values():
        talk.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
    extra = "SELECT *, 1 AS copies, 'x' AS bucket, 'y' AS said FROM {t}"
    got = {r["conv_id"]: r.asDict() for r in structure_repair.repair(spark.sql(extra, t=spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {c: {"conv_id": c, **expected(talk)} for c, talk in talks.items()}
    assert structure_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_long_conversation_in_many_segments(spark):
    """A conversation of many turns, dealt over tasks and segments, has the edits of one walk over all of it."""
    rng = random.Random(5)
    talk = [(i, rng.choice(["user", "assistant"]), f"turn {i}" + rng.choice([".", "", "!"])) for i in range(3_000)]
    signs = "".join(structure_repair.symbol(r[0], False, t[-1] not in ".!?") for _, r, t in talk)
    audit, state = structure_repair.walk(signs, structure_repair.END, 0)
    parts = structure_repair.segments(spark.createDataFrame([(7, *r) for r in talk], SCHEMA).repartition(5))
    assert parts.count() > 1
    (row,) = structure_repair.repair(spark.createDataFrame([(7, *r) for r in talk], SCHEMA)).collect()
    assert row["audit"] == audit + {0: "", 1: "II", 2: "I", 3: ""}[state]
    assert row["cost"] == structure_repair.costs(signs, structure_repair.END)[0][0]


def test_damage_and_lost_conversations(spark, tmp_path):
    """Every original conv_id comes back, also where all its rows are dropped."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(200) for t in range(1 + c % 3)] + [(700, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    left = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        left[c] += [(t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert any(not x for x in left.values())
    got = {r["conv_id"]: r.asDict() for r in queries.op13_structure_repair(spark, str(tmp_path)).collect()}
    assert got == {c: {"conv_id": c, **expected(talk)} for c, talk in left.items()}
