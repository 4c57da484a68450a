"""Conversation structure repair: the cheapest edits that make a dialogue well formed.

A well-formed dialogue is empty, or an optional system turn followed by pairs of user and assistant turns. Every turn
is kept, given another role, or deleted, and empty turns are inserted anywhere; blank turns and turns seen before must
go. A dynamic program computes backwards, for each place and grammar state, what the rest costs; a walk forwards takes
at each step the ASCII-least edit that costs no more than that. The grammar wants one role at each state (user, or
assistant behind a user), so an edit's initial settles the next state and the walk has no further ties.

A conversation may hold a third of all rows, so nothing is computed over one as a whole. Its rows are sorted by range
and cut into segments of bounded size. The costs of a segment are a 4 x 4 matrix (state before, state behind), computed
for all segments at once; a backward scan over a conversation's matrices gives the cost-to-go behind each segment, all
segments then walk from each of the four states at once, and a forward scan over these ends gives the state in front
of each. Only the digest of the repaired text and the audit are put together in order by one task for each
conversation, as a stream of segments: SHA-256 can't be computed in parts.

Defined results: rows are ordered by turn (null first), ties by the MD5 of role and text. A null role or text is one
blank, so the text is blank and the role has no place in the grammar, as an empty role has none. Rows of a null conv_id are a conversation. Equal
rows are repeats of one. Texts of any length are handled whole. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .textops import batched, rows_of

RELABEL, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: Bytes of text and number of turns of a segment, about.
SEGMENT_BYTES, SEGMENT_TURNS = 4 << 20, 50_000
BLANKS = " \t\n\v\f\r"
FAR = 1 << 60
#: States: 0 nothing yet, 1 behind system, 2 behind user, 3 behind assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind the turn that the grammar wants, and that turn's role.
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: What the end of a conversation costs, and the inserts it takes.
END = (0, 2 * INSERT, INSERT, 0)
FITS = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}


def symbol(initial: str, must_go: bool, cut_off: bool) -> str:
    """A turn as the program sees it: d must go, else s u a or x for its role, in upper case if its text is cut off."""
    letter = initial if initial in ("s", "u", "a") else "x"
    return "d" if must_go else letter.upper() if cut_off else letter


@lru_cache(maxsize=64)
def _edits(sign: str) -> tuple:
    """For each state the (letter, cost, next state) that use up a turn, in ASCII order."""
    out = []
    for state in range(4):
        here = [("D", DELETE, state)]
        if sign != "d":
            more = CUT_OFF if sign.isupper() else 0
            keep = FITS.get(sign.lower(), (None,) * 4)[state]
            if keep is not None:
                here.append(("K", more, keep))
            here.append(("R", RELABEL + more, WANTED[state]))
        out.append(tuple(here))
    return tuple(out)


def costs(signs: str, behind: tuple) -> list[tuple]:
    """The cost-to-go of each state in front of each turn, and behind the last one as given."""
    table = [behind]
    for sign in reversed(signs):
        behind = table[-1]
        least = [min(cost + behind[to] for _, cost, to in edits) for edits in _edits(sign)]
        for _ in range(3):  # an insert leads to a state of the same place; no cheapest way takes more than two in a row
            least = [min(least[s], INSERT + least[WANTED[s]]) for s in range(4)]
        table.append(tuple(least))
    return table[::-1]


def matrix(signs: str) -> tuple:
    """For each state behind the turns, the costs from each state in front of them: 16 numbers."""
    return _matrix(signs) if len(signs) <= 64 else _matrix.__wrapped__(signs)


@lru_cache(maxsize=20_000)
def _matrix(signs: str) -> tuple:
    return tuple(x for to in range(4) for x in costs(signs, tuple(0 if s == to else FAR for s in range(4)))[0])


def walk(signs: str, behind: tuple, state: int) -> tuple[str, int]:
    """The edits' initials over these turns from ``state``, and the state behind them."""
    return _walk(signs, behind, state) if len(signs) <= 64 else _walk.__wrapped__(signs, behind, state)


@lru_cache(maxsize=20_000)
def _walk(signs: str, behind: tuple, state: int) -> tuple[str, int]:
    table, audit, i = costs(signs, behind), [], 0
    while i < len(signs):
        steps = [("D", DELETE, i + 1, state), ("I", INSERT, i, WANTED[state]), *((a, c, i + 1, t) for a, c, t in _edits(signs[i])[state] if a != "D")]
        letter, _, i, state = next(s for s in steps if s[1] + table[s[2]][s[3]] == table[i][state])
        audit.append(letter)
    return "".join(audit), state


def damage(df: DataFrame) -> DataFrame:
    """Faults put into conversations by the crc32 of ``conv_id:turn``: (conv_id, turn, role, text, copies).

    Of 20 remainders, 0 drops the row (copies 0, no text), 1 empties its text, 2 removes its full stops, question
    and exclamation marks, 3 repeats it (copies 2) and 4 makes it the user's. A null becomes one blank.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    lost = kind == 0
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.when(~lost, F.col("turn")).cast("long").alias("turn"),
        F.when(lost, "").when(kind == 4, "user").otherwise(blank("role")).alias("role"),
        F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text")).alias("text"),
        F.when(lost, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("bucket", pa.int32()), ("seq", pa.int32()), ("signs", pa.string()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("matrix", pa.list_(pa.int64()))]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn")]
    + [("first_initial", pa.string()), ("last_initial", pa.string())]
)
_SEGMENT_DDL = "conv_id long, bucket int, seq int, signs string, roles array<string>, texts array<string>, matrix array<long>, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"


class _Segment:
    """The turns of a conversation that stand next to each other in one task."""

    def __init__(self):
        self.signs, self.roles, self.texts, self.size = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn, role: str, text: str, repeat: bool) -> None:
        words, initial = text.strip(BLANKS), role[:1]
        empty = not words
        cut_off = not empty and not repeat and words[-1] not in ".!?"
        self.blank += empty
        self.duplicate += repeat and not empty
        self.truncated += cut_off
        if self.first_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in ("su", "ua", "au")
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        gone = empty or repeat
        self.signs.append(symbol(initial, gone, cut_off))
        self.roles.append("" if gone else role)
        self.texts.append("" if gone else text)
        self.size += 0 if gone else len(role) + len(text)

    def row(self, conv, bucket: int, seq: int) -> tuple:
        signs = "".join(self.signs)
        return (conv, bucket, seq, signs, self.roles, self.texts, matrix(signs), self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.first_turn, self.last_turn, self.first_initial, self.last_initial)


def _segments(batches):
    def rows():
        last, segment, seq, bucket = None, None, 0, 0
        for conv, bucket, turn, role, text, copies, fresh in rows_of(batches):
            if segment is None or conv != last or segment.size >= SEGMENT_BYTES or len(segment.signs) >= SEGMENT_TURNS:
                if segment is not None:
                    yield segment.row(last, bucket, seq)
                    seq += 1
                last, segment = conv, _Segment()
            for copy in range(copies):
                if len(segment.signs) >= SEGMENT_TURNS:
                    yield segment.row(last, bucket, seq)
                    seq, segment = seq + 1, _Segment()
                segment.add(turn, role, text, copy > 0 or not fresh)
        if segment is not None:
            yield segment.row(last, bucket, seq)

    return batched(rows(), _SEGMENT)


def _backward(batches):
    """Segments of each conversation from the last to the first: the costs behind each."""

    def rows():
        last, goal, first = None, END, True
        for conv, bucket, seq, cells in rows_of(batches):
            if first or conv != last:
                last, goal, first = conv, END, False
            yield bucket, seq, goal
            goal = tuple(min(cells[4 * to + s] + goal[to] for to in range(4)) for s in range(4))

    return batched(rows(), pa.schema([("b", pa.int32()), ("q", pa.int32()), ("goal", pa.list_(pa.int64()))]))


def _ends(batches):
    rows = ((conv, bucket, seq, goal, [walk(signs, tuple(goal), s)[1] for s in range(4)]) for conv, bucket, seq, signs, goal in rows_of(batches))
    return batched(rows, pa.schema([("conv_id", pa.int64()), ("bucket", pa.int32()), ("seq", pa.int32()), ("goal", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32()))]))


def _forward(batches):
    """Segments of each conversation from the first to the last: the state in front of each."""

    def rows():
        last, state, first = None, START, True
        for conv, bucket, seq, goal, ends in rows_of(batches):
            if first or conv != last:
                last, state, first = conv, START, False
            yield bucket, seq, goal, state
            state = ends[state]

    return batched(rows(), pa.schema([("b", pa.int32()), ("q", pa.int32()), ("goal", pa.list_(pa.int64())), ("state", pa.int32())]))


def _rebuild(batches):
    """The edits of each segment carried out: audit, the lines that stay or come in, and what the edits cost."""

    def rows():
        for conv, bucket, seq, signs, roles, texts, goal, state, *facts in rows_of(batches):
            audit, end = walk(signs, tuple(goal), state)
            lines, i = [], 0
            for letter in audit:
                if letter == "I":
                    lines.append(ROLE[state] + ":")
                    state = WANTED[state]
                    continue
                if letter == "K":
                    lines.append(roles[i] + ":" + texts[i])
                    state = FITS[signs[i].lower()][state]
                elif letter == "R":
                    lines.append(ROLE[state] + ":" + texts[i])
                    state = WANTED[state]
                i += 1
            paid = audit.count("D") * DELETE + audit.count("I") * INSERT + audit.count("R") * RELABEL
            left = [x for x in audit if x != "I"]
            paid += CUT_OFF * sum(a != "D" and s.isupper() for a, s in zip(left, signs, strict=True))
            yield (conv, bucket, seq, audit, "\n".join(lines), paid, end, *facts)

    return batched(rows(), _PIECE, max_rows=1_000)


_FACTS = ["blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial"]
_PIECE = pa.schema([("conv_id", pa.int64()), ("bucket", pa.int32()), ("seq", pa.int32()), ("audit", pa.string()), ("piece", pa.string()), ("paid", pa.int64()), ("last_state", pa.int32())] + [_SEGMENT.field(c) for c in _FACTS])
_PIECE_DDL = "conv_id long, bucket int, seq int, audit string, piece string, paid long, last_state int, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, first_initial string, last_initial string"
_RESULT_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _whole(batches):
    """The segments of each conversation, in order, put together."""

    def rows():
        first, last = True, None
        for conv, _, _, audit, piece, paid, end, blank, duplicate, truncated, illegal, turns, low, high, opening, closing in rows_of(batches):
            if first or conv != last:
                if not first:
                    yield done()
                first, last = False, conv
                digest, audits, cost, lines = hashlib.sha256(), [], 0, False
                counts, distinct, least, most, before = [0] * 4, 0, None, None, None
            crossing = before is not None and opening is not None and before + opening not in ("su", "ua", "au")
            counts = [a + b for a, b in zip(counts, (blank, duplicate, truncated, illegal + crossing), strict=True)]
            before = before if closing is None else closing
            if low is not None:
                distinct += turns - (most == low)
                least, most = low if least is None else least, high
            audits.append(audit)
            cost, state = cost + paid, end
            if piece:
                digest.update(("\n" if lines else "").encode() + piece.encode())
                lines = True
            def done(conv=conv, digest=digest, audits=audits, cost=cost, lines=lines, state=state, counts=counts, distinct=distinct, least=least, most=most):  # noqa: E306
                missing = {SYSTEM: ["user:", "assistant:"], USER: ["assistant:"]}.get(state, [])
                for line in missing:
                    digest.update(("\n" if lines else "").encode() + line.encode())
                    lines = True
                gaps = 0 if least is None else most - least + 1 - distinct
                return (conv, gaps, *counts, cost + INSERT * len(missing), "".join(audits) + "I" * len(missing), digest.hexdigest())
        if not first:
            yield done()

    names = [x.split()[0] for x in _RESULT_DDL.split(", ")]
    return batched(rows(), pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names]))


def segments(df: DataFrame, copies: str | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) cut into segments; ``copies`` names a column of how often a row stands there."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
    rows = named.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    rows = rows.withColumn("said", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))))
    # the first turn at which a conversation says something; joined by keys that no two rows share, so no key is hot
    opening = rows.where("copies > 0").groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("t")).select(F.col("conv_id").alias("c"), F.col("t.turn").alias("t"), F.col("said").alias("s"))
    met = rows.join(opening, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("said") == F.col("s")), "left")
    order = ["conv_id", "turn", "said"]
    placed = met.select(*order, "role", "text", "copies", F.col("s").isNotNull().alias("fresh")).repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.select("conv_id", F.spark_partition_id().alias("bucket"), "turn", "role", "text", "copies", "fresh").mapInArrow(_segments, _SEGMENT_DDL), "repair-segments")


def edited(parts: DataFrame) -> DataFrame:
    """The segments with their cheapest edits carried out: audit, repaired lines (piece), cost (paid), counts."""
    key = ["conv_id", "bucket", "seq"]
    by_last = parts.select(*key, "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("bucket"), F.desc("seq"))
    goals = by_last.mapInArrow(_backward, "b int, q int, goal array<long>")
    at = (F.col("bucket") == F.col("b")) & (F.col("seq") == F.col("q"))
    ends = parts.select(*key, "signs").join(goals, at).select(*key, "signs", "goal").mapInArrow(_ends, "conv_id long, bucket int, seq int, goal array<long>, ends array<int>")
    states = ends.repartition("conv_id").sortWithinPartitions(*key).mapInArrow(_forward, "b int, q int, goal array<long>, state int")
    return parts.join(states, at).select(*key, "signs", "roles", "texts", "goal", "state", *_FACTS).mapInArrow(_rebuild, _PIECE_DDL)


def repair(df: DataFrame, copies: str | None = None) -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    gaps: turn numbers missing between the least and the largest. Each turn's first fault counts: blank, duplicate
    (role and text seen earlier), truncated (the last visible character isn't one of ``.!?``). illegal: neighbouring
    roles whose initials aren't su, ua or au. cost and audit: the cheapest edits, ties ASCII-least. The digest is that
    of the repaired ``role:text`` lines. A conversation whose rows all have no copies has zeros and an empty audit.
    """
    return edited(segments(df, copies)).repartition("conv_id").sortWithinPartitions("conv_id", "bucket", "seq").mapInArrow(_whole, _RESULT_DDL)
