"""Cheapest repair of a conversation's role order, by Four-Russians block tables.

A repaired conversation is empty, or an optional system turn and then pairs of a user and an assistant turn. Rows are
kept (0), given the role user or assistant (2) or deleted (3, a must for blank and duplicate rows); empty user or
assistant rows are inserted (2); each truncated row that stays costs 1 more. Of the cheapest edit sequences the one
whose initials (D, I, K, R) are ASCII-least is taken, so ties have one answer.

What the rest of a conversation costs from each of four states (nothing yet, after system, user, assistant) is a cost
vector; less its least value it is one of a few classes, all of which can be listed. For every class and every block of
``BLOCK`` row symbols a table has the class before the block and what the block adds. Conversations are cut into
segments of at most ``SEGMENT`` rows, a table of bounded strings in which no text lies:

1. each segment looks up its blocks for all classes at once (any task, in any order);
2. a pass over the segments of a conversation, last to first, fixes the class after each;
3. each segment finds where it leaves from each of the four states, by expanding its blocks against the direction in
   which they were looked up (expansions are looked up as well);
4. a pass first to last fixes the state before each segment, and segments turn into edits beside their rows.

So a conversation with a third of all rows is worked on by many tasks; the two passes see one short row for each segment.

Rows are taken in order of ``turn`` (nulls first), then role and the MD5 of the text. Null roles and texts count as one
space. A null ``conv_id`` is a conversation of its own. Repeated rows are duplicates of each other. A row is blank
without any character but ``[\\x20\\x09-\\x0D]``, a duplicate if role and text were seen before in the conversation, and
truncated if its last such character is not one of ``.!?``; the first that holds counts. Only the first letter of a role
matters for the order. No rows, no result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch
from earshot.operators.joins import join_on
from earshot.operators.ordered import order_log

BLOCK, SEGMENT = 4, 1 << 12
INITIALS = "sua"
#: Symbols of rows: two for each initial (and for any other), whole or truncated; rows that must go; no row at all.
GO, NONE, SYMBOLS = 8, 9, 10
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant row that is made up, and after a row that is kept.
MADE = (USER, USER, ASSISTANT, USER)
KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
DELETE, INSERT, CHANGE, CUT = 3, 2, 2, 1
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
OUT_ROWS = 1024
_SEGMENTS = "conv_id bigint, segment bigint, marks binary"
_REPAIRED = "conv_id bigint, place bigint, step int, edit string, turn bigint, role string, text string, fault int, illegal boolean, cost int"
_CONVERSATIONS = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _with_inserts(cost: list[float]) -> tuple[float, ...]:
    """Costs when rows may be inserted first."""
    user = min(cost[USER], INSERT + cost[ASSISTANT])
    assistant = min(cost[ASSISTANT], INSERT + cost[USER])
    return min(cost[START], INSERT + user), min(cost[SYSTEM], INSERT + user), user, assistant


def _moves(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edit of a row, its cost and the state after it, in ASCII order of the edits."""
    yield "D", DELETE, state
    if symbol < GO:
        initial, cut = divmod(symbol, 2)
        if (state, initial) in KEPT:
            yield "K", CUT * cut, KEPT[state, initial]
        yield "R", CHANGE + CUT * cut, MADE[state]


class Tables:
    """All cost vectors, as classes, and their transitions. ``start`` is the class after the last row."""

    def __init__(self):
        inf = float("inf")
        after = _with_inserts([0, inf, inf, 0])
        self.vectors, self.number, self.start = [after], {after: 0}, 0
        self.step: list[list[tuple[int, int]]] = []
        self._blocks: dict[tuple, tuple] = {}
        for vector in self.vectors:  # grows on the way
            self.step.append([self._before(vector, s) for s in range(SYMBOLS)])
        codes = np.arange(SYMBOLS**BLOCK)
        self.to = np.repeat(np.arange(len(self.vectors))[:, None], len(codes), axis=1)
        self.add = np.zeros_like(self.to)
        to, add = (np.array([[s[i] for s in row] for row in self.step]) for i in (0, 1))
        for i in range(BLOCK):  # the last symbol of a block is its lowest digit
            symbol = codes // SYMBOLS**i % SYMBOLS
            self.add += add[self.to, symbol[None, :]]
            self.to = to[self.to, symbol[None, :]]

    def _before(self, vector: tuple, symbol: int) -> tuple[int, int]:
        if symbol == NONE:
            return self.number[vector], 0
        cost = _with_inserts([min(c + vector[q] for _, c, q in _moves(symbol, state)) for state in range(4)])
        least = min(cost)
        cost = tuple(c - least for c in cost)
        if cost not in self.number:
            self.number[cost] = len(self.vectors)
            self.vectors.append(cost)
        return self.number[cost], int(least)

    def row(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """ASCII-least cheapest edits up to this row's own, and the state after it."""
        if symbol == NONE:
            return "", state
        now, added = self.step[after][symbol]
        value = self.vectors[now][state] + added
        best = {edit: q for edit, c, q in _moves(symbol, state) if c + self.vectors[after][q] == value}
        if "D" in best:
            return "D", best["D"]
        if INSERT + self.vectors[now][MADE[state]] + added == value:
            rest, end = self.row(after, symbol, MADE[state])
            return "I" + rest, end
        edit = min(best)
        return edit, best[edit]

    def block(self, after: int, code: int, state: int) -> tuple[tuple[str, ...], int]:
        """The edits of each row of a block, kept for the next time (classes x blocks x states at most)."""
        key = after, code, state
        if key in self._blocks:
            return self._blocks[key]
        symbols = [code // SYMBOLS**i % SYMBOLS for i in reversed(range(BLOCK))]
        classes = [after]
        for symbol in reversed(symbols):
            classes.append(self.step[classes[-1]][symbol][0])
        edits = []
        for symbol, behind in zip(symbols, classes[-2::-1], strict=True):
            found, state = self.row(behind, symbol, state)
            edits.append(found)
        return self._blocks.setdefault(key, (tuple(edits), state))

    def walk(self, codes: np.ndarray, after: int, state: int) -> tuple[list[str], int]:
        """The edits of each row of a segment (with those for missing rows before it), and the state it ends in."""
        behind = [after]
        for code in codes[:0:-1].tolist():
            behind.append(int(self.to[behind[-1], code]))
        edits: list[str] = []
        for code, after in zip(codes.tolist(), reversed(behind), strict=True):
            found, state = self.block(after, code, state)
            edits += found
        return edits, state


#: Rows to insert when a conversation ends in a state.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


_made: list[Tables] = []


def tables() -> Tables:
    """Made once in a worker."""
    if not _made:
        _made.append(Tables())
    return _made[0]


def _codes(marks: bytes) -> np.ndarray:
    """Block codes of a segment; the first block is filled up in front."""
    mark = np.frombuffer(marks, np.uint8)
    initial, fault = mark >> 2, mark & 3
    symbol = np.where((fault == BLANK) | (fault == DUPLICATE), GO, 2 * initial + (fault == TRUNCATED))
    symbol = np.concatenate([np.full(-len(symbol) % BLOCK, NONE), symbol]).reshape(-1, BLOCK)
    return symbol @ SYMBOLS ** np.arange(BLOCK - 1, -1, -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    names = [c.strip().split(" ") for c in schema.split(",")]
    types = [kinds[t] for _, t in names]

    def out(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], [n for n, _ in names])

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield out(held)
            held = []
    if held:
        yield out(held)


def _arrow(df: DataFrame, work, schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: _batches(work(_rows(batches)), schema), schema)


def _summaries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """For each segment the class before it, by the class after it."""
    known = tables()
    every = np.arange(len(known.vectors))
    for conv_id, segment, marks in rows:
        now = every
        for code in _codes(marks)[::-1].tolist():
            now = known.to[now, code]
        yield conv_id, segment, marks, now.astype(np.uint8).tobytes()


def _classes(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows come by conversation, last segment first."""
    at: tuple | None = None
    for conv_id, segment, marks, before in rows:
        last = at is None or at[0] != conv_id
        after = tables().start if last else at[1]
        at = conv_id, before[after]
        yield conv_id, segment, marks, after, last


def _exits(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv_id, segment, marks, after, last in rows:
        codes = _codes(marks)
        ends = bytes(tables().walk(codes, after, state)[1] for state in range(4))
        yield conv_id, segment, marks, after, last, ends


def _entries(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows come by conversation, first segment first."""
    at: tuple | None = None
    for conv_id, segment, marks, after, last, ends in rows:
        if at is None or at[0] != conv_id:
            at = conv_id, START, None
        yield conv_id, segment, marks, after, last, at[1], at[2]
        at = conv_id, ends[at[1]], marks[-1] >> 2


def _edits(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows come by segment, the one of the segment table before those of the conversation."""
    state = before = None
    edits: Iterator[str] = iter(())
    left = 0
    for conv_id, place, turn, role, text, mark, marks, after, last, entry, initial in rows:
        if marks is not None:
            codes = _codes(marks)
            found, state = tables().walk(codes, after, entry)
            if last:
                found.append(CLOSING[state])
            edits, state, before = iter(found[-len(marks) % BLOCK :]), entry, initial
            left = len(marks)
            continue
        left -= 1
        now, fault = mark >> 2, mark & 3
        illegal, before = before is not None and (before, now) not in LEGAL, now
        cut = CUT * (fault == TRUNCATED)
        for step, edit in enumerate(found := next(edits)):
            made = ("user", "assistant")[MADE[state] == ASSISTANT]
            own = step == len(found) - 1
            if edit == "I":
                row, cost, state = (None, made, ""), INSERT, MADE[state]
            elif edit == "R":
                row, cost, state = (turn, made, text), CHANGE + cut, MADE[state]
            elif edit == "K":
                row, cost, state = (turn, role, text), cut, KEPT[state, now]
            else:
                row, cost = (turn, None, None), DELETE
            yield conv_id, place, step, edit, *row, fault if own else NO_FAULT, illegal and own, cost
        if not left:
            for step, _ in enumerate(next(edits, "")):
                yield conv_id, place, len(found) + step, "I", None, ("user", "assistant")[MADE[state] == ASSISTANT], "", NO_FAULT, False, INSERT
                state = MADE[state]


def _marked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """``conv_id, turn, role, text, mark, place, segment``; ``mark`` holds the initial's number and the fault."""
    rows = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumns({"digest": F.md5("text"), "dealt": F.monotonically_increasing_id()})  # equal rows go to several tasks
    log = order_log(rows, ("turn", "role", "digest", "dealt"), ("conv_id",))
    seen = log.rows.groupBy("conv_id", "role", "digest").agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    again = scratch.stage(seen.where("n > 1").drop("n"), "repeated")
    duplicate = F.coalesce(F.col("row_index") > F.col("first"), F.lit(False))
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(duplicate, DUPLICATE)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(NO_FAULT)
    )
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    initial = F.when((place > 0) & (F.col("role") != ""), place - 1).otherwise(len(INITIALS))
    marked = join_on(log.rows, again, ("conv_id", "role", "digest")).select(
        "conv_id", "turn", "role", "text", (4 * initial + fault).alias("mark"), F.col("row_index").alias("place"),
        F.expr(f"(row_index - 1) div {SEGMENT}").alias("segment"),
    )
    return scratch.stage(marked, "marked")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each edit of ``turns(conv_id, turn, role, text, ...)``: ``conv_id, place, step, edit, turn, role, text,
    fault, illegal, cost``. Ordered by ``place`` and ``step``, the rows of a conversation with a role are the repaired
    one. ``fault`` is that of the edited row (1 blank, 2 duplicate, 3 truncated); ``illegal`` says that its initial may
    not follow that of the row before. Deleted rows have no role or text, inserted ones no turn."""
    scratch = Scratch(turns.sparkSession)
    rows = _marked(turns, scratch)
    marks = F.transform(F.sort_array(F.collect_list(F.struct("place", "mark"))), lambda x: F.lpad(F.hex(x["mark"]), 2, "0"))  # a segment's worth
    segments = rows.groupBy("conv_id", "segment").agg(F.unhex(F.concat_ws("", marks)).alias("marks"))
    summed = _arrow(segments, _summaries, f"{_SEGMENTS}, before binary")
    classed = _arrow(summed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("segment")), _classes, f"{_SEGMENTS}, after int, last boolean")
    left = _arrow(classed.repartition("conv_id", "segment"), _exits, f"{_SEGMENTS}, after int, last boolean, ends binary")
    entered = _arrow(left.repartition("conv_id").sortWithinPartitions("conv_id", "segment"), _entries, f"{_SEGMENTS}, after int, last boolean, entry int, initial int")
    entered = scratch.stage(entered, "segments")
    texts = rows.select("conv_id", "segment", "place", "turn", "role", "text", "mark")
    both = entered.withColumn("place", F.lit(0).cast("bigint")).unionByName(texts, allowMissingColumns=True)
    dealt = both.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "place")
    return _arrow(dealt.select("conv_id", "place", "turn", "role", "text", "mark", "marks", "after", "last", "entry", "initial"), _edits, _REPAIRED)


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    now: list | None = None

    def row() -> tuple:
        return now[0], *now[1], now[2], now[3], "".join(now[4]), now[5].hexdigest()

    for conv_id, edit, role, text, fault, illegal, cost in rows:
        if now is None or now[0] != conv_id:
            if now is not None:
                yield row()
            now = [conv_id, [0, 0, 0], 0, 0, [], hashlib.sha256(), False]
        if fault:
            now[1][fault - 1] += 1
        now[2] += illegal
        now[3] += cost
        now[4].append(edit)
        if role is not None:
            now[5].update(f"{chr(10) if now[6] else ''}{role}:{text}".encode())
            now[6] = True
    if now is not None:
        yield row()


def digests(repaired: DataFrame) -> DataFrame:
    """Counts, cost, edit initials and the digest of the repaired rows of each conversation. A digest needs its texts
    in order, so those of a conversation stream through one task, which holds one batch and the initials."""
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return _arrow(ordered.select("conv_id", "edit", "role", "text", "fault", "illegal", "cost"), _digests, _CONVERSATIONS)


def gaps(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps``: turn numbers missing between the least and the greatest of a conversation."""
    one = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")).distinct()
    missing = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    return one.groupBy("conv_id").agg(F.coalesce(missing, F.lit(0)).cast("bigint").alias("gaps"))


def audit(turns: DataFrame, names: DataFrame) -> DataFrame:
    """Gaps, counts, cost, initials and digest for each ``conv_id`` of ``names``; zeros, no initials and the digest of
    the empty text for those without rows."""
    scratch = Scratch(turns.sparkSession)
    found = scratch.stage(digests(repair(turns)), "conversations")
    holes = scratch.stage(gaps(turns), "gaps")
    every = names.select(F.col("conv_id").cast("bigint")).distinct()
    joined = join_on(join_on(every, holes, ("conv_id",)), found, ("conv_id",))
    numbers = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )
