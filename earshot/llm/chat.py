"""Chat formatting in budgeted windows of whole turns.

A turn is written as ``<|im_start|>role``, a line end, the text and ``<|im_end|>``; control strings inside roles and
texts get a backslash after their first character and backslashes are doubled, so any text comes back unchanged.
Running sums of the turns' tokens cut a conversation into windows: each takes as many new turns as fit the budget
beside what it repeats, which is the leading system turn and the last turns before it up to ``history`` tokens. A
turn that does not fit drops the history, and stands alone (whole) if it is still too long. Only assistant texts of
new turns are under the loss mask, so every target counts once.

Turns are ordered by ``turn``, then role and text, nulls first. Null roles and texts count as empty, a null
``conv_id`` is a conversation of its own. Repeated rows are repeated turns. Rows stream through a task in order: what
it holds is bounded by the budget or the longest turn, however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Strings that tokenizers or templates give a meaning.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
_TOKEN = re.compile(r"\w+|[^\w\s]")
_ESCAPED = re.compile(r"\\(.)", re.S)
OUT_ROWS = 256
WINDOWS = "conv_id bigint, window bigint, text string, repeated int, loss_start array<int>, loss_end array<int>, n_tokens bigint"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    history: int = 256


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control in CONTROLS:
        text = text.replace(control, f"{control[0]}\\{control[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Conversation:
    """Writes the windows of one conversation as its turns come in."""

    def __init__(self, conv_id: int | None, budget: Budget):
        self.id, self.budget = conv_id, budget
        self.system: tuple | None = None
        self.past: deque[tuple] = deque()  # turns before the window, at most the history budget
        self.past_tokens = 0
        self.new: list[tuple] = []
        self.new_tokens = self.room = 0
        self.number, self.seen = 0, 0

    def add(self, role: str, text: str) -> tuple | None:
        """A finished window if this turn does not fit any more."""
        shown = f"{OPEN}{escape(role).replace(chr(10), chr(92) + chr(10))}\n", escape(text), CLOSE
        turn = (role, *shown, sum(len(_TOKEN.findall(x)) for x in shown))
        done = None
        if self.new and self.new_tokens + turn[-1] > self.room:
            done = self.close()
        if not self.new:
            fixed = self.system[-1] if self.system and self.number else 0
            while self.past and fixed + self.past_tokens + turn[-1] > self.budget.tokens:
                self.past_tokens -= self.past.popleft()[-1]
            self.room = self.budget.tokens - fixed - self.past_tokens
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        self.new_tokens += turn[-1]
        return done

    def close(self) -> tuple:
        repeated = [*([self.system] if self.system and self.number else []), *self.past]
        text, at, starts, ends = [], 0, [], []
        for i, (role, head, body, tail, _) in enumerate([*repeated, *self.new]):
            if i >= len(repeated) and role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            text += head, body, tail
            at += len(head) + len(body) + len(tail)
        row = self.id, self.number, "".join(text), len(repeated), starts, ends, sum(t[-1] for t in repeated) + self.new_tokens
        for turn in self.new:
            if turn is not self.system:
                self.past.append(turn)
                self.past_tokens += turn[-1]
        while self.past and self.past_tokens > self.budget.history:
            self.past_tokens -= self.past.popleft()[-1]
        self.new, self.new_tokens, self.number = [], 0, self.number + 1
        return row


def _write(budget: Budget):
    schema = pa.schema([
        ("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("repeated", pa.int32()),
        ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32())), ("n_tokens", pa.int64()),
    ])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now: _Conversation | None = None
        for conv_id, role, text in _rows(batches):
            if now is None or now.id != conv_id:
                if now:
                    yield now.close()
                now = _Conversation(conv_id, budget)
            if done := now.add(role or "", text or ""):
                yield done
        if now:
            yield now.close()

    return lambda batches: _batches(windows(batches), schema)


def format_windows(turns: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Windows of every conversation; ``repeated`` leading turns of a window are shown again, loss spans are code
    points of its text."""
    rows = turns.select(F.col("conv_id").cast("bigint"), "turn", F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_write(budget), WINDOWS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    now = None
    for conv_id, text, repeated, starts, ends in _rows(batches):
        if now is None or now[0] != conv_id:
            if now:
                yield _digest(now)
            now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        for i, turn in enumerate(_TURN.finditer(text)):
            if i >= repeated:
                now[1] += 1
                now[2].update(f"{unescape(turn[1])}\n{unescape(turn[2])}\n".encode())
                now[5] += turn.end() - turn.start()
        for start, end in zip(starts, ends, strict=True):
            target = unescape(text[start:end])
            now[3] += len(target)
            now[4].update(target.encode())
    if now:
        yield _digest(now)


def _digest(now: list) -> tuple:
    return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation hold: turns, masked targets and formatted characters, each turn once."""
    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    rows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.select("conv_id", "text", "repeated", "loss_start", "loss_end").mapInArrow(
        lambda batches: _batches(_read(batches), schema), DIGESTS
    )
