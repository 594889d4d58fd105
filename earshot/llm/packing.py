"""Token ids packed into fixed-length rows by best-fit decreasing.

Texts become byte-level ids (byte + ``SHIFT``; 0 pads, 1 ends a document). A document longer than a row is cut into
full rows and a rest; pieces carry the document and their number, so nothing is lost. Pieces are gathered to
chunks of about ``CHUNK`` tokens within a partition and packed longest first into the row with the least room that
still fits, found by a segment tree over free capacities. No shuffle: a partition packs its own documents, and only
the last row of each chunk has unforced padding. Results of a task depend on its input split alone, so a lost task
is simply run again.

Each result row holds a matrix of up to ``MATRIX`` packed rows as little-endian 16-bit integers, and for each packed
row the cumulative segment lengths (from 0), the places where positions restart, the documents and piece numbers.
Null text: a document of its end mark alone. Null ids stay, repeated rows are packed again, other columns are not
looked at, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark import TaskContext

PAD, END, SHIFT = 0, 1, 3
LENGTH, CHUNK, MATRIX = 2048, 1 << 22, 64


class FreeRows:
    """Rows by free capacity; ``take`` finds the least capacity of at least ``need``."""

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1).bit_length()
        self.some = bytearray(2 * self.leaves)  # whether a subtree has a row
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.leaves
        while at and not self.some[at]:
            self.some[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        at = need + self.leaves
        if not self.some[at]:
            while at > 1 and (at & 1 or not self.some[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.some[2 * at] else 2 * at + 1
        room = at - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[at] = 0
            at >>= 1
            while at and not (self.some[2 * at] or self.some[2 * at + 1]):
                self.some[at] = 0
                at >>= 1
        return room, row


def best_fit(lengths: list[int], length: int) -> list[list[int]]:
    """Indexes of the pieces of each row; pieces in the order they were placed, longest first, ties by index."""
    free, rows = FreeRows(length), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(i)
        if room > lengths[i]:
            free.put(room - lengths[i], row)
    return rows


_SCHEMA = pa.schema([
    ("part", pa.int32()), ("matrix", pa.int64()), ("n_rows", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.list_(pa.int32()))),
    ("position_resets", pa.list_(pa.list_(pa.int32()))), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("pieces", pa.list_(pa.list_(pa.int32()))),
])
COLUMNS = (
    "part int, matrix bigint, n_rows int, ids binary, cu_seqlens array<array<int>>, position_resets array<array<int>>, "
    "doc_ids array<array<bigint>>, pieces array<array<int>>"
)


def _matrices(pieces: list[tuple], length: int) -> Iterator[tuple]:
    rows = best_fit([len(p[2]) for p in pieces], length)
    for first in range(0, len(rows), MATRIX):
        part = rows[first : first + MATRIX]
        ids = np.full((len(part), length), PAD, "<u2")
        cumulative, resets, docs, numbers = [], [], [], []
        for r, own in enumerate(part):
            ends = np.cumsum([len(pieces[i][2]) for i in own])
            ids[r, : ends[-1]] = np.concatenate([pieces[i][2] for i in own])
            cumulative.append([0, *ends.tolist()])
            resets.append([0, *ends[:-1].tolist()])
            docs.append([pieces[i][0] for i in own])
            numbers.append([pieces[i][1] for i in own])
        yield len(part), ids.tobytes(), cumulative, resets, docs, numbers


def pack(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK) -> DataFrame:
    """Matrices of packed rows, see above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens, number = [], 0, 0
        part = TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, number
            for found in _matrices(held, length):
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, (part, number, *found), strict=True))], _SCHEMA)
                number += 1
            held, tokens = [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid and text.as_buffer().size else np.zeros(0, np.uint8)
                ids = np.empty(len(raw) + 1, "<u2")
                np.add(raw, SHIFT, out=ids[:-1], dtype=np.uint16, casting="unsafe")
                ids[-1] = END
                held += [(doc_id.as_py(), i, ids[a : a + length]) for i, a in enumerate(range(0, len(ids), length))]
                tokens += len(ids)
                if tokens >= chunk:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, COLUMNS)


def position_ids(resets: list[int], length: int) -> np.ndarray:
    """Positions of one packed row, restarting at each segment (padding goes on counting)."""
    at = np.arange(length)
    return at - np.repeat(resets, np.diff([*resets, length]))


def unpack(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, text_bytes`` of every segment, without end marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], "<u2").reshape(row["n_rows"], length)
                docs, pieces, texts = [], [], []
                for r, cut in enumerate(row["cu_seqlens"]):
                    for a, b, d, p in zip(cut, cut[1:], row["doc_ids"][r], row["pieces"][r], strict=False):
                        own = ids[r, a:b]
                        docs.append(d)
                        pieces.append(p)
                        texts.append((own[own != END] - SHIFT).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(texts, pa.binary())], ["doc_id", "piece", "text_bytes"])

    return packed.mapInArrow(run, "doc_id bigint, piece int, text_bytes binary")
