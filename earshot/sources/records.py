"""Quoted CSV with line breaks in its fields, read in parallel.

Whether a byte range of a file starts inside quotes depends on all ranges before it, which is why such files are often
read by one task each. Here a first pass over the lines counts the quotes of every input split; the running parity of
these counts (one row for each split) tells which splits start inside a field. A second pass then puts records together
within each split, all splits at once. A record that crosses splits leaves its pieces behind, at most two for each
split, and these are joined in order. Quotes inside a field are doubled (RFC 4180), so they do not change the parity.

Lines end with a line feed, a carriage return before it is taken off at the end of a record and kept inside quotes.
Compressed files cannot be split and are one split each. Blank lines between records are left out.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.sources.staging import stage

RECORD, HEAD, TAIL, HEADER = "record", "head", "tail", "header"
#: How a record's text is parsed: as the file would be, line breaks and all.
PARSE = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
#: Input splits whose parities are sent to every task. Files of more splits need a larger spark.sql.files.maxPartitionBytes.
MOST_SPLITS = 2_000_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _parities(lines: DataFrame) -> DataFrame:
    """``file, start, inside``: whether a split starts inside quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    splits = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return stage(splits.select("file", "start", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1).alias("inside")), "splits")


class _Split:
    """Puts the records of one split together, a batch of lines at a time."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.headed = start == 0  # and the header is still to come
        self.held: list[str] = []
        self.first = inside  # what is held began in an earlier split

    def add(self, lines: pa.Array, odd: list[bool]) -> Iterator[tuple[str, str]]:
        at = 0
        for i in [j for j, x in enumerate(odd) if x]:
            if self.inside:
                self.held += lines[at : i + 1].to_pylist()
                yield HEAD if self.first else RECORD, "\n".join(self.held)
                self.held, self.first = [], False
            else:
                yield from ((RECORD, x) for x in lines[at:i].to_pylist())
                self.held = [lines[i].as_py()]
            self.inside = not self.inside
            at = i + 1
        rest = lines[at:].to_pylist()
        if self.inside:
            self.held += rest
        else:
            yield from ((RECORD, x) for x in rest)

    def close(self) -> Iterator[tuple[str, str]]:
        if self.held:
            yield HEAD if self.first else TAIL, "\n".join(self.held)


def _assemble(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    now: _Split | None = None

    def out(rows: Iterator[tuple[str, str]], split: _Split) -> Iterator[pa.RecordBatch]:
        rows = list(rows)
        for i, (kind, text) in enumerate(rows if split.headed else ()):
            if kind == RECORD and text.strip():
                if _names(next(csv.reader([text]))) != list(names):
                    raise ValueError(f"{split.file} has another header: {text[:1000]}")
                rows[i] = HEADER, text
                split.headed = False
                break
        if rows:
            kinds, texts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([split.file] * len(rows)), pa.array([split.start] * len(rows), pa.int64()), pa.array(kinds), pa.array(texts, pa.string())],
                ["file", "start", "kind", "text"],
            )

    for batch in batches:
        files, starts, inside = (batch.column(c).to_pylist() for c in ("file", "start", "inside"))
        values = batch.column("value")
        odd = pc.equal(pc.bit_wise_and(pc.count_substring(values, '"'), 1), 1).to_pylist()
        at = 0
        while at < len(files):
            end = at
            while end < len(files) and (files[end], starts[end]) == (files[at], starts[at]):
                end += 1
            if now is None or (now.file, now.start) != (files[at], starts[at]):
                if now:
                    yield from out(now.close(), now)
                now = _Split(files[at], starts[at], inside[at])
            yield from out(now.add(values[at:end], odd[at:end]), now)
            at = end
    if now:
        yield from out(now.close(), now)


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, text``: every record but the header of the files below ``path``, as it stands there."""
    names = header(spark, path)
    lines = _lines(spark, path)
    splits = _parities(lines)
    total, open_ = splits.agg(F.count("*"), F.count_if("inside")).first()
    if total > MOST_SPLITS:
        raise ValueError(f"{total} input splits; raise spark.sql.files.maxPartitionBytes")
    # a broadcast keeps the lines in the order of the scan, which the second pass relies on
    placed = lines.join(F.broadcast(splits), ["file", "start"]).select("value", "file", "start", "inside")
    found = placed.mapInArrow(lambda batches: _assemble(batches, names), "file string, start bigint, kind string, text string")
    whole = found.where(F.col("kind") == RECORD).select("file", "text")
    if open_:
        pieces = stage(found.where(F.col("kind").isin(HEAD, TAIL)), "pieces")  # at most two for each split
        order = Window.partitionBy("file").orderBy("start", F.col("kind") == TAIL)
        numbered = pieces.withColumn("n", F.count_if(F.col("kind") == TAIL).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        parts = F.sort_array(F.collect_list(F.struct("start", (F.col("kind") == TAIL).alias("last"), "text")))
        joined = numbered.groupBy("file", "n").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
        whole = whole.unionByName(joined.select("file", "text"))
    text = F.regexp_replace("text", r"\r\z", "")
    return whole.select("file", text.alias("text")).where(F.trim("text") != "")


def header(spark: SparkSession, path: str) -> list[str]:
    """Field names in the first record of the first file."""
    n = 1
    while True:
        lines = [r.value for r in spark.read.option("lineSep", "\n").text(path).head(n)]
        found = next(csv.reader([x + "\n" for x in lines if x.strip()]), [])
        if len(lines) < n or found and sum(x.count('"') for x in lines) % 2 == 0:
            return _names(found)
        n *= 4


def _names(record: Sequence[str]) -> list[str]:
    return [x.removeprefix("\ufeff").strip("\r\n") for x in record]


def read_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Text columns called ``names`` (one for each field of the header). A file with another header fails the job."""
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records(spark, path).select(F.from_csv("text", F.lit(fields), PARSE).alias("row"))
    return rows.select("row.*")
