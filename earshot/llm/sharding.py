"""Shards of bounded size by extendible hashing, in DataFrame functions only.

A row's hash is a 64-bit number; a shard is a prefix of its bits. All rows begin in one shard of depth 0, and only
a shard over the byte limit is split on the next bit. Instead of splitting bit by bit, rows are counted once by a
prefix a little longer than needed, and the sums of all shorter prefixes follow from that small table; a row's shard
is its shortest prefix that fits. Rows whose prefix is still too large are counted again by a longer one.

Equal rows have equal hashes and cannot be split by bits: such a group over the limit is dealt into numbered pages
that fit, in salted parts, so no task numbers the whole group. A single row over the limit is a page of its own.
Null ids and texts hash like any other value (a null text has no bytes beside ``ROW_BYTES``); an empty table gives
an empty result. Only ids and texts are looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch, fresh

LIMIT = 32 << 20
#: Counted for each row beside its text.
ROW_BYTES = 32
SPARE_BITS, MORE_BITS = 5, 12
#: Equal rows that one task numbers.
SALT_ROWS = 50_000


def _prefix(depth: Column | int) -> Column:
    """The first ``depth`` bits of ``h`` as a number."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    # a shift by 64 would shift by 0
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", F.col("h"), (64 - depth).cast("int")))


def _name(depth: Column, bits: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(bits), depth.cast("int"), "0"))


def _depths(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """``cell`` (the first ``high`` bits) and the least depth from ``low`` to ``high`` at which its prefix fits, or null."""
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    up = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    up = up.withColumn("bits", F.call_function("shiftrightunsigned", F.col("cell"), (high - F.col("depth")).cast("int")))
    fits = up.groupBy("depth", "bits").agg(F.sum("bytes").alias("total")).where(F.col("total") <= limit)
    found = up.join(fits, ["depth", "bits"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return cells.select("cell").join(found, "cell", "left")


def _levels(counted: DataFrame, limit: int, scratch: Scratch) -> tuple[list[tuple[int, DataFrame]], bool]:
    """For each length of counted prefixes the depths of its cells; whether groups of equal rows are left over."""
    total = counted.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    low, high = 0, min(64, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    levels, left = [], counted
    while True:
        cells = scratch.stage(_depths(left, low, high, limit), "cells")
        levels.append((high, cells))
        if not cells.where("depth is null").head(1):
            return levels, False
        if high == 64:
            return levels, True
        left = scratch.stage(left.withColumn("cell", _prefix(high)).join(cells.where("depth is null"), "cell").select("h", "bytes"), "left")
        low, high = high + 1, min(64, high + MORE_BITS)


def _place(rows: DataFrame, levels: list[tuple[int, DataFrame]], equal_left: bool, limit: int, scratch: Scratch) -> DataFrame:
    """``rows`` (with ``h`` and ``bytes``) with ``shard_id`` and ``depth``."""
    columns, placed = rows.columns, []
    for high, cells in levels:
        split = rows.withColumn("cell", _prefix(high)).join(cells, "cell")
        placed.append(split.where("depth is not null").select(*columns, "depth", _name(F.col("depth"), _prefix(F.col("depth"))).alias("shard_id")))
        rows = split.where("depth is null").select(*columns)
    if equal_left:
        placed.append(_pages(rows, limit, scratch))
    return reduce(DataFrame.unionByName, placed)


def _pages(equal: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Rows of one hash, dealt into pages that fit (or hold one row). How rows are dealt depends on where they lie, so the
    result is staged: a task that runs again later finds each row in the same page."""
    salts = F.ceil(F.count("*") / F.lit(SALT_ROWS)).alias("salts")
    counted = scratch.stage(equal.groupBy("h").agg(salts), "equal_rows")
    salted = equal.join(counted, "h").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.col("salts"))).drop("salts")
    number = F.row_number().over(Window.partitionBy("h", "salt").orderBy("bytes"))
    largest = F.max("bytes").over(Window.partitionBy("h", "salt"))
    page = F.floor((number - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / largest)))
    name = F.concat_ws("-", F.lpad(F.bin("h"), 64, "0"), F.col("salt").cast("string"), page.cast("string"))
    return scratch.stage(salted.withColumn("shard_id", name).select(*equal.columns, F.lit(64).alias("depth"), "shard_id"), "pages")


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.col("text").cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint")
    return docs.select(*more, F.xxhash64(F.col("doc_id").cast("bigint"), text).alias("h"), size.alias("bytes"))


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, shard_id, depth, shard_rows, shard_bytes`` for each row; ``shard_id`` is the prefix in binary digits,
    with salt and page after it where equal rows or one long row exceed the limit."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.stage(_hashed(docs, F.col("doc_id").cast("bigint")), "rows")
    levels, equal_left = _levels(rows.select("h", "bytes"), limit, scratch)
    placed = scratch.stage(_place(rows, levels, equal_left, limit, scratch), "placed")
    sizes = placed.groupBy("shard_id").agg(F.count("*").alias("shard_rows"), F.sum("bytes").alias("shard_bytes"))
    sizes = scratch.stage(sizes, "sizes")
    return placed.join(sizes, "shard_id").select("doc_id", "shard_id", F.col("depth").cast("int").alias("depth"), "shard_rows", "shard_bytes")


def write(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write all columns of ``docs`` as Parquet, with a folder for each shard."""
    scratch = Scratch(docs.sparkSession)
    counted = scratch.stage(_hashed(docs), "rows")
    levels, equal_left = _levels(counted, limit, scratch)
    (shard,) = fresh(docs, "shard_id")
    placed = _place(_hashed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("row")), levels, equal_left, limit, scratch)
    placed.select("row.*", F.col("shard_id").alias(shard)).repartition(shard).write.partitionBy(shard).parquet(path)
