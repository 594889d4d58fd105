"""Near-duplicate documents by SimHash fingerprints and a hierarchical index over their Gray order.

1. A bit of a fingerprint is set if it is in over half of the hashes of a text's word shingles, repeats included.
   Equal fingerprints form one class, so copies cost one row each from here on.
2. Distinct fingerprints are sorted by their rank in the reflected Gray code, in which neighbours differ in few bits,
   and cut into leaves of consecutive ones. A leaf keeps the bits that all its members share (a mask and a pattern); a
   node above keeps what its ``FANOUT`` children share, up to one root.
3. The index is joined with itself from the root down. Differences accumulate on the way: a node shares all bits that
   its parent shares and more, so once two nodes differ in more than ``distance`` bits that both share, all pairs below
   them are pruned at once. What is left at the bottom is compared leaf by leaf. Each level is an equality join on the
   parents. A node meets those nodes only that differ in up to ``distance`` of the bits they share, whose number grows
   with the square of the tree's depth (not with the rows), also where very many fingerprints are close together.
4. Every link counts, but of the links in a batch a task returns a spanning forest. Links join classes into components.

Null or wordless texts have the fingerprint zero, which is linked like any other. With fewer words than a shingle, the
whole sequence is the only one. Rows that share a ``doc_id`` are one document: their fingerprints are in one component.
A null ``doc_id`` is no document: it names no component and links nothing, its own component is null. No rows, no
result. Other columns are not looked at. Long texts are hashed in pieces of about ``PIECE`` bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.components import components, forest
from earshot.llm.scratch import Scratch
from earshot.operators.ordered import order_log

#: Fingerprints in a leaf and children of a node above it, as powers of two.
LEAF, FANOUT = 8, 4
PIECE = 1 << 20
SEED = 42
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and how many bits linked fingerprints differ in at most."""

    shingle: int = 5
    distance: int = 3


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    at = 0
    while at < len(text):
        found = _SPACE.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield text[at:end].split()  # splits at the same six ASCII characters
        at = end


def _hashes(text: bytes, shingle: int) -> Iterator[list[int]]:
    held: list[bytes] = []
    seen = False
    for words in _words(text.translate(_LOWER)):
        held += words
        if len(held) >= shingle:
            joined = b" ".join(held)
            ends = np.cumsum([len(w) + 1 for w in held])
            starts = (ends - [len(w) + 1 for w in held])[: len(held) - shingle + 1].tolist()
            yield [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
            held = held[len(held) - shingle + 1 :]
            seen = True
    if held and not seen:
        yield [xxhash.xxh64_intdigest(b" ".join(held), SEED)]


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have bit 0, 1, ... set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), COUNTED):
        some = np.array(hashes[at : at + COUNTED], "<u8")
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int) -> int:
    """As a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in _hashes((text or "").encode(), shingle):
        ones += _ones(hashes)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, print`` for each row; ``print`` is the fingerprint as a bigint."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return texts.mapInArrow(_fingerprints(rule.shingle), "doc_id bigint, print bigint")


def gray_rank(bits: Column) -> Column:
    """Place of a 64-bit value in the reflected Gray code, as a bigint that sorts like the unsigned place."""
    for n in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, n))
    return bits.bitwiseXOR(F.lit(-(1 << 63)))


def _levels(prints: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Tables of nodes, leaves first, a single root last: ``node, parent, shared, pattern`` and for leaves ``members``."""
    log = order_log(prints.select("print", gray_rank(F.col("print")).alias("gray")), ("gray",))
    place = F.col("row_index") - 1
    shared = F.bitwise_not(F.expr("bit_or(high)").bitwiseXOR(F.expr("bit_and(low)")))
    node = [shared.alias("shared"), F.expr("bit_and(low)").alias("low"), F.expr("bit_or(high)").alias("high")]
    rows = log.rows.select(F.shiftright(place, LEAF).alias("node"), "print", F.col("print").alias("low"), F.col("print").alias("high"))
    count, tables = log.count, []
    while True:
        members = [] if tables else [F.sort_array(F.collect_list("print")).alias("members")]  # a leaf's worth
        level = rows.groupBy("node").agg(*node, *members).withColumn("parent", F.shiftright("node", FANOUT))
        tables.append(scratch.stage(level, f"level_{len(tables)}"))
        count = -(-count // (1 << (FANOUT if len(tables) > 1 else LEAF)))
        if count <= 1:
            return tables
        rows = tables[-1].select(F.col("parent").alias("node"), "low", "high")


def _leaf_pairs(levels: list[DataFrame], distance: int, scratch: Scratch) -> DataFrame:
    """``a, b``: leaves that may hold a link, each pair once."""
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(levels[:-1]):
        x, y = (
            level.select(F.col("parent").alias(side), F.col("node").alias(f"node_{side}"), F.col("shared").alias(f"shared_{side}"), F.col("low").alias(f"low_{side}"))
            for side in "ab"
        )
        both = F.col("shared_a").bitwiseAND(F.col("shared_b"))
        apart = F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b")).bitwiseAND(both))
        left = pairs.join(x, "a")
        near = left.join(y, (left["b"] == y["b"]) & (F.col("node_a") <= F.col("node_b")) & (apart <= distance))
        below = scratch.stage(near.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "node_pairs")
        scratch.drop(pairs)
        pairs = below
    return pairs


def _compare(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray]] = []
            sides = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("members_a"), batch.column("members_b"))]
            for i in range(batch.num_rows):
                p, q = (values[offsets[i] : offsets[i + 1]] for values, offsets in sides)
                x, y = np.nonzero(np.bitwise_count((p[:, None] ^ q[None, :]).view(np.uint64)) <= distance)
                apart = p[x] != q[y]  # a leaf with itself
                if apart.any():
                    found.append((p[x[apart]], q[y[apart]]))
            if found:
                a, b = forest(*map(np.concatenate, zip(*found, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(prints: DataFrame, distance: int, scratch: Scratch) -> DataFrame:
    """``a, b``: fingerprints that pairs at ``distance`` or less connect, from a table of distinct ones."""
    levels = _levels(prints, scratch)
    pairs = _leaf_pairs(levels, distance, scratch)
    sides = [levels[0].select(F.col("node").alias(s), F.col("members").alias(f"members_{s}")) for s in "ab"]
    # rows are wide, so the work is dealt evenly after the first side has come to the pairs
    met = pairs.join(sides[0], "a").join(sides[1], "b").select("members_a", "members_b")
    found = scratch.stage(met.mapInArrow(_compare(distance), "a bigint, b bigint").distinct(), "links")
    scratch.drop(pairs, *levels)
    return found


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for each row of ``docs(doc_id, text, ...)``."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.stage(fingerprints(docs, rule), "fingerprints")
    named = prints.where("doc_id is not null")
    classes = scratch.stage(named.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "classes")
    found = links(classes, rule.distance, scratch)
    again = named.groupBy("doc_id").agg(F.min("print").alias("b"), F.max("print").alias("most")).where("b < most")
    same = named.join(again.select("doc_id", "b"), "doc_id").where("print <> b").select(F.col("print").alias("a"), "b").distinct()
    roots = scratch.stage(components(found.union(same), scratch), "components")
    joined = classes.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    lows = joined.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    # the smallest print names a component, so the classes outside of any are their own
    member = scratch.stage(joined.select("print", "root").join(lows, "root").select("print", "component_id"), "members")
    scratch.drop(found, roots, classes)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return prints.join(member, "print", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
