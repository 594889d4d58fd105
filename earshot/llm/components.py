"""Connected components of a link table, by repeated joins on staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.scratch import Scratch

#: Links for each task and file of a round.
SHARE = 1_000_000


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; the root is the smallest node reachable.

    Alternates two steps until the links are stars: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. Between rounds each task replaces the links it has, at most ``SHARE`` at a
    time, by stars of the components they make, which shortens chains without a shuffle. A node with very many links is
    grouped with map-side combining and joined, never gathered. No link, no row; loops and repeated links do not matter.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = scratch.stage_observed(edges.mapInArrow(_stars, "u bigint, v bigint"), "links", *_print())
    while True:
        # link tables are often much smaller than what the shuffles are sized for; a round makes no more links than it got
        files = max(1, -(-before[0] // SHARE))
        if files == 1:  # one batch has all that is left
            edges = scratch.stage(edges.coalesce(1).mapInArrow(_stars, "u bigint, v bigint"), "stars")
            break
        # large star: neighbours above u move to the smallest of u and its neighbours
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.stage(large.where("u <> v").distinct().coalesce(files), "large_star")
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        moved = moved.where("u <> v").distinct().coalesce(files).mapInArrow(_stars, "u bigint, v bigint")
        small, after = scratch.stage_observed(moved, "small_star", *_print())
        scratch.drop(large, edges)
        same, before, edges = after == before, after, small
        if same:
            break
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _print() -> tuple[Column, Column]:
    """Equal for equal sets of links: how many, and the sum of their hashes."""
    return F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every node to the smallest node that the links of a share reach, instead of these links."""
    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns]))
        if sum(x.shape[1] for x in held) >= SHARE:
            yield _star(np.concatenate(held, axis=1))
            held = []
    if held:
        yield _star(np.concatenate(held, axis=1))


def _star(links: np.ndarray) -> pa.RecordBatch:
    u, v = forest(*links)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``a[i] - b[i]`` connect: from each node but the smallest of its component to that."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]
