"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Every text becomes its set of distinct word shingles, hashed to 63 bits. Equal sets form a class with one
   representative, so exact copies cost one row each from here on.
2. The ``k`` smallest hashes of a set are its sketch. Retained values that lie in one sketch only are dropped;
   of the rest a representative posts its rarest ones, as many as make it sure (exactly for small sets, up to
   ``MISS`` for larger ones) that two linked sets meet in one inverted list. Frequent values are so never posted
   by texts that have enough others.
3. The nodes of a list are compared with the first of them. The sketch of the union estimates the similarity of a
   pair; what passes is confirmed on the full sets.
4. What the estimate found near forms clusters, which take in the rest of the long lists they lie in. Components of
   one cluster are compared in blocks by their full sets. Nodes that meet in a list without sharing a cluster are
   compared by their sketches within the list (long lists in blocks, too), and only what passes leaves the task. No two
   nodes of a component are compared.
5. Links join representatives into components; members follow through their class.

Null text, no words: empty set, linked with nothing. Fewer words than a shingle: the whole sequence is the only
shingle. A null ``doc_id`` is linked with nothing, its component is null and it is kept. Rows that share a
``doc_id`` count as one document. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import bytewords
from earshot.llm.components import components
from earshot.llm.scratch import Scratch

#: Accepted chance that a link at the threshold shows too few shared retained values.
MISS = 1e-9
#: Lists of each node that are compared with their first node, and how long one must be to be a cluster by itself.
WIDEST, WIDE = 3, 64
#: Bytes of sets and number of sets in a block, columns of the matrix made of them at once, and nodes of a list's block.
BLOCK, BLOCK_SETS, COLUMNS, LIST = 1 << 20, 2048, 4096, 2048
#: Nodes of a list that are compared pair by pair rather than by a matrix.
FEW = 12


@dataclass(frozen=True)
class Rule:
    """Word shingle length, threshold in hundredths and sketch size."""

    shingle: int = 5
    percent: int = 80
    k: int = 64

    def sure_overlap(self) -> int:
        """Retained values that a linked pair shares but for a chance of ``MISS``."""
        p, below = self.percent / 100, 0.0
        for s in range(self.k + 1):
            below += math.comb(self.k, s) * p**s * (1 - p) ** (self.k - s)
            if below > MISS:
                return s
        return self.k


def _sets(part: bytewords.Slice, shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = bytewords.pieces(part, bytewords.SPACE, bytewords.LOWER)
    cut = bytewords.bounds(words, part.n)
    for i in range(part.n):
        own = words.hash[cut[i] : cut[i + 1]]
        found = bytewords.grams(own, min(shingle, len(own))) if len(own) else own
        yield np.unique(found >> np.uint64(1)).view(np.int64)


def _sketches(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch.column("text")):
                sets = list(_sets(part, rule.shingle))
                low = [s[: rule.k] for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(part.first, part.n),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(np.cumsum([0, *map(len, low)]).astype(np.int32), np.concatenate(low)),
                ], ["doc_id", "n", "digest", "sketch"])

    return run


def _full_sets(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bytewords.slices(batch.column("text")):
                sets = [s.tobytes() for s in _sets(part, rule.shingle)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, part.n), pa.array(sets, pa.large_binary()).cast(pa.binary())],
                    ["node", "members"],
                )

    return run


def _confirm(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("members_a"), batch.column("members_b")
            keep = []
            for x, y in zip(a, b, strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Search:
    def __init__(self, docs: DataFrame, rule: Rule, scratch: Scratch):
        self.docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
        self.rule, self.scratch = rule, scratch
        self.sketched = scratch.stage(
            self.docs.mapInArrow(_sketches(rule), "doc_id bigint, n bigint, digest binary, sketch array<bigint>"),
            "sketches",
        )
        some = self.sketched.where("digest is not null and doc_id is not null")
        self.classes = scratch.stage(
            some.groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes"
        )
        self.nodes = scratch.stage(
            some.join(self.classes.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"])
            .dropDuplicates(["digest", "doc_id"]).select(F.col("doc_id").alias("node"), "n", "sketch"),
            "nodes",
        )

    def postings(self) -> DataFrame:
        """``(v, node, n, big)``: the rarest retained values of each node among those that others retain too; ``big``
        marks the ``WIDEST`` of them that most others retain."""
        rule, k = self.rule, self.rule.k
        share = 100 - rule.percent
        held = F.least("n", F.lit(k))
        far = F.floor(F.col("n") * share / rule.percent)  # members that a linked set may lack
        # by the size of the union: up to k values, sketches are whole sets; above, k of its values are looked at
        whole, part = F.ceil(F.col("n") * rule.percent / 100), F.greatest(F.lit(rule.sure_overlap()), k - far)
        sure = F.when(F.col("n") * 100 <= rule.percent * k, whole).when(F.col("n") < k, F.least(whole, part)).otherwise(part)
        length = held - sure + 1
        every = self.nodes.select("node", "n", F.size("sketch").alias("held"), length.alias("length"), F.explode("sketch").alias("v"))
        shared = every.groupBy("v").count().where("count > 1")
        met = every.join(shared, "v").select("node", "n", "held", "length", F.struct("count", "v").alias("p"))
        # a node has at most k of them
        ranked = met.groupBy("node", "n", "held", "length").agg(F.sort_array(F.collect_list("p")).alias("p"))
        left = F.col("length") - (F.col("held") - F.size("p"))
        ranked = ranked.where(left > 0).withColumn("p", F.slice("p", 1, left.cast("int")))
        return ranked.select("node", "n", F.size("p").alias("z"), F.posexplode("p").alias("i", "p")).select(
            "p.v", "p.count", "node", "n", (F.col("i") >= F.col("z") - WIDEST).alias("big")
        )

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` that the union's sketch lets through and the full sets confirm."""
        rule, stage = self.rule, self.scratch.stage
        of = lambda side: self.nodes.select(
            F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")
        )
        union = F.array_union("s_a", "s_b")
        shared = F.array_intersect("s_a", "s_b")
        low = F.slice(F.array_sort(union), 1, rule.k)
        whole = (F.col("n_a") <= rule.k) & (F.col("n_b") <= rule.k)
        passes = F.when(whole, 100 * F.size(shared) >= rule.percent * F.size(union)).otherwise(
            F.size(F.array_intersect(shared, low)) >= rule.sure_overlap()
        )
        sizes = (100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b"))
        likely = stage(pairs.join(of("a"), "a").join(of("b"), "b").where(sizes).where(passes).select("a", "b"), "likely")
        sets = self.full_sets(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sides = [sets.select(F.col("node").alias(s), F.col("members").alias(f"members_{s}")) for s in "ab"]
        links = stage(
            likely.join(sides[0], "a").join(sides[1], "b").mapInArrow(_confirm(rule), "a bigint, b bigint").distinct(), "links"
        )
        self.scratch.drop(sets)
        return likely, links

    def full_sets(self, nodes: DataFrame) -> DataFrame:
        """``node, members`` (the sorted hashes as bytes), made again from the texts."""
        wanted = self.scratch.stage(nodes, "wanted")
        texts = self.docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
        sets = texts.mapInArrow(_full_sets(self.rule), "node bigint, members binary").dropDuplicates(["node", "members"])
        sets = self.scratch.stage(sets, "full_sets")
        self.scratch.drop(wanted)
        return sets

    def block_links(self, clusters: DataFrame, root: DataFrame) -> DataFrame:
        """A link for each two components of a cluster that have one. A cluster is cut into blocks of about ``BLOCK``
        bytes of sets; each task compares two blocks by a matrix product and returns links between different
        components only, so neither a task nor the output grows with the square of a cluster."""
        nodes = clusters.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = self.nodes.groupBy("node").agg(F.max("n").alias("n"))
        nodes = self.scratch.stage(nodes.join(sizes, "node"), "clustered")
        parts = nodes.groupBy("cluster", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
        parts = parts.groupBy("cluster").agg(
            F.max_by("root", "c").alias("most"), F.max_by("n", "c").alias("most_n"), F.max("c").alias("most_c"), F.sum("n").alias("all_n"),
            F.sum("c").alias("all_c"), F.count("*").alias("parts"),
        ).where("parts > 1")
        blocks = lambda n, c: F.greatest(F.lit(1), F.ceil(n * 8 / F.lit(BLOCK)), F.ceil(c / F.lit(BLOCK_SETS))).cast("int")
        few = blocks(F.col("all_n") - F.col("most_n"), F.col("all_c") - F.col("most_c"))
        parts = parts.select("cluster", "most", blocks(F.col("all_n"), F.col("all_c")).alias("blocks"), few.alias("few_blocks"))
        live = self.scratch.stage(nodes.join(parts, "cluster"), "live_clusters")
        sets = self.full_sets(live.select("node").distinct())
        own = lambda b: F.pmod(F.xxhash64("node"), F.col(b)).cast("int")
        few = live.where("root <> most").select("cluster", own("few_blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "node", "root", F.lit(0).alias("side"))
        every = live.select("cluster", F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("i"), own("blocks").alias("j"), "node", "root", F.lit(1).alias("side"))
        rows = few.unionByName(every).join(sets, "node")
        links = self.scratch.stage(
            rows.groupBy("cluster", "i", "j").applyInArrow(_compare_blocks(self.rule.percent), "a bigint, b bigint"), "block_links"
        )
        self.scratch.drop(nodes, live, sets)
        return links

    def near_in_lists(self, lists: DataFrame) -> DataFrame:
        """Pairs that meet in a list, in different components and clusters, and whose sketches pass."""
        parts = lists.groupBy("v", "root").count()
        open_ = parts.groupBy("v").agg(F.max_by("root", "count").alias("most"), F.sum("count").alias("size"), F.count("*").alias("parts")).where("parts > 1")
        live = self.scratch.stage(lists.select("v", "node", "n", "root", "clusters").join(open_.select("v", "most", "size"), "v"), "live_lists")
        sketches = self.nodes.groupBy("node", "n").agg(F.first("sketch").alias("sketch"))
        own_lists = live.groupBy("node").agg(F.collect_set("v").alias("lists"))  # at most as many as a sketch has values
        blocks = F.ceil(F.col("size") / LIST).cast("int")
        own = F.pmod(F.xxhash64("node"), blocks).cast("int")
        dealt = live.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cells = dealt.select(
            "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "root", (F.col("root") != F.col("most")).alias("few"), "clusters"
        ).join(sketches, ["node", "n"]).join(own_lists, "node")
        found = cells.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j").mapInArrow(_compare_lists(self.rule), "a bigint, b bigint")
        return found

    def components(self) -> DataFrame:
        stage, drop = self.scratch.stage, self.scratch.drop
        posted = stage(self.postings(), "postings")
        first = stage(_to_first(posted).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
        likely, linked = self.linked(first)
        # enough to leave out most pairs that are connected already: the smallest node that one is linked with
        root = stage(linked.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "roots")
        coarse = stage(components(likely, self.scratch), "coarse")
        clusters = stage(_clusters(posted, coarse), "clusters")
        blocks = self.block_links(clusters, root)
        of_node = clusters.groupBy("node").agg(F.collect_set("cluster").alias("clusters"))  # at most 1 + WIDEST
        lists = posted.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(of_node, "node", "left")
        rest = self.near_in_lists(lists).distinct()
        rest = stage(rest.join(first, ["a", "b"], "left_anti"), "pairs")
        more_likely, more = self.linked(rest)
        found = stage(components(linked.union(blocks).union(more), self.scratch), "components")
        drop(posted, first, likely, linked, root, coarse, clusters, blocks, rest, more_likely, more)
        return found


def _shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets have in common, as a matrix."""
    both = np.zeros((len(x), len(y)), np.float32)
    sides = [np.concatenate(s) for s in (x, y)]
    shared = np.intersect1d(*sides)
    at = [np.repeat(np.arange(len(s)), [len(v) for v in s]) for s in (x, y)]
    for s in (0, 1):
        found = np.isin(sides[s], shared)
        sides[s], at[s] = np.searchsorted(shared, sides[s][found]), at[s][found]
    for low in range(0, len(shared), COLUMNS):
        dense = []
        for s, n in enumerate(both.shape):
            inside = (sides[s] >= low) & (sides[s] < low + COLUMNS)
            m = np.zeros((n, min(COLUMNS, len(shared) - low)), np.float32)
            m[at[s][inside], sides[s][inside] - low] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    return both.astype(np.int32)


def _compare_blocks(percent: int):
    def run(rows: pa.Table) -> pa.Table:
        side, node, root = (rows.column(c).to_numpy() for c in ("side", "node", "root"))
        members = rows.column("members").to_pylist()
        at = [np.flatnonzero(side == s) for s in (0, 1)]
        none = np.zeros(0, np.int64)
        if not len(at[0]) or not len(at[1]):
            return pa.table({"a": none, "b": none})
        sets = [[np.frombuffer(members[i], np.int64) for i in a] for a in at]
        sizes = [np.array([len(x) for x in s], np.int32) for s in sets]
        both = _shared(*sets)
        roots = [root[a] for a in at]
        x, y = np.nonzero(100 * both >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))
        apart = roots[0][x] != roots[1][y]
        x, y = x[apart], y[apart]
        _, one = np.unique(np.stack([roots[0][x], roots[1][y]]), axis=1, return_index=True)
        return pa.table({"a": node[at[0]][x[one]], "b": node[at[1]][y[one]]})

    return run


class _ListNode:
    __slots__ = ("clusters", "few", "lists", "n", "node", "own", "root", "sketch")

    def __init__(self, own: int, node: int, n: int, root: int, few: bool, clusters: list | None, sketch: list, lists: list):
        self.own, self.node, self.n, self.root, self.few = own, node, n, root, few
        self.clusters, self.lists, self.sketch = set(clusters or ()), set(lists), np.array(sketch, np.int64)


def _compare_lists(rule: Rule):
    sure, k, percent = rule.sure_overlap(), rule.k, rule.percent

    def apart(v: int, x: _ListNode, y: _ListNode) -> bool:
        """Whether the pair is to be looked at, and in this list: the first of those that both are in."""
        similar = 100 * min(x.n, y.n) >= percent * max(x.n, y.n)
        return similar and x.root != y.root and (x.few or y.few) and not x.clusters & y.clusters and min(x.lists & y.lists) == v

    def near(x: _ListNode, y: _ListNode) -> bool:
        """As for first pairs: whole sets are compared, otherwise the sketch of the union estimates."""
        shared = np.intersect1d(x.sketch, y.sketch, assume_unique=True)
        if max(x.n, y.n) <= k:
            return 100 * len(shared) >= percent * (x.n + y.n - len(shared))
        union = np.union1d(x.sketch, y.sketch)
        return np.count_nonzero(shared <= union[min(k, len(union)) - 1]) >= sure

    def pairs(cell: tuple, nodes: list[_ListNode]) -> Iterator[tuple[int, int]]:
        v, i, j = cell
        low = [x for x in nodes if x.own == i]
        high = low if i == j else [x for x in nodes if x.own == j]
        if len(nodes) <= FEW:
            met = ((x, y) for p, x in enumerate(low) for y in (low[p + 1 :] if i == j else high))
        elif not low or not high:
            return
        else:
            both = _shared([x.sketch for x in low], [x.sketch for x in high])
            n, m = (np.array([x.n for x in s]) for s in (low, high))
            whole = (n[:, None] <= k) & (m[None, :] <= k)
            p, q = (np.array([x.root for x in s]) for s in (low, high))
            f, g = (np.array([x.few for x in s]) for s in (low, high))
            open_ = (p[:, None] != q[None, :]) & (f[:, None] | g[None, :])
            enough = open_ & np.where(whole, 100 * both >= percent * (n[:, None] + m[None, :] - both), both >= sure)
            if i == j:
                enough = np.triu(enough, 1)
            met = ((low[p], high[q]) for p, q in np.argwhere(enough))
        for x, y in met:
            if apart(v, x, y) and near(x, y):
                yield min(x.node, y.node), max(x.node, y.node)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes = None, []
        for batch in batches:
            found: list[tuple[int, int]] = []
            columns = (batch.column(c).to_pylist() for c in ("v", "i", "j", "own", "node", "n", "root", "few", "clusters", "sketch", "lists"))
            for v, i, j, *rest in zip(*columns, strict=True):
                if cell != (v, i, j):
                    found += pairs(cell, nodes) if nodes else ()
                    cell, nodes = (v, i, j), []
                nodes.append(_ListNode(*rest))
            yield _pairs(found)
        yield _pairs(list(pairs(cell, nodes)) if nodes else [])

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], ["a", "b"])


def _to_first(lists: DataFrame) -> DataFrame:
    """Every node with the smallest one of its widest lists."""
    big = lists.where("big")
    first = big.groupBy("v").agg(F.min("node").alias("x"), F.max("node").alias("z")).where("x < z")
    return big.join(first, "v").where("node <> x").select("x", F.col("node").alias("y"))


def _clusters(posted: DataFrame, coarse: DataFrame) -> DataFrame:
    """``(node, cluster)``: the nodes that the estimate found near each other, and with them all nodes of wide lists in
    which they are most. A wide list without such nodes is a cluster of its own."""
    own = coarse.select("node", F.col("root").alias("cluster"))
    big = posted.where("big").select("v", "node").join(own, "node", "left")
    parts = big.groupBy("v", "cluster").agg(F.count("*").alias("c"), F.min("node").alias("low"))
    most = F.max_by("cluster", F.when(F.col("cluster").isNotNull(), F.col("c")))
    wide = parts.groupBy("v").agg(F.sum("c").alias("c"), F.coalesce(most, F.min("low")).alias("label")).where(F.col("c") >= WIDE)
    return own.union(big.select("v", "node").join(wide, "v").select("node", "label")).distinct()


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text, ...)``."""
    search = _Search(docs, rule, Scratch(docs.sparkSession))
    roots = search.components().select("node", "root")
    member = (
        search.classes.join(roots, "node", "left").where("copies > 1 or root is not null")
        .select("digest", F.coalesce("root", "node").alias("root"))
    )
    member = search.scratch.stage(member, "members")
    search.scratch.drop(search.nodes, search.classes)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return (
        search.sketched.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(member, "digest", "left")
        .select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    )


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` without the near duplicates: the smallest ``doc_id`` of each component stays, as one row."""
    found = near_duplicates(docs, rule)
    gone = found.where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # rows that share an id are one document: each of its texts stays once, in the row that comes first as JSON
    again = left.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).agg(F.min_by(row, F.to_json(row)).alias("row"))
    return left.join(again, "doc_id", "left_anti").unionByName(one.select("row.*"))
