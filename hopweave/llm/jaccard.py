"""Exact similarity join of texts under the Jaccard distance of their word shingles, as connected components.

A text is the set of its distinct k-word shingles (64-bit hashes). Two texts link when their similarity reaches
``num / den``, that is, when their distance is at most eps = 1 - num / den. Equal sets meet first and go on as one
node. The metric-space join then runs from coarse regions to fine ones:

1. *Filter.* Unrelated texts are at distance 1 from every pivot, and no triangle window separates them: a split of
   the whole table around pivots would replicate every text to every region (README has figures). So signatures go
   first. The hash range is cut into more parts than two linked texts may have differing shingles, so linked texts
   agree on a whole part (pigeonhole); texts that agree on one form a region. A text is in as many regions as it may
   have differences, plus one, and again in the next class of sizes if a larger partner may be there.
2. *Pivots.* In each region the text that shares most regions with others is the first pivot. Members within eps of
   it link. A region whose other members then all lie in one component is done.
3. *Voronoi regions.* Near copies of one text meet in nearly equal regions, one for each part of the range. Of those
   with more than ``REGION_TEXTS`` texts, the ones whose text of the lowest hash is the same become one first (their
   union: whoever met still meets). A region above the bound is split around ``PIVOTS`` of its texts, those of the
   lowest hash, so that regions with texts in common share pivots and a distance is computed once: every member's
   exact distance to each pivot is computed (members times pivots, no more), it belongs to the region of its nearest
   pivot, and is replicated to those of all pivots at most 2 eps farther. By the triangle inequality two linked texts
   meet in the region of either's nearest pivot. Members within eps of a pivot link; regions of one component are
   done; those above the bound are split again with other pivots (recursion). Where that leaves a region with over
   three quarters of the texts it came from, its texts are too close to be told apart by pivots; they are dealt out in
   blocks, and each two blocks meet in one task.
4. *Exact join.* Members of different components are compared by parity sketches: bit j tells whether an odd number
   of the set's hashes falls on j. Two sets' sketches differ in no more bits than the sets in shingles, which rules
   out nearly every pair that is no link; pairs that are left are measured exactly. For each two components the
   closest pairs go first; the others follow only where those did not join the two (recursion on what is open).

No pair list of a group is ever made: the rows of steps 1 to 3 are memberships, and step 4 returns only pairs at the
threshold that could join two components. No window sorts a group: sizes, members' digests, pivots and nearest
distances are aggregates, combined before they are shuffled. Every link between different texts is found or implied
by a path of links, so the components are exact (up to collisions of 64-bit hashes).

Null and empty texts, and texts without words, have an empty set, link with nothing and are components of their
own. A text of fewer than k words is one shingle. Texts of any length are taken whole. Repeated rows fall together;
a similarity that equals the threshold is a link. Rows with a null id take part; the component's id is the smallest
known id, null only if it has none. Other columns, whatever their names, are passed through; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import map_text, parts, shielded, small, staged, table
from .graphs import components

#: Texts of a region up to which it is joined in one task (with its partner block: twice as many).
REGION_TEXTS = 256
#: Pivots, about, that a larger region is split around.
PIVOTS = 6
#: The hashes by which large regions that overlap are found, one after the other.
UNITED = (101, 102)
#: Of each two components in a region, so many pairs are measured first.
FIRST_PAIRS = 4
#: Words whose hash a task keeps; the store is emptied when full.
KEPT_WORDS = 100_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sorted distinct hashes of a text's k-word shingles; words lie between ASCII blanks, A-Z lower-cased."""

    def __init__(self, k: int):
        self.k = k
        self.kept: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        kept, words = self.kept, (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        if len(kept) > KEPT_WORDS:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        k = min(self.k, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = _mix(out ^ h[j : j + n]) + np.uint64(0x9E3779B97F4A7C15)
        return np.unique(out)


class Parts:
    """Signatures of a set: what it holds of parts of the hash range, for its class of sizes and perhaps the next.

    The two sets of a link differ in at most ``differ(n)`` shingles, n being either's size, so in no more parts. A set
    takes the parts of its class in order until it has one filled part more than that. Of two linked sets, the one
    that stops first has then taken a part that both hold alike, and the other has taken it too. A set with too few
    filled parts takes all parts, empty ones as well (two such sets agree on some part of all).
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [1]

    def differ(self, n: int) -> int:
        return (self.den - self.num) * n // self.num

    def _top(self, c: int) -> int:
        while len(self.tops) <= c:
            t = self.tops[-1]
            self.tops.append(max(t + 1, t * 3 // 2, t * self.den // self.num))
        return self.tops[c]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n, need = len(s), self.differ(len(s)) + 1
        if need < 2:
            return np.empty(0, np.int64)  # links with equal sets only
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(s), dtype=np.uint64)])
        own, out = 0, []
        while self._top(own) < n:
            own += 1
        # larger partners may be of the next class
        for c in (own, own + 1) if n * self.den // self.num > self._top(own) else (own,):
            top = self._top(c)
            least = self.differ(top) + 1
            empty = least * math.exp(-top / least)
            m = least + math.ceil(1.2 * empty + 2 * math.sqrt(empty))
            edges = np.searchsorted(s, np.arange(1, m, dtype=np.uint64) * np.uint64((1 << 64) // m))
            first, last = np.concatenate([[0], edges]), np.concatenate([edges, [n]])
            taken = np.flatnonzero(last > first)[:need]
            if len(taken) < need:
                taken = np.arange(m)
            out.append(_mix((total[last[taken]] - total[first[taken]]) ^ _mix(taken.astype(np.uint64) + np.uint64(c << 32))))
        return np.concatenate(out).view(np.int64)


def _node(s: np.ndarray) -> int:
    """The name of a set: a 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def described(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, key, node, n, parts) of every row of ``docs``: ``key`` is a hash of the text, ``node`` the set's name."""

    def make():
        shingles, signatures = Shingles(k), Parts(num, den)

        def one(text: str | None) -> tuple:
            s = shingles(text)
            return _node(s), len(s), signatures(s)

        return one

    fields = [pa.field("node", pa.int64()), pa.field("n", pa.int64()), pa.field("parts", pa.list_(pa.int64()))]
    return map_text(docs.select("doc_id", _key().alias("key"), "text"), ["doc_id", "key"], "text", fields, make)


def _same(d: str = "d") -> Column:
    return (F.col("key") == F.col("__key")) & F.col(d).eqNullSafe(F.col("__id"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("d"), _key().alias("key"), F.col("text").cast("string").alias("text"))


def merged_regions(members: DataFrame) -> DataFrame:
    """(region, node, size) from (region, node), distinct and staged: regions with the same members become one, and
    those of one member fall away."""
    of = members.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("members")).filter("size > 1")
    of = staged(of.select("region", F.xxhash64("members", "size").alias("as"), "size"), "regions")
    # one region of each set of members stands for all
    one = staged(of.groupBy("as", "size").agg(F.min("region").alias("region")), "regions")
    return members.join(small(one.select("region", F.col("as"), "size")), "region").select(F.col("as").alias("region"), "node", "size")


def region_members(rows: DataFrame) -> DataFrame:
    """(region, node, size): regions of two members or more, from the staged rows' parts."""
    each = rows.filter("n > 0").select("node", F.explode("parts").alias("region"))
    # copies of one text are one node; a part that only one node holds is no region
    shared = each.groupBy("region").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("region")
    found = each.join(small(staged(shared, "shared")), "region", "left_semi").distinct()
    return merged_regions(staged(found, "found"))


def parity_sketch(s: np.ndarray, num: int, den: int) -> np.ndarray:
    """Bit j: whether an odd number of hashes is j modulo the size, a power of two about 16 times the differences
    that a link allows. Folding the upper half onto the lower gives the sketch of half the size."""
    bits = 1 << max(6, (16 * (2 * (den - num) * len(s) // (den + num) + 1) - 1).bit_length())
    at = (_mix(s) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def sets_of(docs: DataFrame, nodes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(node, n, shingles, sketch) of the wanted ``nodes`` (__id, __key): one text of each is hashed again, which costs
    less than keeping all sets. Staged."""
    texts = _keyed(docs).join(small(nodes), _same(), "left_semi").select("text")
    schema = StructType([StructField("node", LongType()), StructField("n", LongType()), StructField("shingles", ArrayType(LongType())), StructField("sketch", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(k)
        for batch in parts(batches):
            found = [shingles(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64())), pa.array([parity_sketch(s, num, den).tobytes() for s in found], pa.binary())], names=schema.names)

    sets = staged(texts.mapInArrow(run, schema), "sets")
    # rows that repeat both id and text give a set twice
    return sets if sets.groupBy("node").count().filter("count > 1").isEmpty() else staged(sets.dropDuplicates(["node"]), "sets")


def _paired(pairs: DataFrame, sets: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b; staged) with ``columns`` of both sets. The rows move once, to the sets of the a, which are
    pivots in the first place and fewer."""
    of = lambda c: sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
    firsts = staged(pairs.select("a").distinct(), "firsts")
    return small(pairs).join(of("b"), "b").join(of("a").join(small(firsts), "a", "left_semi"), "a")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b; staged) with ``common`` and ``every``: the sizes of intersection and union."""
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    out = _paired(pairs, sets, "n", "shingles").select("a", "b", common.alias("common"), "n_a", "n_b")
    return out.select("a", "b", "common", (F.col("n_a") + F.col("n_b") - F.col("common")).alias("every"))


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The ``pairs`` (a, b; staged) that the sketches don't rule out."""
    schema = StructType([StructField("a", LongType()), StructField("b", LongType())])
    both = _paired(pairs, sets, "n", "sketch").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            a, b, na, nb = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            apart = np.empty(len(a), np.int64)
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                words = min(len(x), len(y)) // 8
                apart[i] = np.bitwise_count(_folded([x], words) ^ _folded([y], words)).sum()
            left = (apart * (den + num) <= (den - num) * (na + nb)) & (np.minimum(na, nb) * den >= np.maximum(na, nb) * num)
            yield pa.RecordBatch.from_arrays([pa.array(a[left]), pa.array(b[left])], names=["a", "b"])

    return both.mapInArrow(run, schema)


def _folded(sketches: list[bytes], words: int) -> np.ndarray:
    out = np.zeros((len(sketches), words), np.uint64)
    for i, raw in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return out


def possible_links(node: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: list[bytes], side: np.ndarray, num: int, den: int, first: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs of different components that the sketches don't rule out: of each two components the ``first`` closest
    (0: all), and whether there are more. ``side``: 1 and 2 are compared with each other only, 0 with all."""
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    order = np.argsort(n, kind="stable")
    node, label, n, side = node[order], label[order], n[order], side[order]
    sketch = [sketch[i] for i in order]
    for i in range(len(node)):
        # sizes: partners are no larger than n * den / num
        end = int(np.searchsorted(n, int(n[i]) * den // num, side="right"))
        if end <= i + 1:
            continue
        others = np.flatnonzero((label[i + 1 : end] != label[i]) & ((side[i + 1 : end] != side[i]) | (side[i] == 0))) + i + 1
        if not len(others):
            continue
        words = len(sketch[i]) // 8  # the smaller set has the smaller sketch
        apart = np.bitwise_count(_folded([sketch[j] for j in others], words) ^ np.frombuffer(sketch[i], np.uint64)).sum(1)
        # a link of sizes a and b differs in at most (den - num) (a + b) / (den + num) shingles
        close = np.flatnonzero(apart * (den + num) <= (den - num) * (n[others] + n[i]))
        for c in close:
            j = int(others[c])
            key = (min(int(label[i]), int(label[j])), max(int(label[i]), int(label[j])))
            found.setdefault(key, []).append((int(apart[c]), int(node[i]), int(node[j])))
    out, more = [], False
    for pairs in found.values():
        pairs.sort()
        more = more or bool(first) and len(pairs) > first
        out += [(min(a, b), max(a, b)) for _, a, b in (pairs[:first] if first else pairs)]
    return out, more


def opened(members: DataFrame, label: DataFrame) -> DataFrame:
    """(region, node, label) of the regions whose members lie in more than one component."""
    named = staged(members.select("region", "node").join(small(label), "node", "left").select("region", "node", F.coalesce("label", "node").alias("label")), "named")
    live = named.groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("region")
    return staged(named.join(small(staged(live, "live")), "region", "left_semi"), "open")


def united(open_: DataFrame, region_texts: int) -> DataFrame:
    """Regions (region, node, label; staged) of which those above ``region_texts`` that have the same first text by
    hash are one. That happens to two regions as often as they have texts in common (minhash), so their union is hardly
    larger than either, and whatever met in one of them meets in it."""
    for turn in UNITED:
        first = F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node"))["node"]
        sized = staged(open_.groupBy("region").agg(F.count(F.lit(1)).alias("size"), first.alias("first")).filter(F.col("size") > region_texts), "overlaps")
        if sized.groupBy("first").count().filter("count > 1").isEmpty():
            break
        known = open_.join(small(sized.select("region", F.xxhash64("first", F.lit(turn)).alias("as"))), "region", "left")
        open_ = staged(known.select(F.coalesce("as", "region").alias("region"), "node", "label").distinct(), "united")
    return open_


def voronoi(regions: DataFrame, sets: DataFrame, num: int, den: int, pivots: int, turn: int) -> tuple[DataFrame, DataFrame]:
    """Split ``regions`` (region, node, size; staged): the cells (region, cell, node, size) and the links (a, b) that
    the distances show. Linked members of a region share the cell of either's nearest pivot."""
    # the same for all regions, so those that overlap have pivots in common
    drawn = regions.select("region", "node", F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1 << 31)).alias("draw"), "size")
    one = drawn.groupBy("region").agg(F.min(F.struct("draw", "node"))["node"].alias("pivot"))  # never none
    more = drawn.filter(F.col("draw") * F.col("size") < pivots << 31).select("region", F.col("node").alias("pivot"))
    chosen = staged(one.unionByName(more).distinct(), "pivots")
    star = staged(regions.select("region", "node", "size").join(small(chosen), "region"), "star")
    other = staged(star.filter("pivot <> node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), "distances")
    known = staged(measured(other, sets), "distances")
    away = ((F.col("every") - F.col("common")) / F.col("every")).alias("away")
    far = star.join(known.select(F.col("a").alias("pivot"), F.col("b").alias("node"), away), ["pivot", "node"], "left")
    far = staged(far.select("region", "pivot", "node", "size", F.coalesce("away", F.lit(0.0)).alias("away")), "far")
    near = staged(far.groupBy("region", "node").agg(F.min("away").alias("near")), "near")
    # a double's rounding must not shut a text out
    kept = far.join(near, ["region", "node"]).filter(F.col("away") <= F.col("near") + 2 * (1 - num / den) + 1e-9)
    cells = staged(kept.select("region", F.xxhash64("region", "pivot", F.lit(turn)).alias("cell"), "node", "size"), "cells")
    return cells, known.filter(F.col("common") * den >= F.col("every") * num).select("a", "b")


def split_regions(open_: DataFrame, label: DataFrame, sets: DataFrame, num: int, den: int, region_texts: int, pivots: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions (region, node, label) that fit one task, regions that pivots cannot split, and the labels with what was
    linked on the way. ``open_`` has (region, node, label); a region above ``region_texts`` is split until it fits."""
    whole, dense, turn = [], [], 0
    open_ = united(open_, region_texts)
    while True:
        sized = staged(open_.groupBy("region").agg(F.count(F.lit(1)).alias("size")), "sizes")
        known = open_.join(small(sized), "region")
        whole.append(known.filter(F.col("size") <= region_texts).select("region", "node"))
        large = staged(known.filter(F.col("size") > region_texts).select("region", "node", "size"), "large")
        if large.isEmpty():
            break
        cells, links = voronoi(large, sets, num, den, pivots, turn)
        turn += 1
        links = staged(links, "near-links")
        if not links.isEmpty():
            label = relabelled(label, links)
        held = cells.groupBy("region", "cell", "size").agg(F.count(F.lit(1)).alias("held")).groupBy("region", "size").agg(F.max("held").alias("held"))
        stuck = staged(held.filter(F.col("held") * 4 > F.col("size") * 3).select("region"), "stuck")
        dense.append(large.join(small(stuck), "region", "left_semi").select("region", "node"))
        fresh = staged(cells.join(small(stuck), "region", "left_anti").select(F.col("cell").alias("region"), "node"), "fresh")
        open_ = opened(merged_regions(fresh), label)
    join = lambda made: staged(reduce(DataFrame.unionByName, made), "regions")
    return opened(join(whole), label), opened(join(dense), label) if dense else open_.limit(0), label


def region_tasks(whole: DataFrame, dense: DataFrame, region_texts: int) -> DataFrame:
    """(task, side, node, label) from regions (region, node, label): any two members of a region meet in some task.
    Regions of ``dense`` are dealt out in blocks, and each two blocks are a task."""
    small_ = whole.select(F.xxhash64("region").alias("task"), F.lit(0).alias("side"), "node", "label")
    if dense.isEmpty():
        return small_
    count = staged(dense.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / region_texts).cast("int").alias("blocks")), "blocks")
    dealt = dense.join(small(count), "region").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # which blocks meet which, and in which role: a table of blocks
    x = count.select("region", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    met = staged(x.select("region", "x", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)).alias("y")), "block-pairs")
    alone = F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))
    both = F.array(F.struct(F.col("x").alias("block"), F.lit(1).alias("side")), F.struct(F.col("y").alias("block"), F.lit(2).alias("side")))
    role = met.select("region", F.xxhash64("region", "x", "y").alias("task"), F.explode(F.when(F.col("x") == F.col("y"), alone).otherwise(both)).alias("r")).select("region", "task", "r.block", "r.side")
    return small_.unionByName(dealt.join(role, ["region", "block"]).select("task", "side", "node", "label"))


def candidate_pairs(tasks: DataFrame, sets: DataFrame, num: int, den: int, first: int) -> DataFrame:
    """(a, b, task) for :func:`possible_links` of every task (0); a row (0, 0, task) says that a task has more."""
    placed = small(tasks).join(sets.select("node", "n", "sketch"), "node")

    def join(t: pa.Table) -> pa.Table:
        column = lambda c: t.column(c).to_numpy()
        found, more = possible_links(column("node"), column("label"), column("n"), t.column("sketch").to_pylist(), column("side"), num, den, first)
        rows = [(a, b, 0) for a, b in found] + [(0, 0, int(column("task")[0]))] * more
        return pa.table({name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(("a", "b", "task"))})

    return placed.groupBy("task").applyInArrow(join, "a long, b long, task long").distinct()


def relabelled(label: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) after more ``links`` (a, b) between nodes; nodes without a label are their own."""
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = staged(label.unionByName(ends.join(label, "node", "left_anti").withColumn("label", F.col("node"))), "labels")
    of = lambda c: every.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    joined = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    return staged(every.join(joined.select(F.col("node").alias("label"), F.col("label").alias("joined")), "label", "left").select("node", F.coalesce("joined", "label").alias("label")), "labels")


def clusters(docs: DataFrame, k: int, num: int, den: int, region_texts: int = REGION_TEXTS, pivots: int = PIVOTS) -> DataFrame:
    """(doc_id, key, n, keeper_id, keeper_key) of every row: the row of the smallest id in its component.

    A row is its component's keeper if its own ``doc_id`` and ``key`` are those.
    """
    rows = staged(described(docs, k, num, den), "described")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key"))
    nodes = staged(rows.filter("n > 0").groupBy("node").agg(first.alias("first")), "nodes")
    members = staged(region_members(rows), "members")
    heavy = staged(members.groupBy("node").agg(F.sum("size").alias("weight")), "weights")
    named = staged(members.join(small(heavy), "node"), "weighed")
    pivot = staged(named.groupBy("region").agg(F.max(F.struct("weight", "node"))["node"].alias("pivot")), "first-pivots")
    placed = staged(members.join(small(pivot), "region"), "placed")
    wanted = heavy.select("node").join(nodes, "node").select(F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    sets = sets_of(docs, staged(wanted, "wanted"), k, num, den)

    # members that may link with their region's first pivot are measured
    to_pivot = placed.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    close = staged(possible(staged(to_pivot.distinct(), "star"), sets, num, den), "star-close")
    links = F.col("common") * den >= F.col("every") * num
    label = components(measured(close, sets).filter(links).select("a", "b"))

    # a pivot has met all of its region; without it, more regions have the same members
    rest = staged(placed.filter("node <> pivot").select("region", "node"), "rest")
    whole, dense, label = split_regions(opened(merged_regions(rest), label), label, sets, num, den, region_texts, pivots)
    tasks = staged(region_tasks(whole, dense, region_texts), "tasks")
    # the closest pairs of each two components first; then, where a task held any back, all that is still open
    for first_pairs in (FIRST_PAIRS, 0):
        pairs = staged(candidate_pairs(tasks, sets, num, den, first_pairs), "candidates")
        more = staged(measured(staged(pairs.filter("task = 0").select("a", "b"), "pairs"), sets).filter(links).select("a", "b"), "more-links")
        if not more.isEmpty():
            label = relabelled(label, more)
        held = staged(pairs.filter("task <> 0").select("task"), "held")
        if held.isEmpty():
            break
        tasks = tasks.join(small(held), "task", "left_semi").drop("label").join(small(label), "node", "left")
        tasks = staged(tasks.select("task", "side", "node", F.coalesce("label", "node").alias("label")), "tasks")

    linked = staged(nodes.join(small(label), "node"), "linked")
    best = linked.groupBy("label").agg(F.min("first").alias("best"))
    joined = staged(linked.join(best, "label").select("node", "best"), "best")
    of_node = staged(nodes.join(small(joined), "node", "left").select("node", F.coalesce("best", "first").alias("keeper")), "keepers")
    out = rows.select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(small(of_node), "node", "left")
    alone = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key")
    keeper = F.when(F.col("n") > 0, F.col("keeper")).otherwise(alone)
    return out.select("doc_id", "key", "n", keeper["doc_id"].alias("keeper_id"), keeper["key"].alias("keeper_key"))


def without_near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id; all columns unchanged."""
    plain, back = shielded(docs, ["doc_id", "text"])
    found = staged(clusters(plain.select("doc_id", "text"), k, num, den), "clusters")
    other = found.filter(~(F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("key") == F.col("keeper_key"))))
    gone = staged(other.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "copies")
    keyed = plain.withColumn("key", _key())
    kept = keyed.join(small(gone), _same("doc_id"), "left_anti")
    # rows that repeat both id and text: one stays
    again = staged(found.filter("n > 0").groupBy("doc_id", "key").count().filter("count > 1").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")), "repeated")
    if not again.isEmpty():
        kept = kept.join(small(again), _same("doc_id"), "left_anti").unionByName(kept.join(small(again), _same("doc_id"), "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*back())


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 90, 100)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("keeper_id").alias("component_id"))
