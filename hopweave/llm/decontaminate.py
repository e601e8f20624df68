"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by k = ``ERROR_SHARE`` of m edits. Cut into k + 1 pieces, at
least one piece must then stand in the passage unchanged. One Aho-Corasick automaton over the pieces of all items
finds these places in one pass over a text; around each, Myers' bit-parallel algorithm (one integer per item, one
step per character) computes the smallest edit distance of the whole item to any stretch of the text. Exact: no
passage within k edits is missed.

Texts and items are compared in lower case with single blanks. Null or empty texts hold nothing; null and blank
items are not searched for. Items under ``LEAST_CHARS`` characters would be found by chance with edits, so they
must stand in the text unchanged and between word boundaries. Repeated rows give equal results; items with equal
text are all reported. Texts of any length are searched whole, in time that grows with their length. Benchmarks are
taken in parts of ``PART_CHARS`` characters, each broadcast with that bound, so their size is not limited. Other
columns, whatever their names, are passed through; an empty table or benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_text, parts, quoted, staged, table

ERROR_SHARE = 0.08
#: Shorter items are searched for without edits.
LEAST_CHARS = 40
PART_CHARS = 4_000_000

Found = dict[int, tuple[int, int, int]]


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(item_bits: dict[str, int], m: int, text: str, most: int) -> tuple[int, int] | None:
    """The smallest edit distance of an item to a stretch of ``text`` and where that ends, if at most ``most``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = most + 1, -1
    get = item_bits.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        x = eq | down
        diagonal = ((((x & up) + up) ^ up) | x) & full
        rise = down | (full & ~(diagonal | up))
        fall = up & diagonal
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, at = score, j + 1
        rise = rise << 1 & full  # a match may begin anywhere
        fall = fall << 1 & full
        up = fall | (full & ~(diagonal | rise))
        down = rise & diagonal
    return None if at < 0 else (best, at)


def whole_words(line: str, start: int, stop: int) -> bool:
    """Whether no word goes on beyond either end of ``line[start:stop]``."""
    cuts = lambda at: 0 < at < len(line) and line[at - 1].isalnum() and line[at].isalnum()
    return not cuts(start) and not cuts(stop)


class Matcher:
    """Finds the items of one part of the benchmark in texts."""

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        self.share = share
        by_text: dict[str, list[int]] = {}
        for name, text in items:
            if key := normal(text):
                by_text.setdefault(key, []).append(name)
        self.items = [(key, sorted(set(names))) for key, names in sorted(by_text.items())]
        self.bits: dict[int, dict[str, int]] = {}
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (key, _) in enumerate(self.items):
            k = self._edits(len(key))
            cuts = [len(key) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(key[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def _edits(self, m: int) -> int:
        return int(m * self.share) if m >= LEAST_CHARS else 0

    def _bits(self, n: int) -> dict[str, int]:
        if n not in self.bits:
            bits: dict[str, int] = {}
            for i, c in enumerate(self.items[n][0]):
                bits[c] = bits.get(c, 0) | 1 << i
            self.bits[n] = bits
        return self.bits[n]

    def find(self, text: str | None) -> Found:
        """Of each item's number: the smallest distance found, and start and end of a window that holds it."""
        found: Found = {}
        if not self.items:
            return found
        line = normal(text)
        seen: dict[int, int] = {}  # of each item, the diagonal of the last window looked at
        for end, (length, places) in self.automaton.iter(line):
            for n, offset in places:
                if n in found and found[n][0] == 0:
                    continue
                key = self.items[n][0]
                m = len(key)
                k = self._edits(m)
                diagonal = end + 1 - length - offset
                if m < LEAST_CHARS:
                    if whole_words(line, diagonal, diagonal + m):
                        found[n] = (0, diagonal, diagonal + m)
                    continue
                if n in seen and abs(seen[n] - diagonal) <= k:
                    continue  # that window holds this place with its full margin
                if diagonal >= 0 and line.startswith(key, diagonal):
                    found[n] = (0, diagonal, diagonal + m)
                    continue
                # a passage that holds this piece lies within k before and m + 2k behind the diagonal; k more on
                # either side, and the other pieces of the passage need no look
                start, stop = max(0, diagonal - 2 * k), min(len(line), diagonal + m + 3 * k)
                seen[n] = diagonal
                hit = myers(self._bits(n), m, line[start:stop], k)
                if hit and (n not in found or hit[0] < found[n][0]):
                    found[n] = (hit[0], max(start, start + hit[1] - m - hit[0]), start + hit[1])
        return found


def _parts(benchmark: DataFrame, part_chars: int) -> list[DataFrame]:
    """The benchmark's items (item_id, text) in parts of about ``part_chars`` characters each."""
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null").distinct(), "benchmark")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = 1 + chars // part_chars
    return [items.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == p) for p in range(parts)]


def _matchers(docs: DataFrame, benchmark: DataFrame, share: float, part_chars: int) -> list[Callable[[], Matcher]]:
    found = []
    for part in _parts(benchmark, part_chars):
        # bounded by part_chars
        shipped = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        found.append(lambda shipped=shipped: Matcher(shipped.value, share))
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, keep: str = "doc_id", share: float = ERROR_SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """(keep, item_id, distance, start, end): one row for each row of ``docs`` and item it holds.

    ``start`` and ``end`` are places in the normalised text; for distances over 0 the start is a lower bound.
    """
    source = docs.select(F.col(quoted(keep)).alias("k"), F.col("text").cast("string").alias("t"))
    schema = source.select("k").schema.add("item_id", "long").add("distance", "long").add("start", "long").add("end", "long")
    out = None
    for make in _matchers(docs, benchmark, share, part_chars):

        def run(batches, make=make):
            matcher = make()
            for batch in parts(batches):
                rows: list[tuple] = []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for n, hit in matcher.find(t).items():
                        rows += [(i, name, *hit) for name in matcher.items[n][1]]
                if rows:
                    at, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=schema.names)

        one = source.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out.toDF(keep, "item_id", "distance", "start", "end")


def decontaminated(docs: DataFrame, benchmark: DataFrame, share: float = ERROR_SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, all columns unchanged."""
    for make in _matchers(docs, benchmark, share, part_chars):

        def passes(make=make):
            matcher = make()
            return lambda t: not matcher.find(t)

        docs = filter_text(docs, passes)
    return docs


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "distance")
