"""Metapaths as three arrays (``nodes``, ``preds``, ``dirs``) and as text ``T0|p1|d1|T1|...|TN``.

All functions take and return columns, so they run inside generated code and on any number of rows. A path is a
struct of its three arrays; directions are F (along the edge), R (against it) and A (symmetric predicate).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import base_of

PATH = "struct<nodes: array<string>, preds: array<string>, dirs: array<string>>"


def path(nodes: Column, preds: Column, dirs: Column) -> Column:
    return F.struct(nodes.alias("nodes"), preds.alias("preds"), dirs.alias("dirs"))


def parse(text: Column) -> Column:
    """The path of a text, null if the number of its parts is not 1 + 3 N with N of at least 1."""
    parts = F.split(text, r"\|")
    hops = ((F.size(parts) - 1) / 3).cast("int")
    every = lambda first, n: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(parts, i * 3 + first))
    return F.when((F.size(parts) >= 4) & ((F.size(parts) - 1) % 3 == 0), path(every(0, hops + 1), every(1, hops), every(2, hops)))


def build(p: Column) -> Column:
    """The text of a path."""
    steps = F.transform(p["preds"], lambda x, i: F.concat_ws("|", F.get(p["nodes"], i), x, F.get(p["dirs"], i)))
    return F.concat_ws("|", F.array_join(steps, "|"), F.element_at(p["nodes"], -1))


def flip(direction: Column) -> Column:
    return F.when(direction == "F", "R").when(direction == "R", "F").otherwise("A")


def reverse(p: Column) -> Column:
    return path(F.reverse(p["nodes"]), F.reverse(p["preds"]), F.transform(F.reverse(p["dirs"]), flip))


def first_node(p: Column) -> Column:
    return F.element_at(p["nodes"], 1)


def last_node(p: Column) -> Column:
    return F.element_at(p["nodes"], -1)


def same_path(a: Column, b: Column) -> Column:
    return (a["nodes"] == b["nodes"]) & (a["preds"] == b["preds"]) & (a["dirs"] == b["dirs"])


def canonical(p: Column) -> Column:
    """The path or its reverse: the one whose first type is not after its last."""
    return F.when(first_node(p) <= last_node(p), p).otherwise(reverse(p))


def with_effective_directions(p: Column, symmetric: Column) -> Column:
    """The path with direction A wherever the predicate's base is in the array ``symmetric``."""
    dirs = F.transform(p["preds"], lambda x, i: F.when(F.array_contains(symmetric, base_of(x)), F.lit("A")).otherwise(F.get(p["dirs"], i)))
    return path(p["nodes"], p["preds"], dirs)


def is_palindrome(p: Column) -> Column:
    """Whether the path equals its reverse, so that its pair set is symmetric."""
    return same_path(p, reverse(p))


def provenance(p: Column) -> Column:
    """What names a path as evidence: with equal endpoint types, a path and its reverse share the smaller text."""
    return F.when(first_node(p) == last_node(p), F.least(build(p), build(reverse(p)))).otherwise(build(p))


def has_pseudo_type(p: Column) -> Column:
    return F.exists(p["nodes"], lambda n: F.contains(n, F.lit("+")))


def is_excluded(p: Column, types: list[str], predicates: list[str]) -> Column:
    """Whether any type, predicate or predicate's base is in the lists."""
    bad_type = F.arrays_overlap(p["nodes"], F.array(*map(F.lit, types))) if types else F.lit(False)
    listed = F.array(*map(F.lit, predicates)) if predicates else None
    bad_pred = F.lit(False) if listed is None else F.exists(p["preds"], lambda x: F.array_contains(listed, x) | F.array_contains(listed, base_of(x)))
    return bad_type | bad_pred


def path_id(p: Column) -> Column:
    """``T|p|d|T__T|p|d|T``: the hops one by one."""
    return F.array_join(F.transform(p["preds"], lambda x, i: F.concat_ws("|", F.get(p["nodes"], i), x, F.get(p["dirs"], i), F.get(p["nodes"], i + 1))), "__")


def from_path_id(text: Column) -> Column:
    hops = F.transform(F.split(text, "__"), lambda h: F.split(h, r"\|"))
    nodes = F.concat(F.transform(hops, lambda h: F.get(h, F.lit(0))), F.array(F.get(F.element_at(hops, -1), F.lit(3))))
    return path(nodes, F.transform(hops, lambda h: F.get(h, F.lit(1))), F.transform(hops, lambda h: F.get(h, F.lit(2))))


def prefix(p: Column, hops: Column) -> Column:
    """The path's first ``hops`` hops."""
    return path(F.slice(p["nodes"], 1, hops + 1), F.slice(p["preds"], 1, hops), F.slice(p["dirs"], 1, hops))


def last_hop(p: Column) -> Column:
    """struct(stype, pred, dir, ttype) of the final hop."""
    return F.struct(F.element_at(p["nodes"], -2).alias("stype"), F.element_at(p["preds"], -1).alias("pred"), F.element_at(p["dirs"], -1).alias("dir"), last_node(p).alias("ttype"))


def file_name(text: Column) -> Column:
    return F.translate(text, "|: ", "___")


#: The sizes below which a matrix counts as of a bucket.
SIZE_BUCKETS = (("tiny", 1_000), ("small", 10_000), ("medium", 100_000), ("large", 1_000_000), ("xlarge", 10_000_000), ("xxlarge", 100_000_000))


def size_bucket(n: Column) -> Column:
    out = None
    for name, below in SIZE_BUCKETS:
        out = F.when(n < below, name) if out is None else out.when(n < below, name)
    return out.otherwise("huge")
