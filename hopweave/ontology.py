"""Type, predicate and qualifier hierarchies as closures.

An ontology is a vocabulary, not data: some hundred names. It is held on the driver, its size is checked, and its
closures become small tables (for joins) or map literals (for array functions on paths).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import metapath as mp
from .functions.predicates import SEPARATOR, compound, is_compound, parts_of, strip_prefix

#: Names up to which a vocabulary is accepted.
MOST_NAMES = 50_000

Pairs = tuple[tuple[str, str], ...]


def closure(pairs: Iterable[tuple[str, str]]) -> dict[str, list[str]]:
    """Of each name: itself, then its ancestors by distance, then by name."""
    up: dict[str, set[str]] = {}
    for child, parent in pairs:
        up.setdefault(child, set()).add(parent)
        up.setdefault(parent, set())
    out = {}
    for name in up:
        found, level = [name], [name]
        while level:
            level = sorted({p for x in level for p in up[x]} - set(found))
            found += level
        out[name] = found
    return out


@dataclass(frozen=True)
class Ontology:
    """(child, parent) pairs; names without a parent may be listed as (name, name)."""

    types: Pairs
    predicates: Pairs
    symmetric: tuple[str, ...] = ()
    directions: Pairs = ()
    aspects: Pairs = ()

    def __post_init__(self) -> None:
        if len(self.types) + len(self.predicates) > MOST_NAMES:
            raise ValueError(f"an ontology of more than {MOST_NAMES} names is not a vocabulary")

    @classmethod
    def from_tables(cls, types: DataFrame, predicates: DataFrame, symmetric: DataFrame, directions: DataFrame | None = None, aspects: DataFrame | None = None) -> Ontology:
        """From tables (child, parent) and (name); raises if one has more than ``MOST_NAMES`` distinct rows."""

        def rows(t: DataFrame | None, *names: str) -> list:
            found = [] if t is None else t.select(*names).distinct().limit(MOST_NAMES + 1).collect()
            if len(found) > MOST_NAMES:
                raise ValueError(f"more than {MOST_NAMES} distinct rows of {', '.join(names)}")
            return sorted(found, key=lambda r: tuple(x or "" for x in r))

        pairs = lambda t: tuple((r[0], r[1]) for r in rows(t, "child", "parent"))
        return cls(pairs(types), pairs(predicates), tuple(r[0] for r in rows(symmetric, "name")), pairs(directions), pairs(aspects))

    @cached_property
    def type_closure(self) -> dict[str, list[str]]:
        return closure(self.types)

    @cached_property
    def predicate_closure(self) -> dict[str, list[str]]:
        return closure(self.predicates)

    @cached_property
    def qualifier_closure(self) -> dict[str, list[str]]:
        return closure([*self.directions, *self.aspects])

    # names on the driver

    def types_above(self, name: str) -> list[str]:
        """The type, the constituents of a pseudo-type, and all their ancestors; unknown: itself."""
        parts = name.split("+")
        return list(dict.fromkeys([name, *parts, *[a for p in parts for a in self.type_closure.get(p, [p])]]))

    def predicates_above(self, name: str) -> list[str]:
        """The predicate and all it implies: more general bases, more general qualifiers, or none of them."""
        base, *quals = name.replace("biolink:", "").split(SEPARATOR, 2)
        bases = self.predicate_closure.get(base, [base])
        if not quals:
            return list(bases)
        direction, aspect = ([*self.qualifier_closure.get(q, [q]), ""] if q else [""] for q in [*quals, ""][:2])
        return list(dict.fromkeys(SEPARATOR.join((b, d, a)) if d or a else b for b in bases for d in direction for a in aspect))

    # tables

    @staticmethod
    def _names(column: Column, df: DataFrame) -> list[str]:
        found = [r[0] for r in df.select(column.alias("x")).filter("x is not null").distinct().limit(MOST_NAMES + 1).collect()]
        if len(found) > MOST_NAMES:
            raise ValueError(f"more than {MOST_NAMES} distinct names")
        return sorted(found)

    def type_variant_table(self, df: DataFrame, column: Column) -> DataFrame:
        """(name, variant) for every type that occurs in ``column``."""
        rows = [(n, v) for n in self._names(column, df) for v in self.types_above(n)]
        return df.sparkSession.createDataFrame(rows, "name string, variant string")

    def predicate_variant_table(self, df: DataFrame, column: Column) -> DataFrame:
        rows = [(n, v) for n in self._names(column, df) for v in self.predicates_above(n)]
        return df.sparkSession.createDataFrame(rows, "name string, variant string")

    @staticmethod
    def _table(spark: SparkSession, found: dict[str, list[str]], names: tuple[str, str]) -> DataFrame:
        rows = [(n, a, i) for n, above in found.items() for i, a in enumerate(above)]
        return spark.createDataFrame(rows, f"{names[0]} string, {names[1]} string, distance_rank int")

    def type_table(self, spark: SparkSession) -> DataFrame:
        """(type, ancestor, distance_rank), reflexive."""
        return self._table(spark, self.type_closure, ("type", "ancestor"))

    def predicate_table(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, self.predicate_closure, ("predicate", "ancestor"))

    def type_parents(self, name: str) -> set[str]:
        """Immediate parents; of a pseudo-type, those of its constituents."""
        return {p for c, p in self.types if c in name.split("+") and c != p}

    def predicate_parents(self, name: str) -> set[str]:
        return {p for c, p in self.predicates if c == name and c != p}

    # columns

    @staticmethod
    def _map(found: dict[str, list[str]]) -> Column:
        if not found:
            return F.lit(None).cast("map<string, array<string>>")
        return F.create_map(*[x for k, v in sorted(found.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])

    @cached_property
    def symmetric_names(self) -> Column:
        return F.array(*map(F.lit, self.symmetric)) if self.symmetric else F.array().cast("array<string>")

    def is_symmetric(self, base: Column) -> Column:
        return base.isin(*self.symmetric) if self.symmetric else F.lit(False)

    def type_ancestors(self, name: Column) -> Column:
        """The type and its ancestors; a pseudo-type also has its constituents and theirs. Unknown: itself."""
        known = self._map(self.type_closure)
        own = lambda n: F.coalesce(F.try_element_at(known, n), F.array(n))
        of_parts = F.flatten(F.transform(F.split(name, r"\+"), own))
        return F.array_distinct(F.concat(F.array(name), of_parts))

    type_variants = type_ancestors

    def predicate_ancestors(self, name: Column) -> Column:
        """Without the predicate itself; unknown: none."""
        clean = strip_prefix(name)
        return F.array_remove(F.coalesce(F.try_element_at(self._map(self.predicate_closure), clean), F.array().cast("array<string>")), clean)

    def qualifier_ancestors(self, value: Column) -> Column:
        return F.coalesce(F.try_element_at(self._map(self.qualifier_closure), value), F.array(value))

    def predicate_variants(self, name: Column) -> Column:
        """The predicate and all it implies: more general bases, more general qualifiers, or none of them."""
        clean = strip_prefix(name)
        bases = lambda b: F.concat(F.array(b), self.predicate_ancestors(b))
        part = parts_of(clean)
        or_none = lambda q: F.concat(F.when(q.isNull(), F.array().cast("array<string>")).otherwise(self.qualifier_ancestors(q)), F.array(F.lit("")))
        every = F.flatten(F.transform(bases(part["base"]), lambda b: F.flatten(F.transform(or_none(part["direction"]), lambda d: F.transform(or_none(part["aspect"]), lambda a: compound(b, d, a))))))
        return F.when(is_compound(clean), F.array_distinct(every)).otherwise(bases(clean))

    def within(self, name: Column, ceiling: Column) -> Column:
        return F.array_contains(self.type_ancestors(name), ceiling)

    def assigned_type(self, categories: Column) -> Column:
        """One type for a node: its categories that have no descendant among them, sorted and joined by ``+``.

        Null for a node without categories.
        """
        clean = F.transform(categories, lambda x: strip_prefix(x))
        known = self._map(self.type_closure)
        above = lambda n: F.coalesce(F.try_element_at(known, n), F.array(n))
        leaves = F.filter(clean, lambda x: ~F.exists(clean, lambda y: (y != x) & F.array_contains(above(y), x)))
        joined = F.array_join(F.array_sort(F.array_distinct(leaves)), "+")
        return F.when(F.size(categories) > 0, F.when(F.size(leaves) > 0, joined).otherwise(F.get(clean, F.lit(0))))

    def leaf_types(self, categories: Column) -> Column:
        return F.coalesce(F.split(self.assigned_type(categories), r"\+"), F.array().cast("array<string>"))

    def most_specific(self, categories: Column) -> Column:
        """The known category with the most ancestors (the later name on ties); else the first category."""
        known = self._map(self.type_closure)
        depth = lambda c: F.size(F.coalesce(F.try_element_at(known, strip_prefix(c)), F.array().cast("array<string>")))
        ranked = F.filter(F.transform(categories, lambda c: F.struct(depth(c).alias("d"), c.alias("c"))), lambda x: x["d"] > 0)
        return F.when(F.size(ranked) > 0, F.array_max(ranked)["c"]).otherwise(F.get(categories, F.lit(0)))

    def canonical_path(self, p: Column) -> Column:
        """Directions of symmetric predicates set to A, then oriented by endpoint types."""
        return mp.canonical(mp.with_effective_directions(p, self.symmetric_names))


def normalized_predicates(predicates: DataFrame, ontology: Ontology, column: str = "pred") -> DataFrame:
    """(column, normalized) for every distinct predicate: flat names such as ``affects_increased_expression`` become
    compound ones. Compound and known names stay. The shortest known base wins, then the fewest direction words."""
    spark = predicates.sparkSession
    names = predicates.select(F.col(column).alias("name")).distinct()
    known = spark.createDataFrame([(x,) for x in ontology.predicate_closure] or [("",)], "base string")
    quals = lambda pairs: [""] + sorted({x for pair in pairs for x in pair})
    dirs = F.array(*map(F.lit, quals(ontology.directions)))
    asps = F.array(*map(F.lit, quals(ontology.aspects)))
    flat = names.filter(~is_compound(F.col("name"))).join(F.broadcast(known), F.col("name") == F.col("base"), "left_anti").withColumn("words", F.split("name", "_"))
    cuts = flat.filter(F.size("words") > 1).select("name", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("n"))
    tried = cuts.withColumn("base", F.array_join(F.slice("words", F.lit(1), F.col("n")), "_")).join(F.broadcast(known), "base")
    rest = tried.withColumn("rest", F.slice("words", F.col("n") + 1, F.size("words"))).select("name", "base", "n", "rest", F.explode(F.sequence(F.lit(0), F.size("rest"))).alias("k"))
    split = rest.select("name", "base", "n", "k", F.array_join(F.slice("rest", F.lit(1), F.col("k")), "_").alias("d"), F.array_join(F.slice("rest", F.col("k") + 1, F.size("rest")), "_").alias("a"))
    fits = split.filter(F.array_contains(dirs, F.col("d")) & F.array_contains(asps, F.col("a")))
    best = fits.groupBy("name").agg(F.min_by(compound(F.col("base"), F.col("d"), F.col("a")), F.struct("n", "k")).alias("found"))
    return names.join(F.broadcast(best), "name", "left").select(F.col("name").alias(column), F.coalesce("found", "name").alias("normalized"))


def normalized_paths(paths: DataFrame, ontology: Ontology, column: str = "path") -> DataFrame:
    """(column, normalized): every distinct path with the flat predicates of all its hops normalised; the names are
    worked out once each, and joined to the paths' positions."""
    each = paths.select(F.col(column).alias("p")).distinct().select("p", F.posexplode("p.preds").alias("at", "raw"))
    names = normalized_predicates(each, ontology, "raw")
    hops = F.array_sort(F.collect_list(F.struct("at", "normalized")))  # a path's hops
    made = each.join(F.broadcast(names), "raw").groupBy("p").agg(F.transform(hops, lambda x: x["normalized"]).alias("preds"))
    return made.select(F.col("p").alias(column), mp.path(F.col("p.nodes"), F.col("preds"), F.col("p.dirs")).alias("normalized"))
