"""From node and edge records to the typed hop relation and its catalog.

A hop is a row (stype, pred, dir, ttype, s, t): one way to step over an edge. Edges of symmetric predicates are
mirrored and labelled A; the others appear as F and, swapped, as R. The catalog has a row for each directed matrix,
that is, each (stype, pred, dir, ttype), with its number of pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import base_of, compound, strip_prefix
from ..ontology import Ontology, normalized_predicates
from ..storage import small, staged

KEY = ["stype", "pred", "dir", "ttype"]
SUBCLASS = "biolink:subclass_of"


def typed_nodes(nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """(id, ntype): every node with categories gets exactly one type or pseudo-type. Categories repeat across nodes,
    so the type is worked out once for each distinct list; lists are few, so the commonest is no hot key. An id that is
    listed with several types gets the first by name."""
    lists = nodes.select("category").distinct()
    assigned = staged(lists.withColumn("ntype", ontology.assigned_type(F.col("category"))), "types")
    typed = nodes.join(small(assigned), "category").filter(F.col("ntype").isNotNull())
    return typed.groupBy("id").agg(F.min("ntype").alias("ntype"))


def base_edges(edges: DataFrame, nodes: DataFrame, ontology: Ontology) -> DataFrame:
    """(stype, pred, ttype, s, t) distinct. Subclass edges and edges with an untyped end are dropped, qualifiers go
    into the predicate, flat qualified names are normalised, symmetric predicates are mirrored."""
    kept = edges.filter(F.col("predicate") != SUBCLASS)
    flat = strip_prefix(F.col("predicate"))
    named = kept.select(F.col("subject").alias("s"), F.col("object").alias("t"), flat.alias("base"), compound(flat, F.col("object_direction_qualifier"), F.col("object_aspect_qualifier")).alias("raw"))
    names = normalized_predicates(named, ontology, "raw")  # one row for each predicate name
    s = nodes.select(F.col("id").alias("s"), F.col("ntype").alias("stype"))
    t = nodes.select(F.col("id").alias("t"), F.col("ntype").alias("ttype"))
    typed = named.distinct().join(F.broadcast(names), "raw").join(s, "s").join(t, "t").select("stype", F.col("normalized").alias("pred"), "ttype", "s", "t", "base")
    mirrored = typed.filter(ontology.is_symmetric(F.col("base"))).select(F.col("ttype").alias("stype"), "pred", F.col("stype").alias("ttype"), F.col("t").alias("s"), F.col("s").alias("t"))
    return typed.drop("base").unionByName(mirrored).distinct()


def hops_of(base: DataFrame, ontology: Ontology) -> DataFrame:
    """Directed hops of distinct base edges; distinct again without another shuffle."""
    symmetric = ontology.is_symmetric(base_of(F.col("pred")))
    forward = base.select("stype", "pred", F.when(symmetric, "A").otherwise("F").alias("dir"), "ttype", "s", "t")
    back = base.filter(~symmetric).select(F.col("ttype").alias("stype"), "pred", F.lit("R").alias("dir"), F.col("stype").alias("ttype"), F.col("t").alias("s"), F.col("s").alias("t"))
    return forward.unionByName(back)


def node_counts(base: DataFrame) -> DataFrame:
    """(ntype, n): nodes of each type that occur in a kept edge; a matrix has so many rows or columns."""
    ends = base.select(F.col("stype").alias("ntype"), F.col("s").alias("id")).unionByName(base.select(F.col("ttype").alias("ntype"), F.col("t").alias("id")))
    return ends.distinct().groupBy("ntype").agg(F.count(F.lit(1)).alias("n"))


def matrix_catalog(base: DataFrame) -> DataFrame:
    """(stype, pred, ttype, nrows, ncols, nvals) of every base matrix."""
    sizes = node_counts(base)
    rows = sizes.select(F.col("ntype").alias("stype"), F.col("n").alias("nrows"))
    cols = sizes.select(F.col("ntype").alias("ttype"), F.col("n").alias("ncols"))
    return base.groupBy("stype", "pred", "ttype").agg(F.count(F.lit(1)).alias("nvals")).join(rows, "stype").join(cols, "ttype").select("stype", "pred", "ttype", "nrows", "ncols", "nvals")


def directed_catalog(catalog: DataFrame, ontology: Ontology) -> DataFrame:
    """The catalog with directions: no data is read."""
    symmetric = ontology.is_symmetric(base_of(F.col("pred")))
    forward = catalog.withColumn("dir", F.when(symmetric, "A").otherwise("F"))
    back = catalog.filter(~symmetric).select(F.col("ttype").alias("stype"), "pred", F.col("stype").alias("ttype"), F.col("ncols").alias("nrows"), F.col("nrows").alias("ncols"), "nvals", F.lit("R").alias("dir"))
    return forward.unionByName(back).select(*KEY, "nrows", "ncols", "nvals")


def hierarchical_node_counts(sizes: DataFrame, ontology: Ontology) -> DataFrame:
    """(ntype, n): nodes of each type or any of its descendants; a pseudo-type counts for each distinct ancestor."""
    above = ontology.type_variant_table(sizes, F.col("ntype"))
    return sizes.join(F.broadcast(above), F.col("ntype") == F.col("name")).groupBy(F.col("variant").alias("ntype")).agg(F.sum("n").alias("n"))


@dataclass
class Graph:
    """A typed graph: distinct base edges, and what follows from them."""

    base: DataFrame
    ontology: Ontology

    @classmethod
    def from_records(cls, nodes: DataFrame, edges: DataFrame, ontology: Ontology) -> Graph:
        return cls(staged(base_edges(edges, typed_nodes(nodes, ontology), ontology), "base"), ontology)

    @cached_property
    def hops(self) -> DataFrame:
        return hops_of(self.base, self.ontology)

    @cached_property
    def catalog(self) -> DataFrame:
        return staged(matrix_catalog(self.base), "catalog")

    @cached_property
    def directed(self) -> DataFrame:
        return directed_catalog(self.catalog, self.ontology)

    @cached_property
    def sizes(self) -> DataFrame:
        rows = self.catalog.select(F.col("stype").alias("ntype"), F.col("nrows").alias("n")).unionByName(self.catalog.select(F.col("ttype").alias("ntype"), F.col("ncols").alias("n")))
        return rows.groupBy("ntype").agg(F.max("n").alias("n"))

    def only(self, *predicates: str) -> Graph:
        """The graph of these predicates alone; the filter reaches the scans."""
        return Graph(self.base.filter(F.col("pred").isin(*predicates)), self.ontology)
