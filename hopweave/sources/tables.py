"""The driver's star-schema tables as a typed graph.

Node ids are whole numbers in disjoint ranges (kind * 10^12 + key). ``fine`` types split customers by segment and
parts by type, and give large parts a second leaf category, so pseudo-types occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ontology import Ontology
from ..operators.graph import Graph
from ..storage import staged

RANGE = 10**12
KINDS = {"customer": 1, "supplier": 2, "part": 3, "nation": 4, "region": 5, "user": 6, "event_type": 7}
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
LARGE_SIZE = 40

ONTOLOGY = Ontology(
    types=(
        *((f"Customer_{s}", "Customer") for s in SEGMENTS),
        ("Customer", "Party"), ("Supplier", "Party"), ("User", "Party"), ("Party", "NamedThing"),
        *((f"Part_{t}", "Part") for t in PART_TYPES),
        ("Part", "Product"), ("LargeItem", "Product"), ("Product", "NamedThing"),
        ("Nation", "Place"), ("Region", "Place"), ("Place", "NamedThing"), ("EventType", "NamedThing"),
    ),
    predicates=(
        ("returned", "ordered"), ("ordered", "interacted_with"), ("bought_from", "interacted_with"), ("performed", "interacted_with"),
        ("supplied_by", "associated_with"), ("in_region", "located_in"), ("located_in", "associated_with"), ("neighbor_of", "associated_with"),
        ("interacted_with", "related_to"), ("associated_with", "related_to"),
    ),
    symmetric=("neighbor_of", "associated_with", "related_to"),
    directions=tuple((e, e) for e in EVENT_TYPES) + (("purchase", "conversion"), ("signup", "conversion")),
    aspects=(("high", "high"), ("low", "low")),
)

PREDICATES = ("ordered", "returned", "bought_from", "supplied_by", "located_in", "in_region", "neighbor_of", "performed")


def node(kind: str, key: Column) -> Column:
    return F.lit(KINDS[kind] * RANGE) + key.cast("long")


def _customer_type(fine: bool) -> Column:
    return F.concat(F.lit("Customer_"), "c_mktsegment") if fine else F.lit("Customer")


def _part_type(fine: bool) -> Column:
    named = F.concat(F.lit("Part_"), "p_type")
    return F.when(F.col("p_size") > LARGE_SIZE, F.concat(F.lit("LargeItem+"), named)).otherwise(named) if fine else F.lit("Part")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, category): every node with all its categories, ancestors included, as a knowledge graph lists them."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    listed = lambda *c: F.array(*[F.lit(x) if isinstance(x, str) else x for x in c])
    customer = read("customer").select(node("customer", F.col("c_custkey")).alias("id"), listed(F.concat(F.lit("Customer_"), "c_mktsegment"), "Customer", "Party", "NamedThing").alias("category"))
    large = F.when(F.col("p_size") > LARGE_SIZE, listed("LargeItem")).otherwise(F.array().cast("array<string>"))
    part = read("part").select(node("part", F.col("p_partkey")).alias("id"), F.concat(listed("Product", F.concat(F.lit("Part_"), "p_type"), "Part"), large).alias("category"))
    supplier = read("supplier").select(node("supplier", F.col("s_suppkey")).alias("id"), listed("NamedThing", "Supplier", "Party").alias("category"))
    nation = read("nation").select(node("nation", F.col("n_nationkey")).alias("id"), listed("Nation", "Place").alias("category"))
    region = read("region").select(node("region", F.col("r_regionkey")).alias("id"), listed("Region").alias("category"))
    return customer.unionByName(part).unionByName(supplier).unionByName(nation).unionByName(region)


def base_edges(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] = PREDICATES, fine: bool = True) -> DataFrame:
    """(stype, pred, ttype, s, t) distinct, of the predicates asked for; only their tables and columns are read."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    ct, pt = _customer_type(fine), _part_type(fine)
    customers = lambda: read("customer").select(F.col("c_custkey"), ct.alias("ctype"))
    parts = lambda: read("part").select(F.col("p_partkey"), pt.alias("ptype"))

    def edge(df: DataFrame, stype: Column, pred: Column | str, ttype: Column, s: Column, t: Column) -> DataFrame:
        return df.select(stype.alias("stype"), (F.lit(pred) if isinstance(pred, str) else pred).alias("pred"), ttype.alias("ttype"), s.alias("s"), t.alias("t"))

    lines = read("lineitem")
    orders = read("orders").select("o_orderkey", "o_custkey")
    bought = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("back"))
    if len({"ordered", "returned", "bought_from"} & set(predicates)) > 1:
        bought = staged(bought, "bought")  # lines meet their orders once

    def to_parts(*preds: str) -> DataFrame:
        """Distinct pairs, before node types are joined to them; a pair was returned if one of its lines was."""
        lines = bought if "ordered" in preds else bought.filter("back")
        df = lines.groupBy("o_custkey", "l_partkey").agg(F.max(F.coalesce("back", F.lit(False))).alias("back"))
        df = df.join(customers(), F.col("o_custkey") == F.col("c_custkey")).join(parts(), F.col("l_partkey") == F.col("p_partkey"))
        pred = F.explode(F.when(F.col("back"), F.array(*map(F.lit, preds))).otherwise(F.array(F.lit(preds[0])))) if len(preds) > 1 else F.lit(preds[0])
        return edge(df, F.col("ctype"), pred, F.col("ptype"), node("customer", F.col("o_custkey")), node("part", F.col("l_partkey")))

    makers: dict[str, Callable[[], DataFrame]] = {
        "ordered": lambda: to_parts("ordered", *(["returned"] if "returned" in predicates else [])),
        "returned": lambda: to_parts("returned"),
        "bought_from": lambda: edge(bought.select("o_custkey", "l_suppkey").distinct().join(customers(), F.col("o_custkey") == F.col("c_custkey")), F.col("ctype"), "bought_from", F.lit("Supplier"), node("customer", F.col("o_custkey")), node("supplier", F.col("l_suppkey"))),
        "supplied_by": lambda: edge(lines.select("l_partkey", "l_suppkey").distinct().join(parts(), F.col("l_partkey") == F.col("p_partkey")), F.col("ptype"), "supplied_by", F.lit("Supplier"), node("part", F.col("l_partkey")), node("supplier", F.col("l_suppkey"))),
        "located_in": lambda: edge(read("customer"), ct, "located_in", F.lit("Nation"), node("customer", F.col("c_custkey")), node("nation", F.col("c_nationkey"))).unionByName(edge(read("supplier"), F.lit("Supplier"), "located_in", F.lit("Nation"), node("supplier", F.col("s_suppkey")), node("nation", F.col("s_nationkey")))),
        "in_region": lambda: edge(read("nation"), F.lit("Nation"), "in_region", F.lit("Region"), node("nation", F.col("n_nationkey")), node("region", F.col("n_regionkey"))),
        "neighbor_of": lambda: _neighbors(read("nation"), edge),
        "performed": lambda: edge(read("events").select("user_id", "event_type").distinct(), F.lit("User"), F.concat(F.lit("performed--"), "event_type", F.lit("--")), F.lit("EventType"), node("user", F.col("user_id")), node("event_type", F.array_position(F.array(*map(F.lit, EVENT_TYPES)), F.col("event_type")))),
    }
    out = None
    for p in predicates:
        if p == "returned" and "ordered" in predicates:
            continue  # made with those ordered
        out = makers[p]() if out is None else out.unionByName(makers[p]())
    return out


def _neighbors(nation: DataFrame, edge: Callable[..., DataFrame]) -> DataFrame:
    """Nations of one region; symmetric, so both ways (25 nations, joined on their region)."""
    a, b = nation.select("n_nationkey", "n_regionkey"), nation.select(F.col("n_nationkey").alias("other"), "n_regionkey")
    pairs = a.join(b, "n_regionkey").filter("n_nationkey <> other")
    return edge(pairs, F.lit("Nation"), "neighbor_of", F.lit("Nation"), node("nation", F.col("n_nationkey")), node("nation", F.col("other")))


def graph(spark: SparkSession, sf_dir: str, predicates: tuple[str, ...] = PREDICATES, fine: bool = True) -> Graph:
    return Graph(staged(base_edges(spark, sf_dir, predicates, fine), "base"), ONTOLOGY)
