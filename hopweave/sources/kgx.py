"""Node and edge records as JSON lines, and the typed matrices made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ontology import Ontology
from ..operators.graph import Graph, matrix_catalog

NODE = T.StructType([T.StructField("id", T.StringType()), T.StructField("category", T.ArrayType(T.StringType())), T.StructField("name", T.StringType())])
EDGE = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "predicate", "object", "object_direction_qualifier", "object_aspect_qualifier")])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A fixed schema: no pass over the data to infer one."""
    return spark.read.schema(NODE).json(path).filter(F.col("id").isNotNull())


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGE).json(path).filter(F.col("subject").isNotNull() & F.col("object").isNotNull())


def read_graph(spark: SparkSession, nodes: str, edges: str, ontology: Ontology) -> Graph:
    return Graph.from_records(read_nodes(spark, nodes), read_edges(spark, edges), ontology)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_matrices(graph: Graph, path: str) -> None:
    """The base edges, a folder for each predicate, so that a reader opens only the predicates it needs."""
    graph.base.withColumn("predicate", F.col("pred")).repartition("pred", "stype", "ttype").sortWithinPartitions("stype", "ttype", "s", "t").write.mode("overwrite").partitionBy("predicate").parquet(f"{path}/edges")
    matrix_catalog(graph.base).write.mode("overwrite").parquet(f"{path}/catalog")
    graph.sizes.write.mode("overwrite").parquet(f"{path}/node_counts")


def read_matrices(spark: SparkSession, path: str, ontology: Ontology, predicates: list[str] | None = None) -> Graph:
    """The stored graph, or the part of it with these predicates (partition pruning)."""
    base = spark.read.parquet(f"{path}/edges")
    if predicates is not None:
        base = base.filter(F.col("predicate").isin(*predicates))
    return Graph(base.select("stype", "pred", "ttype", "s", "t"), ontology)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/catalog")


def needed_matrices(directed: DataFrame, n_hops: int, stype: str, pred: str, direction: str, ttype: str) -> DataFrame:
    """The base matrices that paths of ``n_hops`` hops from one first matrix, and their targets, can touch: read off
    the catalog by joining types, without data."""
    key = (F.col("stype") == stype) & (F.col("pred") == pred) & (F.col("dir") == direction) & (F.col("ttype") == ttype)
    used = directed.filter(key)
    ends = used.select("ttype").distinct()
    for _ in range(n_hops - 1):
        step = directed.join(F.broadcast(ends.select(F.col("ttype").alias("stype"))), "stype", "left_semi")  # types: a vocabulary
        used, ends = used.unionByName(step), step.select("ttype").distinct()
    targets = directed.filter(F.col("stype") == stype).join(F.broadcast(ends), "ttype", "left_semi").select(*used.columns)
    every = used.unionByName(targets)
    a, b = F.when(F.col("dir") == "R", F.col("ttype")).otherwise(F.col("stype")), F.when(F.col("dir") == "R", F.col("stype")).otherwise(F.col("ttype"))
    return every.select(a.alias("src_type"), "pred", b.alias("tgt_type")).distinct()
