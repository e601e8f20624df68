"""Edges that arrive over time, as a stream into the stored hop relation.

An edge may arrive more than once. Within the watermark repeats are dropped from bounded state. Each micro-batch is
held against what is stored, so an edge, or the mirror of a symmetric one, that came in an earlier batch is not stored
again; it is written under its own number, so that a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..ontology import Ontology
from ..operators.graph import base_edges
from ..storage import small, staged


def distinct_edges(edges: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    key = ["subject", "predicate", "object", "object_direction_qualifier", "object_aspect_qualifier"]
    return edges.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def write_base_edges(edges: DataFrame, nodes: DataFrame, ontology: Ontology, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer (call ``start``) that types each micro-batch against ``nodes`` (id, ntype) and stores its base edges."""

    key = ["stype", "pred", "ttype", "s", "t"]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = staged(base_edges(batch, nodes, ontology), "stream")
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            # the store is scanned, not shuffled, where the batch is small; a batch that is run again ignores itself
            stored = spark.read.parquet(path).filter(F.col("batch") != number).select(*key)
            known = staged(stored.join(small(fresh), key, "left_semi"), "stream-known")
            fresh = fresh.join(small(known), key, "left_anti")
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return edges.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def event_counts(events: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Edges by type and time window, late ones up to ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"))
