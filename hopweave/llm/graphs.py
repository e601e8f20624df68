"""Connected components of a table of links, by contraction: nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): nodes get equal labels exactly if a path joins them.

    By contraction: every node points to its smallest smaller neighbour, pointers are doubled until they reach the
    roots, and the links are rewritten between roots; what joins a root with itself, or repeats, falls away. So the
    links shrink from round to round, and a chain of n nodes takes log2(n) doublings. Labels are node names, each the
    smallest of its nodes. Links of a node to itself, repeated links and links in both directions are allowed; no
    links give no rows.
    """
    tidy = lambda a, b, df: df.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = staged(tidy(F.col("a"), F.col("b"), links), "links")
    labels = staged(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        up = staged(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "up")
        while True:
            above = up.select(F.col("node").alias("up"), F.col("up").alias("above"))
            step = staged(up.join(above, "up", "left").select("node", F.coalesce("above", "up").alias("up"), F.col("above").isNotNull().alias("moved")), "up")
            up = step.select("node", "up")
            if step.filter("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("node").alias(c), F.col("up").alias(f"root_{c}"))
        labels = staged(labels.join(root("label"), "label", "left").select("node", F.coalesce("root_label", "label").alias("label")), "labels")
        met = edges.join(root("a"), "a").join(root("b"), "b", "left").withColumn("root_b", F.coalesce("root_b", "b"))
        edges = staged(tidy(F.col("root_a"), F.col("root_b"), met), "links")
    return labels
