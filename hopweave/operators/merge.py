"""Operations on result tables: merging, first-seen counts, checks, comparison, samples, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metapath import SIZE_BUCKETS, size_bucket

KEYS = ["predictor_metapath", "predicted_metapath"]
COUNTS = ["predictor_count", "predicted_count", "overlap", "total_possible"]

#: How many samples of each size are taken first.
LEAST_SAMPLES = {"tiny": 400, "small": 200, "medium": 150, "large": 100, "xlarge": 75, "xxlarge": 50, "huge": 25}


def merged(raw: DataFrame) -> DataFrame:
    """Rows of one predictor and target become one; all four counts are added."""
    return raw.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def first_seen(counts: DataFrame) -> DataFrame:
    """(path, n) from (path, n, file): the count in the file of the lowest number."""
    return counts.groupBy("path").agg(F.min_by("n", "file").alias("n"))


def explicit_counts(raw: DataFrame) -> DataFrame:
    """(path, n): predictors and targets of raw rows, each once."""
    both = raw.select(F.col("predictor_metapath").alias("path"), F.col("predictor_count").alias("n")).unionByName(raw.select(F.col("predicted_metapath").alias("path"), F.col("predicted_count").alias("n")))
    return both.groupBy("path").agg(F.min("n").alias("n"))


def inconsistent(counts: DataFrame) -> DataFrame:
    """Paths with more than one count; must be empty."""
    return counts.groupBy("path").agg(F.min("n").alias("low"), F.max("n").alias("high")).filter("low <> high")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one multiset and not the other, with ``side``; empty if the results are equal."""
    right = right.select(left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def missing(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Expected keys that were not found (files, first matrices)."""
    return expected.select(key).join(found.select(key), key, "left_anti").distinct()


def stratified_sample(items: DataFrame, size: str, total: int, seed: int = 42, least: dict[str, int] | None = None) -> DataFrame:
    """``items`` with ``bucket``: of each size bucket a least number, and what is left in proportion to the buckets."""
    least = LEAST_SAMPLES if least is None else least
    rows = items.withColumn("bucket", size_bucket(F.col(size)))
    found = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # seven buckets
    left, quota = total, {}
    for name in [n for n, _ in SIZE_BUCKETS] + ["huge"]:
        quota[name] = min(least.get(name, 0), found.get(name, 0), left)
        left -= quota[name]
    every = sum(found.values())
    for name, n in found.items():
        quota[name] += min(left * n // max(1, every), n - quota[name])
    limit = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    # a bucket's rows above its quota are cut by rank; ranks come from a hash, so the sample is the same every time
    w = Window.partitionBy("bucket").orderBy(F.xxhash64(*items.columns, F.lit(seed)))
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.try_element_at(limit, F.col("bucket"))).drop("rank")


def sample_nodes(nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """About ``count`` nodes, evenly over the numbers of categories a node has, filled up from the rest."""
    rows = nodes.withColumn("kinds", F.size("category")).withColumn("draw", F.xxhash64("id", F.lit(seed)))
    groups = rows.select("kinds").distinct().count()
    each = count // max(1, groups)
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kinds").orderBy("draw", "id")))
    first = F.when(F.col("rank") <= each, 0).otherwise(1)
    return ranked.orderBy(first, "draw", "id").limit(count).select(nodes.columns)


def sample_edges(edges: DataFrame, nodes: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """At most ``count`` edges with both ends among ``nodes``."""
    ids = nodes.select("id")
    both = edges.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    return both.orderBy(F.xxhash64("subject", "predicate", "object", F.lit(seed)), "subject", "predicate", "object").limit(count).select(edges.columns)


def category_frequencies(nodes: DataFrame, top: int | None = None) -> DataFrame:
    out = nodes.select(F.explode("category").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category")
    return out if top is None else out.limit(top)


def top_predictors(raw: DataFrame, n: int) -> DataFrame:
    """The report of the n largest predictors."""
    return raw.select("predictor_metapath", "predictor_count").distinct().orderBy(F.desc("predictor_count"), "predictor_metapath").limit(n)


def bucket_averages(timings: DataFrame, size: str, seconds: str) -> DataFrame:
    """(bucket, n, mean, percentiles) of measured times."""
    return timings.groupBy(size_bucket(F.col(size)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("mean"), F.percentile(seconds, F.array(*map(F.lit, (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)))).alias("percentiles"))


def estimated_seconds(plan: DataFrame, size: str, averages: DataFrame) -> DataFrame:
    """(bucket, paths, seconds): the plan's products by size, each at its bucket's mean time."""
    by = plan.groupBy(size_bucket(F.col(size)).alias("bucket")).agg(F.count(F.lit(1)).alias("paths"))
    return by.join(F.broadcast(averages.select("bucket", "mean")), "bucket", "left").select("bucket", "paths", (F.col("paths") * F.coalesce("mean", F.lit(0.0))).alias("seconds"))  # seven buckets


def status_counts(tracking: DataFrame, column: str = "status") -> DataFrame:
    return tracking.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
