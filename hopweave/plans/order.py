"""Which way to multiply, and what a plan will cost: decided on the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metapath import size_bucket
from ..operators.paths import Plan


def product_sizes(plan: Plan, sizes: DataFrame) -> DataFrame:
    """(pid, mid, next, about, bucket): of every step after the first, the expected pairs before DISTINCT, if ends
    were independent: pairs of the left times pairs of the right over the nodes between."""
    m = plan.matrices.select("mid", "stype", "nvals")
    n = sizes.select(F.col("ntype").alias("stype"), F.col("n").alias("between"))
    first = plan.steps[0].join(m, "mid").select(F.col("next").alias("pid"), F.col("nvals").cast("double").alias("about"))
    out = None
    for step in plan.steps[1:]:
        here = step.join(first, "pid").join(m, "mid").join(n, "stype").select("pid", "mid", "next", (F.col("about") * F.col("nvals") / F.col("between")).alias("about"))
        out = here if out is None else out.unionByName(here)
        first = here.select(F.col("next").alias("pid"), "about")
    return out.withColumn("bucket", size_bucket(F.col("about")))


def start_from_end(plan: Plan, sizes: DataFrame) -> DataFrame:
    """(pid, from_end): for three-hop paths, whether A(BC) is expected to make fewer rows than (AB)C."""
    m = plan.matrices.select("mid", "stype", "nvals")
    n = sizes.select(F.col("ntype").alias("stype"), F.col("n").alias("between"))
    digits = plan.paths.select("pid", *[(F.floor(F.col("pid") / plan.radix**k) % plan.radix - 1).cast("long").alias(f"m{2 - k}") for k in range(3)])
    one = lambda k: m.join(n, "stype").select(F.col("mid").alias(f"m{k}"), F.col("nvals").alias(f"v{k}"), F.col("between").alias(f"b{k}"))
    rows = digits.join(one(0), "m0").join(one(1), "m1").join(one(2), "m2")
    left = F.col("v0") * F.col("v1") / F.col("b1")
    right = F.col("v1") * F.col("v2") / F.col("b2")
    return rows.select("pid", (right < left).alias("from_end"))
