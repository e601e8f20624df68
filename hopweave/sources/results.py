"""Result files: raw overlap rows and scored rows per target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import metapath as mp
from ..operators.grouping import ranked

RAW = T.StructType([
    T.StructField("predictor_metapath", T.StringType()), T.StructField("predictor_count", T.LongType()),
    T.StructField("predicted_metapath", T.StringType()), T.StructField("predicted_count", T.LongType()),
    T.StructField("overlap", T.LongType()), T.StructField("total_possible", T.LongType()),
])
SCORES = ("precision", "recall", "f1", "mcc", "specificity", "npv")


def write_raw(raw: DataFrame, path: str) -> None:
    raw.select(RAW.fieldNames()).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of tab-separated files; lines with another number of fields are skipped."""
    return spark.read.schema(RAW).option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").option("enforceSchema", True).csv(paths)


def write_grouped(grouped: DataFrame, path: str) -> None:
    """One folder for each target, rows by falling overlap; a rerun overwrites only the targets it holds."""
    rows = ranked(grouped).withColumn("target", mp.file_name(F.col("predicted_metapath")))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("target").parquet(path)


def read_grouped(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    out = spark.read.parquet(path)
    if target is not None:
        out = out.filter(F.col("target") == target.replace("|", "_").replace(":", "_").replace(" ", "_"))
    return out.drop("target")


def grouped_lines(grouped: DataFrame) -> DataFrame:
    """(target, place, line): the text lines of each target's file, scores with six decimals."""
    from pyspark.sql import Window

    scores = [F.format_string("%.6f", c) for c in SCORES]
    line = F.concat_ws("\t", "predictor_metapath", "orientation", F.col("predictor_count").cast("string"), F.col("overlap").cast("string"), F.col("total_possible").cast("string"), *scores)
    order = Window.partitionBy("predicted_metapath").orderBy(F.desc("overlap"), "predictor_metapath", "orientation")
    return grouped.select(mp.file_name(F.col("predicted_metapath")).alias("target"), F.row_number().over(order).alias("place"), line.alias("line"))


def write_grouped_tsv_zst(grouped: DataFrame, path: str) -> None:
    """One zstandard-compressed tab-separated file for each target, for readers of that format.

    Spark's text writers have no zstandard codec here, so each target's lines are compressed where they are, in one
    task per target, streaming; ``path`` must be a folder that all executors share.
    """
    header = "\t".join(("predictor_metapath", "orientation", "predictor_count", "overlap", "total_possible", *SCORES))

    def write(rows) -> None:
        import os

        import zstandard

        os.makedirs(path, exist_ok=True)
        out, now = None, None
        for r in rows:
            if r["target"] != now:
                if out:
                    out.close()
                    os.replace(f"{path}/{now}.tsv.zst.part", f"{path}/{now}.tsv.zst")
                now = r["target"]
                out = zstandard.open(f"{path}/{now}.tsv.zst.part", "wt")
                out.write(header + "\n")
            out.write(r["line"] + "\n")
        if out:
            out.close()
            os.replace(f"{path}/{now}.tsv.zst.part", f"{path}/{now}.tsv.zst")

    grouped_lines(grouped).repartition("target").sortWithinPartitions("target", "place").foreachPartition(write)
