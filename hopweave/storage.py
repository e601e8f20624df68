"""Stage files: a table written once into the folder that driver and executors share, and read back.

Plans stay short, work is not repeated, and a lost executor costs nothing that is not in the files.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a plan or vocabulary table up to which it is broadcast (some tens of MB at most); beyond, joins shuffle.
BROADCAST_ROWS = 200_000

#: Temporary folders of applications that set none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where none is set, a temporary folder stands in on one machine; on a cluster, whose
    executors would write to their own disks, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _OWN:
        own = tempfile.mkdtemp(prefix="hopweave-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + own
    return _OWN[context.applicationId]


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a staged table if its counted rows stay under the bound."""
    return F.broadcast(df) if df.count() <= rows else df
