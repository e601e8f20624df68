"""What the training-data operators share: tables, stage files in the shared folder, size-checked broadcasts.

Executors may be lost at any time, so lineage is cut only by files that every executor can read: each
intermediate is written as Parquet below ``spark.checkpoint.dir``. Nothing is kept on one machine.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructField, StructType

#: Rows that a Python function works on at a time.
ARROW_ROWS = 256
#: Bytes of a table's values up to which it is broadcast; beyond it, joins shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of files that a stage reads for each file that it writes, at least.
PART_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts differ in length by five orders of magnitude. Spark bounds a batch by bytes; this cuts it into views of
    few rows, so that what Python holds besides stays small. No setting of the session is touched."""
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


#: Temporary folders of applications that set none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one stands in on one machine; on a
    cluster, whose executors would write to their own disks, that is an error."""
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


def parts_wanted(df: DataFrame) -> int:
    """Files that ``df`` is worth by the files it reads; twice the cluster's cores at least, so none is left idle."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    read = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-read // PART_BYTES))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage and survives lost executors.

    A small table that was shuffled into many partitions goes to few files: an empty one costs as much to write and
    open as a full one. Nothing is shuffled for that, and large tables keep their partitions.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    wanted = parts_wanted(df)
    # sizes that are not known count as huge
    (df.coalesce(wanted) if wanted < 1 << 20 else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(f: StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, ArrayType):
        each = 8 * len(f.dataType.elementType.fields) + 16 if isinstance(f.dataType.elementType, StructType) else 8
        return 16 + each * F.coalesce(F.size(c), F.lit(0)).cast("long")
    if isinstance(f.dataType, StringType | BinaryType):
        return 16 + F.coalesce(F.octet_length(c), F.lit(0)).cast("long")
    return F.lit(8)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a staged table only if its bytes stay under the bound, else leave the join to shuffle.

    Files of a sixteenth of the bound are small whatever their encoding made of them (keys are hashes, which do not
    compress), files above the bound are large; in between the values are measured.
    """
    files = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if most and files * 16 > most:
        held = most + 1 if files > most else df.agg(F.sum(sum((_bytes(f) for f in df.schema.fields), F.lit(16)))).first()[0] or 0
        return df if held > most else F.broadcast(df)
    return F.broadcast(df) if most else df


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def shielded(df: DataFrame, needed: list[str]) -> tuple[DataFrame, Callable[[], list[Column]]]:
    """``df`` with all columns but ``needed`` under names that no operator uses, and the columns that undo it."""
    names = {c: c if c in needed else f"__other{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(quoted(c)).alias(n) for c, n in names.items()]), lambda: [F.col(n).alias(c) for c, n in names.items()]


def map_text(df: DataFrame, keep: list[str], text: str, fields: list[pa.Field], make: Callable[[], Callable[[list[str | None]], list]], whole: bool = False) -> DataFrame:
    """Apply a per-text function in Arrow batches: the columns ``keep``, whatever their names, and one column per field.

    ``make`` runs once in each task and returns the function, so that tables and caches are built there. With
    ``whole`` the function takes a batch's texts and returns a list for each field.
    """
    kept = [f"k{i}" for i in range(len(keep))]
    source = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(quoted(text)).cast("string").alias("t"))
    schema = StructType([source.schema[k] for k in kept] + [StructField(f"f{i}", from_arrow_type(f.type)) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in parts(batches):
            texts = batch.column(len(kept)).to_pylist()
            made = one(texts) if whole else list(zip(*map(one, texts), strict=True)) or [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + [pa.array(list(m), type=f.type) for m, f in zip(made, fields, strict=True)], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def filter_text(df: DataFrame, make: Callable[[], Callable[[str | None], bool]], text: str = "text") -> DataFrame:
    """The rows of ``df`` whose text passes, all columns unchanged, whatever their names."""
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for batch in parts(batches):
            yield batch.filter(pa.array([bool(passes(t)) for t in batch.column(at).to_pylist()], type=pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learnt (a null id counts as the text '')."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """Every labelled document (doc_id, y) that is not held out.

    Rows without an id or label are left out; a document labelled twice counts once, with its larger label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
    return known.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))


def label_sample(labels: DataFrame, column: str, rows: int) -> DataFrame:
    """At most ``rows`` of :func:`known_labels`: those of the lowest hash."""
    return known_labels(labels, column).orderBy(F.xxhash64(F.col("doc_id"), F.lit(17)), "doc_id").limit(rows)
