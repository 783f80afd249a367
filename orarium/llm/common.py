"""What the operators of this subpackage share: a folder for written tables, and maps over Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows, and bytes, of whole texts that a Python worker is sent at once; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20
#: Bytes of text for a task of a range sort, beyond the session's number of shuffle partitions.
SORT_BYTES = 512 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of spark.checkpoint.dir. Only a local session (tests) may leave that unset: it
    gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="orarium-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions_for(spark: SparkSession, size: int | None) -> int:
    """How many partitions a sort of `size` bytes takes: the session's number, and more where they would grow too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SORT_BYTES))


def written(df: DataFrame, name: str, temporary: list[DataFrame] | None = None) -> DataFrame:
    """The rows of df as a table in the shared folder: cuts lineage, and survives lost executors.

    temporary: where the table is noted that its maker will discard."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if temporary is not None:
        temporary.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under names of our own, so that further or clashing columns do no harm."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """mapInArrow with batches that stay small although texts are long.

    Spark reads both limits from the session when the plan runs, so they are lowered there, and stay so."""
    spark = df.sparkSession
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batch(types: dict[str, pa.DataType], *columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4: learners leave out the rows where it is 2. Null: -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(-1))
