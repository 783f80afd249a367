"""Orders over whole tables without a task that holds them, and tables that end long plans."""

from __future__ import annotations

import math
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


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


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """The rows of df, computed once and written to the shared folder, so that they outlive executors and end the plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by `settled` that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that `spread` gives a task.
ROWS_A_TASK = 50_000


def spread(df: DataFrame, *keys: str, rows: int = ROWS_A_TASK) -> DataFrame:
    """df dealt by keys over tasks of some `rows` rows each, at least one a core. What a task sorts or groups by these keys
    (and others) stays as large as it is however the table grows, and a file of one row group is read by one task only once."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(least, math.ceil(df.count() / rows)), *keys)


@dataclass(frozen=True)
class Run:
    """What `running` gathers of a column: its sum, max or min, over the rows up to this one, or before it."""

    column: Column
    how: str = "sum"
    before: bool = False


GATHER = {"sum": F.sum, "max": F.max, "min": F.min}
BOTH = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}
PLACE = ["_part", "_salt"]


def in_order(df: DataFrame, order: list[Column], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """df range-sorted by keys and order, with the number of each row's partition. Equal rows are told apart by a number of
    their own, so that any number of them spreads. Written, as the numbers must stay what they are."""
    salted = df.withColumn("_salt", F.monotonically_increasing_id())
    return settled(salted.repartitionByRange(*[F.col(k) for k in keys], *order, "_salt").withColumn("_part", F.spark_partition_id()), "in-order")


def running(df: DataFrame, order: list[Column], keys: list[str] | tuple[str, ...] = (), **columns: Column | Run) -> DataFrame:
    """df with what each column adds up to (or its highest or lowest value) over the rows of the same keys up to this one.

    Rows are range-sorted; a window runs inside each partition and key, and what the key's rows in earlier partitions
    come to is carried over: a table of one row a partition. So a key of any size is spread over tasks. Rows that
    `in_order` has placed by the same order are used as they are, and stay so."""
    runs = {n: c if isinstance(c, Run) else Run(c) for n, c in columns.items()}
    ready = all(c in df.columns for c in PLACE)
    rows = df if ready else in_order(df, order, keys)
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    ends = rows.groupBy("_part").agg(F.min(key).alias("_run_first"), F.max(key).alias("_run_last"))
    tails = rows.join(F.broadcast(ends), "_part").where(key == F.col("_run_last")).groupBy("_part", "_run_first", "_run_last").agg(*[GATHER[r.how](r.column).alias(f"_t_{n}") for n, r in runs.items()])
    whole = Window.partitionBy("_run_last")
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    tails = settled(tails.select("_part", "_run_first", "_run_last", *[GATHER[r.how](f"_t_{n}").over(w).alias(f"_{w_}_{n}") for n, r in runs.items() for w_, w in (("b", earlier), ("a", whole))]), "tails")
    # a partition inside one key goes on from those before it; one that ends with another takes all that its first key had
    inside = tails.where("_run_first = _run_last").select("_part", "_run_first", *[F.col(f"_b_{n}").alias(f"_c_{n}") for n in runs])
    total = tails.groupBy(F.col("_run_last").alias("_run_first")).agg(F.min("_part").alias("_run_from"), *[F.first(f"_a_{n}").alias(f"_c_{n}") for n in runs])
    across = tails.where("_run_first <> _run_last").select("_part", "_run_first").join(total, "_run_first").where("_run_from < _part").drop("_run_from")
    carried = inside.unionByName(across)
    out = rows.join(F.broadcast(carried), "_part", "left")

    def gathered(name: str, r: Run) -> Column:
        upto = Window.partitionBy("_part", *keys).orderBy(*order, "_salt").rowsBetween(Window.unboundedPreceding, -1 if r.before else Window.currentRow)
        return BOTH[r.how](GATHER[r.how](r.column).over(upto), F.when(key == F.col("_run_first"), F.col(f"_c_{name}"))).alias(name)

    return out.select(*[c for c in rows.columns if ready or c not in PLACE], *[gathered(n, r) for n, r in runs.items()])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's number, from 0, in a total order."""
    return running(df, order, **{name: F.lit(1)}).withColumn(name, F.col(name) - 1)
