"""Tables that cut lineage, and joins that a hot key cannot stall."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and Spark runs in one process (tests), a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        place = spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="utrflow-")
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the session's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Deletes tables that ``written`` gave and that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "stored_at", None):
            dropped(path, table.sparkSession)
            _made.remove((table.sparkSession, path))
            table.stored_at = None


def dropped(df_path: str, spark: SparkSession) -> None:
    """Deletes a table that ``new_path`` named."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clear() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is not None:
                dropped(path, spark)


def numbered(rows: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``rows`` with their place in an order of columns, from 0, written: no task holds more than a range of the order.

    Rows are dealt by ranges of the order, sorted and numbered within, and the ranges' sizes added up (a row a partition).
    Rows that are equal in the order get numbers in any order.
    """
    apart = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    own = apart.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    table = written(own, "numbered")
    sizes = sorted(table.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for r in sizes:
        before.append((r["__part"], total))
        total += r["n"]
    first = rows.sparkSession.createDataFrame(before, "__part int, __first long")
    return table.join(F.broadcast(first), "__part").withColumn(name, F.col("__first") + F.col("__at")).drop("__part", "__at", "__first")


#: Tables of up to so many rows (4^8) are broadcast by hint; how larger ones are joined is Spark's choice.
SMALL = 1 << 16


def small(table: DataFrame, rows: int) -> DataFrame:
    """``table``, of at most so many rows by what it is, with a broadcast hint if they are few."""
    return F.broadcast(table) if rows <= SMALL else table


def join_sized(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (unique ``key``, with the number of rows of each group in ``size``).

    Fewer than ``share`` groups can hold more than ``total / share`` rows each, so those are broadcast; no other key
    brings more than that many rows to a task of the shuffle join.
    """
    most = max(1000, total // share)
    hot = F.broadcast(groups.filter(F.col(size) > most))
    cold = groups.filter(F.col(size) <= most)
    return rows.join(hot, key, "inner").unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
