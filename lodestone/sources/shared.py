"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back to a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lodestone-")
    return f"file://{_LOCAL[app]}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from Parquet files in the shared folder, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` wrote, once nothing will read them again."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has few rows, else as it is.

    ``df`` should be written and narrow; its rows are counted.
    """
    return F.broadcast(df) if df.count() <= rows else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, which should be narrow, with its rows numbered from 0 in an order, as ``name``.

    Tasks sort and count ranges of rows; a row's number is its place in its range
    behind the rows of the ranges before. Only the ranges' counts meet in a task.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    ranges = written(df.orderBy(*order).select(row, F.spark_partition_id().alias("range"), place.alias("place")), "numbered")
    sums = ranges.groupBy("range").count()
    before = F.sum("count").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return ranges.join(F.broadcast(sums), "range").select("row.*", (F.col("before") + F.col("place")).alias(name))
