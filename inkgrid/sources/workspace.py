"""Places in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@functools.cache
def _temporary(application: str) -> str:
    return f"file://{tempfile.mkdtemp(prefix='inkgrid-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session (tests) gets a temporary one for as long as its application runs, and any other an error: executors elsewhere couldn't read
    it. The session's settings stay as they are."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _temporary(spark.sparkContext.applicationId)


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/inkgrid/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written to the shared folder (with the writer's options) and read again: its lineage ends there, and any executor can read it."""
    spark, path = df.sparkSession, workspace(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """Adds position: 0, 1, ... in the order of the columns `by`. Rows are sorted by ranges and written; a range's base is the sum of what stands before it. Equal rows get their places in any order."""
    ranges = keep(df.repartitionByRange(*by).withColumn("__range", F.spark_partition_id()), "in-order")
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # of ranges: as many as there were tasks
    base = ranges.groupBy("__range").agg(F.count("*").alias("n")).select("__range", before.alias("__base"))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*by)) - 1
    return ranges.withColumn("__own", own).join(base, "__range").withColumn("position", F.col("__base") + F.col("__own")).drop("__range", "__own", "__base")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a file or a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of tables made by keep()."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            delete(df.sparkSession, file.rpartition("/")[0])


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written only if it isn't there whole: the writer's marker says that all its tasks were committed. So a job that was stopped goes on from the last stage that was finished."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)
