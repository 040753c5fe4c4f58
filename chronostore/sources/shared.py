"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary
    folder is made and set for the session; on a cluster it is an error, since
    executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/chronostore-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again; a lost executor then costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(spark: SparkSession) -> None:
    """Delete all tables that this application stored. DataFrames that read them are of no more use."""
    delete(spark, _own_folder(spark))


def numbered(df: DataFrame, *order: str, out: str = "nth") -> DataFrame:
    """Add ``out``: 1, 2, ... over all rows in ``order``, without bringing them to one task.

    Rows are dealt by range and stored; the counts of the ranges, one row
    each, give every range its offset.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    here = Window.partitionBy("_part").orderBy(*order)
    return dealt.withColumn("_nth", F.row_number().over(here)).join(offsets, "_part").withColumn(out, (F.col("_nth") + F.col("_offset")).cast("bigint")).drop("_part", "_nth", "_offset")
