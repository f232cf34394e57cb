"""What the operators share: cutting lineage, assertions, ranks over all rows."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares; a temporary one serves where all is one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all workers share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracemill-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than there are cores, as a table of one row group does. df has to
    be a scan: behind a shuffle, asking for its partitions would run it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def asserted(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """df; running it fails with the message at the first row for which condition is not true."""
    return df.filter(F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def accumulated(df: DataFrame, order: list[Column], value: Column, to: str) -> DataFrame:
    """Adds the sum of value over all rows up to and with each, in an order without ties.

    Rows are range-sorted into partitions; each adds up its own, and the partitions' sums, one row each, give the
    offsets. No task holds more than a partition.
    """
    ranged = settled(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__v", value))
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("__s"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sums.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranged.withColumn("__in", F.coalesce(F.sum("__v").over(within), F.lit(0)))
    joined = rows.join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return joined.withColumn(to, F.col("__start") + F.col("__in")).drop("__part", "__v", "__p", "__start", "__in")


def ranked(df: DataFrame, order: list[Column], to: str = "rank") -> DataFrame:
    """Adds each row's place among all rows, from 0, in an order without ties."""
    return accumulated(df, order, F.lit(1), to).withColumn(to, F.col(to) - 1)
