"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: space and U+0009 to U+000D, nothing else.
GAP = "[ \\t-\\r]+"
WORD = "[^ \\t-\\r]+"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares for checkpoints; a temporary one only where none is set and all is one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all workers share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracemill-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and cuts its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while f"__{name}" in taken:
        name += "_"
    return f"__{name}"


def word_count(text: Column) -> Column:
    """Number of words, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shield(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns that begin with __ under other names, and what gives those names back to a result."""
    own = {c: f"kept{i}{c}" for i, c in enumerate(df.columns) if c.startswith("__")}
    back = {new: old for old, new in own.items()}
    return df.withColumnsRenamed(own), lambda out: out.withColumnsRenamed(back)


def row_hash(df: DataFrame, *of: str) -> Column:
    """A hash of the columns named, or of all: rows that tie in it are alike. Maps, which have no hash, go as JSON."""
    names = of or df.columns
    maps = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}
    return F.xxhash64(*[F.to_json(F.col(f"`{c}`")) if c in maps else F.col(f"`{c}`") for c in names])


def occurrence(df: DataFrame, key: str, most: int, to: str, weight: Column | None = None) -> DataFrame:
    """Adds column `to`: 0, or the number of the row among those of its key where the key's rows weigh over `most`.

    weight: of a row, 1 by default. Numbers are 0, 1, 2 ... within each such key whatever way the rows are split, so that
    alike rows get the same set of numbers in every run. Counted by key and partition first; the hot keys, fewer than the
    weight of all rows / most, are broadcast while they are at most 10,000. df has to be a scan or a checkpoint.
    """
    w = F.lit(1) if weight is None else weight
    placed = df.withColumn("__part", F.spark_partition_id())
    hot = placed.groupBy(key).agg(F.sum(w).alias("__w"), F.count(F.lit(1)).alias("__n"))
    hot = settle(hot.filter((F.col("__w") > most) & (F.col("__n") > 1)).select(F.col(key).alias("__hot")))
    n = hot.count()
    if n == 0:
        return df.withColumn(to, F.lit(0).cast("long"))
    known = F.broadcast(hot) if n <= 10_000 else hot
    is_hot = F.col(key).eqNullSafe(F.col("__hot"))
    counts = placed.select(key, "__part").join(known, is_hot).groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = counts.select(F.col(key).alias("__k"), F.col("__part").alias("__q"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__from"))
    cold = df.join(known, is_hot, "left_anti").withColumn(to, F.lit(0).cast("long"))
    within = Window.partitionBy(key, "__part").orderBy("__place")
    mine = placed.withColumn("__place", F.monotonically_increasing_id()).join(known, is_hot).drop("__hot")
    mine = mine.withColumn("__in", F.row_number().over(within) - 1)
    mine = mine.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__part") == F.col("__q")))
    return cold.unionByName(mine.withColumn(to, (F.col("__from") + F.col("__in")).cast("long")).select(*cold.columns))


def running_start(df: DataFrame, group: list[str], order: str, value: str, to: str, block: int = 2048) -> DataFrame:
    """Adds the sum of value over earlier rows of the group, by an integer order column that counts from 0.

    Blocks of `block` consecutive numbers are summed first, so that no window holds more than `block` rows of
    one level, but for the blocks themselves.
    """
    high = df.withColumn("__run", F.floor(F.col(order) / block))
    sums = high.groupBy(*group, "__run").agg(F.sum(value).alias("__run_sum"))
    before = Window.partitionBy(*group).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"__run_g{i}" for i in range(len(group))]
    sums = sums.select(
        *[F.col(g).alias(n) for g, n in zip(group, names)],
        F.col("__run").alias("__run_of"),
        F.coalesce(F.sum("__run_sum").over(before), F.lit(0)).alias("__run_base"),
    )
    on = F.col("__run") == F.col("__run_of")
    for g, n in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    within = Window.partitionBy(*group, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        high.withColumn("__run_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(sums, on)
        .withColumn(to, F.col("__run_base") + F.col("__run_in"))
        .drop("__run", "__run_of", "__run_base", "__run_in", *names)
    )
