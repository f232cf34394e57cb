"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash. Pass two takes one bucket at
a time into memory, shuffles it by Fisher-Yates and deals its rows out; the buckets' sizes, known from a scan of
the key alone, say where each bucket's run of global places begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, occurrence, row_hash, running_start, shield, text_or_empty

_BUCKET, _COPY, _ROW = "__bucket", "__copy", "__row"


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniform permutation of range(n); numpy's permutation is the Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64([seed, bucket])).permutation(n)


def shard(
    docs: DataFrame,
    shards: int = 40,
    text: str = "text",
    seed: int = 20,
    bucket_bytes: int = 12 << 20,
) -> DataFrame:
    """Adds to each row its shard (int) and its slot there (long), in an order that is random but repeatable.

    Law `rows`: global place p goes to shard p mod shards, slot p div shards, so that counts differ by one at
    most and slots have no gaps. docs has to be a scan or a checkpoint.

    Rows are scattered by a hash of all their columns, so rows of one key with other texts part; alike rows that together
    hold more than an eighth of a bucket's bytes are numbered and scattered by number. A bucket holds bucket_bytes on
    average, and more only by chance or by one longer row. Nulls in any column: kept. Ties, that is repeated rows: each
    has a slot of its own, and it does not matter which has which. Very long texts: travel whole. Empty input: no rows,
    same columns. Columns named shard or slot are replaced, others stay.
    """
    docs, restore = shield(docs.drop("shard", "slot"))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 64
    total = docs.select(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes), 96 if total > bucket_bytes else 1)
    hashed = docs.withColumn(_ROW, row_hash(docs))
    placed = occurrence(hashed, _ROW, bucket_bytes // 8, _COPY, size).withColumn(
        _BUCKET, F.pmod(F.xxhash64(F.lit(seed), _ROW, _COPY), F.lit(buckets))
    )
    sizes = placed.groupBy(_BUCKET).agg(F.count(F.lit(1)).alias("__n"))
    starts = running_start(sizes, [], _BUCKET, "__n", "__start").select(F.col(_BUCKET).alias("__of"), "__start")
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *placed.select(_BUCKET).schema.fields, T.StructField("__local", T.LongType())])

    def shuffled(table: pa.Table) -> pa.Table:
        bucket = table.column(_BUCKET)[0].as_py()
        ties = pa.table({"h": table.column(_ROW), "c": table.column(_COPY), "i": pa.array(range(table.num_rows))})
        order = ties.sort_by([("h", "ascending"), ("c", "ascending")]).column("i")
        take = np.asarray(order)[fisher_yates(table.num_rows, seed, bucket)]
        out = table.select([*names, _BUCKET]).take(pa.array(take))
        return out.append_column("__local", pa.array(range(table.num_rows), pa.int64()))

    # about a bucket a task, so that a task's reading does not grow with the corpus
    local = placed.repartition(min(buckets, 100_000), _BUCKET).groupBy(_BUCKET).applyInArrow(shuffled, schema)
    if buckets <= 1_000_000:  # 16 bytes each
        starts = F.broadcast(starts)
    place = F.col("__start") + F.col("__local")
    return restore(
        local.join(starts, F.col(_BUCKET) == F.col("__of")).select(
            *[F.col(f"`{c}`") for c in names],
            (place % shards).cast("int").alias("shard"),
            F.floor(place / shards).cast("long").alias("slot"),
        )
    )


def write_shards(sharded: DataFrame, path: str, shards: int = 40, file_rows: int = 1_000_000) -> None:
    """One folder per shard, shard=<n>; its files hold consecutive slots, at most file_rows each, in order of slot.

    Rows of a shard are dealt to files by slot before they are written, so there are rows / file_rows + shards files,
    however many tasks made the rows. Spark commits the folder as a whole. Nulls and empty tables: written as they are.
    """
    most = sharded.agg(F.max("slot")).first()[0]
    files = shards * (1 + (most or 0) // file_rows)
    own, restore = shield(sharded)
    dealt = own.withColumn("__file", F.floor(F.col("slot") / file_rows))
    dealt = dealt.repartition(min(files, 100_000), "shard", "__file").sortWithinPartitions("shard", "slot").drop("__file")
    restore(dealt).write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `shard` defines it; nulls, ties, long texts and empty tables likewise."""
    out = shard(documents(spark, sf_dir).select("doc_id", "text"), shards=40)
    text = text_or_empty()
    return out.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
