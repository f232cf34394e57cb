"""Appending work that resumes exactly: units are done once, whatever is stopped and started again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tracemill.sources.sinks import exists


def process_new_files(
    spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str
) -> StreamingQuery:
    """Runs work over the files of a folder that earlier runs with the same checkpoint have not seen, and appends the
    result to target; ends when there are none left. A stopped run is taken up where it was, nothing is done twice."""
    rows = spark.readStream.schema(schema).json(source)
    return work(rows).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows at path; made and written there only if no finished run has."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def progress(query: StreamingQuery, total_rows: int) -> dict[str, float]:
    """Rows done, rows a second, and seconds left at that rate."""
    done = sum(p["numInputRows"] for p in query.recentProgress)
    seconds = sum(p["batchDuration"] for p in query.recentProgress) / 1000
    rate = done / seconds if seconds else 0.0
    return {"rows": done, "rate": rate, "left": (total_rows - done) / rate if rate else float("inf")}
