"""Waiting for what a run depends on: a stream source that polls it, and a gate that acts on its answer.

The source is a Python data source, so it runs where Spark runs streams and its polls are batches with offsets; a
batch waits for nothing, and the trigger sets the pace.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "poll long, waited_s double, status string"


class _Polls(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.timeout = options["url"], float(options.get("timeout_s", "600"))
        self.answer_s, self.text = float(options.get("answer_s", "5")), options.get("contains", "")

    def initialOffset(self) -> dict:
        return {"poll": 0, "began": time.time(), "over": 0}

    def _ready(self) -> bool:
        try:
            with urlopen(self.url, timeout=self.answer_s) as answer:
                return self.text.encode() in answer.read(1 << 20)
        except OSError:  # not there yet, refused, or no answer in time
            return False

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["over"]:
            return iter([]), start
        waited = time.time() - start["began"]
        status = "ready" if self._ready() else "timed_out" if waited >= self.timeout else "waiting"
        end = start | {"poll": start["poll"] + 1, "over": int(status != "waiting")}
        return iter([(end["poll"], waited, status)]), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """A batch that is run again polls anew: what it saw before may no longer hold."""
        return self.read(start | {"over": 0})[0]

    def commit(self, end: dict) -> None:
        pass


class Readiness(DataSource):
    """Format `readiness`: a row a poll until the url answers (with `contains` in it) or timeout_s have passed."""

    @classmethod
    def name(cls) -> str:
        return "readiness"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Polls:
        return _Polls(self.options)


def polls(spark: SparkSession, url: str, timeout_s: float, contains: str = "") -> DataFrame:
    """The stream (poll, waited_s, status): waiting, then ready or timed_out, and nothing more."""
    spark.dataSource.register(Readiness)
    options = {"url": url, "timeout_s": str(timeout_s), "contains": contains}
    return spark.readStream.format("readiness").options(**options).load()


def when_ready(
    spark: SparkSession, url: str, action: Callable[[], None], checkpoint: str, timeout_s: float = 600, poll_s: float = 1, contains: str = ""
) -> tuple[str, int]:
    """Runs action once the url answers; (ready or timed_out, number of polls). After a time-out action is not run."""
    last: list[tuple[str, int]] = []

    def batch(rows: DataFrame, _: int) -> None:
        for r in rows.orderBy("poll").collect():  # one a poll
            if not last and r["status"] != "waiting":
                if r["status"] == "ready":
                    action()
                last.append((r["status"], r["poll"]))

    query = polls(spark, url, timeout_s, contains).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    query = query.trigger(processingTime=f"{int(poll_s * 1000)} milliseconds").start()
    while not last and query.isActive:
        time.sleep(min(poll_s, 0.2))
    if not query.isActive:
        query.awaitTermination()  # raises what ended it
    query.stop()
    return last[0]
