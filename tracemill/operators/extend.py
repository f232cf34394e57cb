"""Extension points: defenses, token counters, equality, rewards and measures that a user brings along."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text

from .common import asserted


class Defense(Protocol):
    """Changes the outputs of traces (idx, ..., output): as many rows, other columns as they were."""

    def apply(self, traces: DataFrame) -> DataFrame: ...

    def metadata(self) -> dict: ...


def applied(defense: Defense, traces: DataFrame, key: str = "idx", changes: str = "output") -> DataFrame:
    """defense.apply(traces); fails at a row that is lost, added, or changed elsewhere."""
    out = defense.apply(traces)
    fixed = [c for c in traces.columns if c != changes]
    own = traces.select(*[F.col(c).alias(f"__{c}") for c in fixed])
    both = out.join(own, F.col(key) == F.col(f"__{key}"), "full_outer")
    same = F.lit(True)
    for c in fixed:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return asserted(both, same, "a defense may change outputs alone").select(*traces.columns)


@dataclass(frozen=True)
class Rewrite:
    """A defense from a table of responses (idx, response, finish): guarded rewrites, the source where none is acceptable.

    Its parameters are what kinds of rewrites differ by; responses come from outside.
    """

    responses: DataFrame
    ratio: tuple[float, float] = text.REVOICE_RATIO
    recall: float = text.REVOICE_RECALL
    name: str = "rewrite"
    extra: dict = field(default_factory=dict)

    def apply(self, traces: DataFrame) -> DataFrame:
        other = self.responses.select(F.col("idx").alias("__idx"), F.coalesce("response", F.lit("")).alias("__r"), "finish")
        both = traces.join(other, F.col("idx") == F.col("__idx"), "left")
        reason = text.guard(F.col("output"), F.col("__r"), F.col("finish"), self.ratio, self.recall, list_count=False)
        good = F.col("__r").isNotNull() & reason.isNull()
        return both.withColumn("output", F.when(good, F.col("__r")).otherwise(F.col("output"))).select(*traces.columns)

    def metadata(self) -> dict:
        return {"name": self.name, "ratio": list(self.ratio), "recall": self.recall, **self.extra}


def counter(count: Callable[[list[str]], list[int]]) -> Callable[[Column], Column]:
    """A batched token counter, list of texts to list of numbers, as a column function for token_count and segments."""

    @F.pandas_udf("int")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(count(texts.fillna("").tolist()), dtype="int32")

    return counted


def batched(rewards: Callable[..., list[float]], *columns: str) -> Column:
    """A reward function over batches of columns, as a column."""

    @F.pandas_udf("double")
    def reward(*values: pd.Series) -> pd.Series:
        return pd.Series(rewards(*[v.tolist() for v in values]), dtype="float64")

    return reward(*columns)


def mapped(rows: DataFrame, work: Callable[[dict], dict], schema: str, chunk: int = 64) -> DataFrame:
    """work(row) for each row, in chunks on the executors."""

    def run(batches):
        for batch in batches:
            for first in range(0, len(batch), chunk):
                yield pd.DataFrame([work(r) for r in batch.iloc[first : first + chunk].to_dict("records")])

    return rows.mapInPandas(run, schema)


def measured(rows: DataFrame, key: str, hit: Column) -> DataFrame:
    """(key, n, p, bits): tries, share of hits and surprisal; bits is null where there is no hit."""
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(hit.cast("double")).alias("p"))
    return out.withColumn("bits", F.when(F.col("p") > 0, -F.log2("p")))
