"""Greedy packing of paragraphs into segments, over rows of paragraphs: where each segment would end is one pointer a
paragraph, from running sums, and which pointers are taken is followed by doubling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import paragraphs, word_count

from .common import settled


def _starts(rows: DataFrame) -> DataFrame:
    """(row, i) of the paragraphs that begin a segment, from (row, i, to): where the segment begun at i ends.

    After k rounds the starts of the first 2 ** k segments are known; pointers that leave a text are dropped.
    """
    known = rows.filter("i = 0").select("row", "i")
    step = settled(rows.filter("to IS NOT NULL").select("row", "i", "to"))
    while not step.isEmpty():
        there = known.join(step, ["row", "i"]).select("row", F.col("to").alias("i"))
        known = settled(known.union(there).distinct())
        second = step.select("row", F.col("i").alias("to"), F.col("to").alias("then"))
        step = settled(step.join(second, ["row", "to"]).select("row", "i", F.col("then").alias("to")))
    return known


def packed(df: DataFrame, text: str, most: int, count: Callable[[Column], Column] = word_count, least_tail: int | None = None) -> DataFrame:
    """Each text's paragraphs packed greedily into segments of at most `most` tokens: df's other columns, position (from 0),
    text, gap (what stands behind the segment) and tokens.

    A paragraph counts with the gap behind it and is never cut. A last segment of under least_tail tokens (most // 4)
    joins the one before it. Texts and gaps of a row put together are its text. Null texts have no segments; rows that
    are alike are packed each. count: any column of texts to numbers, pandas UDFs included.
    """
    tail = most // 4 if least_tail is None else least_tail
    others = [c for c in df.columns if c != text]
    p = paragraphs(F.col(text))
    items = F.arrays_zip(p["parts"].alias("part"), p["gaps"].alias("gap"))
    rows = df.withColumn("row", F.monotonically_increasing_id()).select("row", F.struct(*others).alias("own"), F.posexplode(items).alias("i", "x"))
    rows = rows.select("row", "own", "i", "x.part", "x.gap", F.coalesce(count(F.concat("x.part", "x.gap")), F.lit(0)).cast("long").alias("n"))
    rows = settled(rows)
    by = Window.partitionBy("row")
    before = F.coalesce(F.sum("n").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    summed = rows.select("row", "i", before.alias("before"), F.sum("n").over(by).alias("all"))
    reach = F.max("i").over(by.orderBy("before").rangeBetween(Window.currentRow, most))
    # within a text, to is the first paragraph that the segment has no room for
    to = F.when(F.col("all") - F.col("before") > most, F.greatest(F.col("i") + 1, reach))
    last = F.col("i") == F.max("i").over(by)
    starts = _starts(summed.select("row", "i", to.alias("to"), last.alias("last")).withColumn("to", F.when(~F.col("last"), F.col("to"))).select("row", "i", "to"))
    numbered = rows.join(starts.withColumn("start", F.lit(1)), ["row", "i"], "left")
    numbered = numbered.withColumn("seg", F.sum(F.coalesce("start", F.lit(0))).over(by.orderBy("i")))
    ends = numbered.groupBy("row", "seg").agg(F.sum("n").alias("n")).groupBy("row").agg(F.max(F.struct("seg", "n")).alias("end"))
    short = (F.col("seg") == F.col("end.seg")) & (F.col("seg") > 1) & (F.col("end.n") < tail)
    merged = numbered.join(ends, "row").withColumn("seg", F.col("seg") - short.cast("int"))
    made = merged.groupBy("row", "seg").agg(F.first("own").alias("own"), F.sum("n").alias("tokens"), F.sort_array(F.collect_list(F.struct("i", "part", "gap"))).alias("items"))
    joined = F.array_join(F.transform("items", lambda x, k: F.when(k + 1 < F.size("items"), F.concat(x["part"], x["gap"])).otherwise(x["part"])), "")
    return made.select("own.*", (F.col("seg") - 1).cast("int").alias("position"), joined.alias("text"), F.element_at("items", -1)["gap"].alias("gap"), "tokens")
