"""Numbers, running values and lookups that no hot group can slow: groups are cut wherever a range of the order ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

PART = "__part"


def _same(left: DataFrame, right: DataFrame, names: list[str], to: str) -> tuple[DataFrame, Column]:
    """right with its key columns renamed, and the condition that they equal left's; null equals null."""
    on = F.lit(True)
    for i, name in enumerate(names):
        right = right.withColumnRenamed(name, f"{to}{i}")
        on = on & F.col(name).eqNullSafe(F.col(f"{to}{i}"))
    return right, on


def numbered(df: DataFrame, group: list[str], order: list[Column], to: str) -> DataFrame:
    """df with column `to`, the row's number in its group from 0, and PART, the range of the order that it lies in.

    The rows are range-sorted by group and order, so a group may span many ranges, and each range counts its own rows.
    Only the first group of a range goes on from an earlier one: there is one start a range to add, and those are
    broadcast. order has to be without ties but for rows that are alike, and given ascending.
    """
    ranged = settle(df.repartitionByRange(*group, *order).withColumn(PART, F.spark_partition_id()))
    within = Window.partitionBy(PART, *group).orderBy(*order)
    rows = ranged.withColumn(to, F.row_number().over(within).cast("long") - 1)
    before = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = ranged.groupBy(*group, PART).agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.withColumn("__start", F.sum("__n").over(before)).filter("__start > 0").drop("__n")
    starts, on = _same(rows, starts, [*group, PART], "__s")
    rows = rows.join(F.broadcast(starts), on, "left")
    return rows.withColumn(to, F.col(to) + F.coalesce(F.col("__start"), F.lit(0))).drop(*starts.columns)


_TOTAL = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}
_BOTH = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "max": F.greatest,
    "xor": lambda a, b: F.coalesce(a, F.lit(0).cast("long")).bitwiseXOR(F.coalesce(b, F.lit(0).cast("long"))),
}


def running(df: DataFrame, group: str, order: str, values: dict[str, tuple[str, Column]], down: bool = False, before_it: bool = False) -> DataFrame:
    """Adds a running sum, max or xor of each value over the rows of the group up to and with each, by order.

    df has PART as `numbered` makes it: of a group's rows, those of lower order lie in lower or equal ranges, and only
    one group goes on from one range to the next, so the values carried over are one row a range and are broadcast.
    down: from the last row back. before_it: without the row itself.
    """
    way = F.desc if down else F.asc
    within = Window.partitionBy(PART, group).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, -1 if before_it else 0)
    before = Window.partitionBy(group).orderBy(way(PART)).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = df.groupBy(group, PART).agg(F.count(F.lit(1)).alias("__n"), *[_TOTAL[f](v).alias(f"__t_{to}") for to, (f, v) in values.items()])
    carried = totals.select(
        group, PART, F.sum("__n").over(before).alias("__n"), *[_TOTAL[f](f"__t_{to}").over(before).alias(f"__t_{to}") for to, (f, _) in values.items()]
    ).filter("__n > 0")
    rows = df.withColumns({to: _TOTAL[f](v).over(within) for to, (f, v) in values.items()})
    carried, on = _same(rows, carried, [group, PART], "__c")
    rows = rows.join(F.broadcast(carried), on, "left")
    return rows.withColumns({to: _BOTH[f](F.col(f"__t_{to}"), F.col(to)) for to, (f, _) in values.items()}).drop(*carried.columns)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, most: int = 10_000) -> DataFrame:
    """rows joined to table, which has each key once and, in `weight`, at least as many as the rows of that key.

    Keys of over 256 rows and over 1 / most of all weight are hot: there are at most `most`, and they are broadcast;
    the others are joined by shuffle. Both have to be scans or checkpoints.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) > max(256, total // most)
    names = [f"__l{i}" for i in range(len(on))]
    renamed = table.withColumnsRenamed(dict(zip(on, names)))
    equal = [F.col(a) == F.col(b) for a, b in zip(on, names)]
    few = F.broadcast(renamed.filter(hot))
    cold = rows.join(F.broadcast(renamed.filter(hot).select(*names)), equal, "left_anti")
    return cold.join(renamed.filter(~hot), equal).unionByName(rows.join(few, equal)).drop(*names)
