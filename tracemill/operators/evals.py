"""Aggregations, ordered operators and joins over tables of tries and rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, key: str, order: str, to: str = "pos") -> DataFrame:
    """The place of each row within its key, from 0."""
    return df.withColumn(to, F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def first_tries(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key, with pos. The limit on row_number is applied before the shuffle as well."""
    return numbered(df, key, order).filter(F.col("pos") < k)


def majority(df: DataFrame, key: str, answer: str, order: str) -> DataFrame:
    """(key, answer, votes): the most frequent answer, of equals the first seen; nulls do not vote."""
    votes = df.filter(F.col(answer).isNotNull()).groupBy(key, answer).agg(
        F.count(F.lit(1)).alias("votes"), F.min(order).alias("__first")
    )
    best = F.max_by(F.struct(answer, "votes"), F.struct(F.col("votes"), -F.col("__first")))
    return votes.groupBy(key).agg(best.alias("b")).select(key, f"b.{answer}", "b.votes")


def order_statistics(df: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """For each key the value at each place (from 0; an expression of n, the number of non-null values).

    Rows are counted by value first, so a group with a third of all rows costs its distinct values alone.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("__end", F.sum("__c").over(w.orderBy(value))).withColumn("n", F.sum("__c").over(w))
    inside = lambda at: (F.col("__end") > at) & (F.col("__end") - F.col("__c") <= at)
    return ranked.groupBy(key).agg(*[F.max(F.when(inside(at), F.col(value))).alias(to) for to, at in places.items()])


def upper_median() -> Column:
    return F.floor(F.col("n") / 2)


def floor_quantile(p: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.lit(p) * F.col("n")))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, count, density) of all bins; the last is closed on the right. Values outside are in the density's total."""
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    seen = df.filter(F.col(value).isNotNull()).groupBy(
        F.when(F.col(value).between(low, high), at).alias("__bin")
    ).agg(F.count(F.lit(1)).alias("__n"))
    total = seen.agg(F.sum("__n").alias("__total"))  # one row
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = every.join(seen, F.col("bin") == F.col("__bin"), "left").join(F.broadcast(total), F.lit(True), "left")
    count = F.coalesce("__n", F.lit(0)).cast("long")
    return out.select("bin", count.alias("count"), F.coalesce(count / (F.col("__total") * width), F.lit(0.0)).alias("density"))


def first_by(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__r", rank).filter("__r = 1").drop("__r")


def staged(own: DataFrame, hint: DataFrame, salvage: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, origin): the first of own, hint and salvage that has the key. Keys are distinct in each."""
    tagged = [d.select(key, value, F.lit(t).alias("origin"), F.lit(i).alias("__p")) for i, (t, d) in enumerate([("own", own), ("hint", hint), ("salvage", salvage)])]
    both = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    return both.groupBy(key).agg(F.min_by(F.struct(value, "origin"), "__p").alias("b")).select(key, f"b.{value}", "b.origin")


def screened(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first that holds, or keep."""
    out = F.lit(None).cast("string")
    for name, test in reversed(reasons):
        out = F.when(test, name).otherwise(out)
    return df.withColumn("reason", F.coalesce(out, F.lit("keep")))


def other_labels(n: int) -> Column:
    """All vectors of n booleans, as an array of arrays; for small n."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(2**n - 1)),
        lambda v: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.getbit(v, i) == 1),
    )
