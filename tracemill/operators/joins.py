"""Joins that check what they join, fall back, fan out or take the first match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import asserted
from .evals import first_by


def positional(a: DataFrame, b: DataFrame, key: str, equal: str) -> DataFrame:
    """Rows of a and b of the same place, b's columns ending in _b; fails if a place is in one alone or `equal` differs."""
    other = b.select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    both = a.join(other, F.col(key) == F.col(f"{key}_b"), "full_outer")
    return asserted(both, F.col(key).isNotNull() & F.col(f"{key}_b").isNotNull() & F.col(equal).eqNullSafe(F.col(f"{equal}_b")), f"{equal} differs or is missing")


def fallback_key(key: Column, text: Column, length: int = 80) -> Column:
    """The key, or the beginning of the text where there is none."""
    return F.coalesce(key.cast("string"), F.left(text, F.lit(length)))


def keyed(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Inner join by key, of several rows of one side the last by order; b's columns end in _b."""
    last = lambda d: first_by(d, [key], [F.col(order).desc()])
    other = last(b).select(*[F.col(c).alias(f"{c}_b") for c in b.columns])
    return last(a).join(other, F.col(key) == F.col(f"{key}_b")).drop(f"{key}_b")


def lookup(rows: DataFrame, table: DataFrame, key: str, prompt: str) -> DataFrame:
    """rows with table's columns, suffixed _b; fails if a row finds none or its prompt is another but for white space around."""
    other = table.select(*[F.col(c).alias(f"{c}_b") for c in table.columns])
    both = rows.join(other, F.col(key) == F.col(f"{key}_b"), "left")
    return asserted(both, F.trim(prompt) == F.trim(f"{prompt}_b"), f"no row, or another {prompt}").drop(f"{key}_b")


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """The keys that every frame has; counted together, so one shuffle serves any number of frames."""
    tagged = [d.select(key).distinct() for d in frames]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == len(frames)).select(key)


def uncovered(frames: list[DataFrame], key: str) -> DataFrame:
    """(key, present): the keys that some frame lacks, and how many have them; empty if all hold the same keys."""
    tagged = [d.select(key).distinct() for d in frames]
    return reduce(DataFrame.unionByName, tagged).groupBy(key).agg(F.count(F.lit(1)).alias("present")).filter(F.col("present") < len(frames))


def missing_places(rows: DataFrame, place: str, count: int) -> DataFrame:
    """The places 0 .. count - 1 that no row has."""
    every = rows.sparkSession.range(count).withColumnRenamed("id", place)
    return every.join(rows.select(place).distinct(), place, "left_anti")


def first_match(tries: Column, fits) -> Column:
    """The first element for which fits(element) holds, null if none does."""
    return F.get(F.filter(tries, fits), F.lit(0))


def conditional_source(rows: DataFrame, marked: DataFrame, yes: DataFrame, no: DataFrame, key: str, value: str) -> DataFrame:
    """rows with `value` from yes where the key is marked, else from no, and whether it is marked. Keys are distinct."""
    side = lambda d, name: d.select(F.col(key).alias(f"__{name}"), F.col(value).alias(f"__v{name}"))
    out = rows.join(marked.select(F.col(key).alias("__m")).distinct(), F.col(key) == F.col("__m"), "left")
    out = out.join(side(yes, "y"), F.col(key) == F.col("__y"), "left").join(side(no, "n"), F.col(key) == F.col("__n"), "left")
    took = F.when(F.col("__m").isNotNull(), F.col("__vy")).otherwise(F.col("__vn"))
    return out.select(*rows.columns, F.col("__m").isNotNull().alias("marked"), took.alias(value))


def fan_out(rows: DataFrame, problem: list[str], order: str, answered) -> DataFrame:
    """Answers each distinct problem once, by `answered` on its first row, and gives every row its problem's answer.

    answered: DataFrame of (problem..., order) -> DataFrame of (problem..., answer).
    """
    once = first_by(rows.select(*problem, order), problem, [F.col(order)])
    answers = answered(once)
    on = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in problem])
    return rows.join(answers.select(*[F.col(p).alias(f"__{p}") for p in problem], "answer"), on).drop(*[f"__{p}" for p in problem])


def paired_gap(scores: DataFrame, by: list[str], arm: str, value: str, high: str, low: str) -> DataFrame:
    """(by..., gap): value of the arm high less that of low, where both are there; one pass, no self-join."""
    of = lambda a: F.max(F.when(F.col(arm) == a, F.col(value)))
    return scores.groupBy(*by).agg((of(high) - of(low)).alias("gap")).filter(F.col("gap").isNotNull())


def staged_pending(all_keys: DataFrame, stages: list[DataFrame], key: str) -> list[DataFrame]:
    """For each stage the keys that no stage before it has solved."""
    out, left = [], all_keys.select(key)
    for s in stages:
        out.append(left)
        left = left.join(s.select(key), key, "left_anti")
    return [*out, left]


def top_window(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; the limit works before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
