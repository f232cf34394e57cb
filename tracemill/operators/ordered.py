"""Ordered operators: priorities, prefixes of one order, pilots, running limits, distributions, representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import accumulated, ranked
from .evals import first_by

#: Ranks of verdicts; any other is 9.
VERDICTS = {"good": 0, "exhausted": 1, "prompt_too_long": 2, "unvalidated": 3}


def verdict_rank(verdict: Column, ranks: dict[str, int] = VERDICTS, other: int = 9) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])
    return F.coalesce(F.try_element_at(table, verdict), F.lit(other))


def priority_dedupe(rows: DataFrame, key: str, verdict: str, retries: str, chars: str, shard: str) -> DataFrame:
    """Of each key the row of the best verdict, then fewest retries, then most characters, then the first shard."""
    return first_by(rows, [key], [verdict_rank(F.col(verdict)), F.col(retries), F.col(chars).desc(), F.col(shard)])


def strongest_admissible(settings: DataFrame, setting: str, correct: str, baseline: Column, slack: float = 5.0) -> DataFrame:
    """One row: the largest setting whose correct is at least baseline - slack, else the smallest setting."""
    ok = F.when(F.col(correct) >= baseline - slack, F.col(setting))
    return settings.agg(F.coalesce(F.max(ok), F.min(setting)).alias(setting), F.count(ok).alias("admissible"))


def pilot(rows: DataFrame, key: str, length: str, n: int, seed: int = 0) -> DataFrame:
    """n rows: half evenly spaced by rank of length (places int((q + 0.5) * N / k)), the rest by a seeded hash of the key.

    tagged by `part`. Ties of length are by key.
    """
    total, k = rows.count(), n // 2
    by_length = ranked(rows, [F.col(length), F.col(key)], "__rank")
    places = [int((q + 0.5) * total / k) for q in range(k)] if k and total else []
    even = by_length.filter(F.col("__rank").isin(places)) if places else by_length.limit(0)
    rest = by_length.filter(~F.col("__rank").isin(places)) if places else by_length
    drawn = rest.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n - len(set(places)))
    return even.withColumn("part", F.lit("even")).unionByName(drawn.withColumn("part", F.lit("random"))).drop("__rank")


def shuffled(rows: DataFrame, key: str, seed: int) -> list[Column]:
    """The columns of a seeded random order of the keys: a permutation that does not depend on how rows are stored."""
    return [F.xxhash64(F.lit(seed), key), F.col(key)]


def nested_levels(rows: DataFrame, key: str, percents: list[int], seed: int) -> DataFrame:
    """Adds in_<p> for each percentage: whether the row is among the first round(p% of all) of one random order, so that
    smaller levels lie within larger ones."""
    n = rows.count()
    out = ranked(rows, shuffled(rows, key, seed), "__rank")
    return out.withColumns({f"in_{p}": F.col("__rank") < round(p / 100 * n) for p in percents}).drop("__rank")


def until_kept(rows: DataFrame, order: list[Column], keep: Column, n: int) -> DataFrame:
    """Rows in order up to and with the n-th that is kept; adds kept_so_far."""
    out = accumulated(rows, order, keep.cast("int"), "kept_so_far")
    return out.filter((F.col("kept_so_far") < n) | (keep & (F.col("kept_so_far") == n)))


def distribution(rows: DataFrame, value: str) -> DataFrame:
    """(value, share): the share of rows at or below each distinct value. Values are counted before they are sorted."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    out = accumulated(counts, [F.col(value)], F.col("__c"), "__below")
    total = counts.agg(F.sum("__c").alias("__n"))  # one row
    return out.join(F.broadcast(total), F.lit(True)).select(value, (F.col("__below") / F.col("__n")).alias("share"))


def quantile_rows(rows: DataFrame, key: str, value: str, places: dict[str, Column]) -> DataFrame:
    """For each key the value at each place (from 0; an expression of n, the number of non-null values).

    Values are counted, range-sorted and added up over all keys at once, so that one key with a third of all rows is
    spread over as many tasks as others.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__c"))
    ends = accumulated(counts, [F.col(key).asc_nulls_first(), F.col(value)], F.col("__c"), "__end")
    sizes = counts.groupBy(key).agg(F.sum("__c").alias("n"))
    starts = accumulated(sizes, [F.col(key).asc_nulls_first()], F.col("n"), "__last").select(F.col(key).alias("__k"), "n", (F.col("__last") - F.col("n")).alias("__first"))
    out = ends.join(starts, F.col(key).eqNullSafe(F.col("__k")))
    end = F.col("__end") - F.col("__first")
    inside = lambda at: (end > at) & (end - F.col("__c") <= at)
    return out.groupBy(key).agg(*[F.max(F.when(inside(at), F.col(value))).alias(to) for to, at in places.items()])


def percentiles(rows: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles with linear interpolation between the two values about them."""
    places = {}
    for to, p in shares.items():
        at = F.lit(p) * (F.col("n") - 1)
        places |= {f"__lo_{to}": F.floor(at), f"__hi_{to}": F.ceil(at), f"__at_{to}": F.floor(at)}
    low_high = {k: v for k, v in places.items() if not k.startswith("__at")}
    found = quantile_rows(rows, key, value, low_high)
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(F.col(key).alias("__k2")).agg(F.count(F.lit(1)).alias("n"))
    both = found.join(sizes, F.col(key).eqNullSafe(F.col("__k2")))
    part = lambda p: F.lit(p) * (F.col("n") - 1) - F.floor(F.lit(p) * (F.col("n") - 1))
    return both.select(key, *[(F.col(f"__lo_{to}") + part(p) * (F.col(f"__hi_{to}") - F.col(f"__lo_{to}"))).alias(to) for to, p in shares.items()])


def representatives(rows: DataFrame, key: str, length: str, cases: dict[str, Column]) -> DataFrame:
    """(case, key): for each case in turn the shortest row that satisfies it and that no case before it has taken.

    Only as many of the shortest rows of a case as there are cases can matter, so only those meet.
    """
    n, order = len(cases), [F.col(length), F.col(key)]
    parts = []
    for i, (name, test) in enumerate(cases.items()):
        parts.append(rows.filter(test).orderBy(*order).limit(n).select(F.lit(i).alias("__i"), F.lit(name).alias("case"), key, length))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    taken, out = set(), []
    for r in sorted(found.collect(), key=lambda r: (r["__i"], r[length], r[key])):  # cases squared rows at most
        if r[key] not in taken and r["case"] not in {c for c, _ in out}:
            taken.add(r[key])
            out.append((r["case"], r[key]))
    kind = rows.schema[key].dataType.simpleString()
    return rows.sparkSession.createDataFrame(out, f"case string, {key} {kind}")


def kept_steps(rows: DataFrame, run: str, step: str, every: int) -> DataFrame:
    """Steps divisible by `every`, and the newest of each run."""
    newest = rows.groupBy(F.col(run).alias("__run")).agg(F.max(step).alias("__newest"))
    return rows.join(newest, F.col(run) == F.col("__run")).filter((F.col(step) % every == 0) | (F.col(step) == F.col("__newest"))).drop("__run", "__newest")


def numeric_suffix(key: Column) -> Column:
    """The number behind the last underscore."""
    return F.element_at(F.split(key, "_"), -1).try_cast("long")


def mixed_order(key: Column) -> list[Column]:
    """Numbers before texts, each in their own order."""
    number = key.try_cast("double")
    return [number.isNull(), number, key]


def half(rank: Column, n: Column) -> Column:
    """1 for the first ceil(n / 2) places, 2 for the rest."""
    return F.when(rank < F.ceil(n / 2), 1).otherwise(2)



def rise(values: Column) -> Column:
    """Length of the longest strictly rising subsequence of an array: the least ends of rises of each length, one by one."""

    def put(ends: Column, v: Column) -> Column:
        at = F.size(F.filter(ends, lambda e: e < v))
        return F.concat(F.slice(ends, F.lit(1), at), F.array(v), F.slice(ends, at + 2, F.greatest(F.size(ends) - at - 1, F.lit(0))))

    return F.size(F.aggregate(values, F.slice(values, 1, 0), put))
