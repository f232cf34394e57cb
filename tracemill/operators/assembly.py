"""Data sets put together from attempts, tries and rewrites, and the tables that judge them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.functions import stats

from .common import asserted
from .evals import first_by
from .joins import first_match


def accepted(attempts: DataFrame, keys: list[str], order: str, text: str, reason: str, fallback: str) -> DataFrame:
    """Of each key the text of the first attempt without a reason against it, else `fallback`; which it is, and the last
    reason. No key is dropped."""
    ok = F.col(reason).isNull()
    return attempts.groupBy(*keys).agg(
        F.coalesce(F.min_by(F.when(ok, F.col(text)), F.when(ok, F.col(order))), F.first(fallback)).alias(text),
        (F.count_if(ok) == 0).alias("fell_back"),
        F.max_by(reason, order).alias("last_reason"),
        F.count(F.lit(1)).alias("attempts"),
    )


def final_verdicts(attempts: DataFrame, key: str, order: str, most: int, budget: int) -> DataFrame:
    """(key, verdict, attempts): how each item's attempts end.

    attempts: text (null: no answer), gold and agrees (null: no gold, so `judged` counts; null judged: no verdict),
    too_long. An attempt fails if it is not good; items stop at the first good or unvalidated one or after `most`; the
    retries of all items together, in order of attempt and key, are at most `budget`. The last attempt names the
    verdict.
    """
    from .common import ranked

    good = F.when(F.col("agrees").isNotNull(), F.col("agrees")).otherwise(F.coalesce(F.col("judged"), F.lit(False)))
    waits = F.col("text").isNotNull() & F.col("agrees").isNull() & F.col("judged").isNull()
    stops = good | waits | F.col("too_long")
    rows = attempts.withColumn("__end", stops)
    ends = rows.groupBy(F.col(key).alias("__k")).agg(F.min(F.when(F.col("__end"), F.col(order))).alias("__stop"))
    rows = rows.join(ends, F.col(key) == F.col("__k")).filter((F.col(order) <= F.coalesce("__stop", F.col(order))) & (F.col(order) < most))
    retries = ranked(rows.filter(F.col(order) > 0), [F.col(order), F.col(key)], "__spent").filter(F.col("__spent") < budget).drop("__spent")
    tried = rows.filter(F.col(order) == 0).unionByName(retries)
    verdict = (
        F.when(F.col("too_long"), "prompt_too_long")
        .when(F.col("text").isNull(), "no_answer")
        .when(waits, "unvalidated")
        .when(good, "good")
        .when(F.col("agrees").isNotNull(), "wrong_answer")
        .otherwise("exhausted")
    )
    return tried.groupBy(key).agg(F.max_by(verdict, order).alias("verdict"), F.count(F.lit(1)).alias("attempts"))


def training_rows(pool: DataFrame, first: DataFrame, hints: DataFrame, key: str, target: str) -> DataFrame:
    """pool with the text of the first try whose labels are the target, from the first round, else from the hint round;
    `round` says from which, or unsolved, or unreadable where there is no target."""
    took = lambda d, name: d.select(F.col(key).alias(f"__{name}"), F.col("tries").alias(f"__t{name}"))
    out = pool.join(took(first, "f"), F.col(key) == F.col("__f"), "left").join(took(hints, "h"), F.col(key) == F.col("__h"), "left")
    fits = lambda t: t["labels"] == F.col(target)
    one, two = first_match(F.col("__tf"), fits), first_match(F.col("__th"), fits)
    source = F.when(F.col(target).isNull(), "unreadable").when(one.isNotNull(), "first").when(two.isNotNull(), "hint").otherwise("unsolved")
    return out.select(*pool.columns, source.alias("round"), F.coalesce(one["text"], two["text"]).alias("text"))


def corrupted(pool: DataFrame, key: str, labels: str, percent: int, seed: int) -> DataFrame:
    """pool with `released`: the labels, or for the first percent of one random order of the keys that have labels
    another vector of the same length; a vector is drawn once for each key, so levels agree."""
    from .ordered import nested_levels

    with_labels = nested_levels(pool.filter(F.col(labels).isNotNull()).select(F.col(key).alias("__k")), "__k", [percent], seed)
    marked = with_labels.select("__k", F.col(f"in_{percent}").alias("corrupted"))
    n = F.size(labels)
    # the truth as a number, moved by 1 .. 2^n - 1, is any other vector, all equally likely
    number = F.aggregate(F.col(labels), F.lit(0).cast("long"), lambda acc, x: 2 * acc + x.cast("long"))
    size = F.pow(F.lit(2), n).cast("long")
    moved = (number + 1 + F.pmod(F.xxhash64(F.lit(seed), key), size - 1)) % size
    bits = F.transform(F.sequence(F.lit(1), n), lambda i: F.floor(moved / F.pow(F.lit(2), n - i)).cast("long") % 2 == 1)
    out = pool.join(marked, F.col(key) == F.col("__k"), "left").drop("__k").withColumn("corrupted", F.coalesce("corrupted", F.lit(False)))
    return out.withColumn("released", F.when(F.col("corrupted"), bits).otherwise(F.col(labels)))


def wrong_or_missing(pool: DataFrame, released: str, truth: str) -> DataFrame:
    """One row: how many released answers are wrong, how many are missing, and their share of all."""
    wrong = F.count_if(F.col(released).isNotNull() & (F.col(released) != F.col(truth)))
    missing = F.count_if(F.col(released).isNull())
    return pool.agg(wrong.alias("wrong"), missing.alias("missing"), F.try_divide(wrong + missing, F.count(F.lit(1))).alias("share"))


def defended(rows: DataFrame, pool: DataFrame, key: str, text: str, reasoning: Column) -> DataFrame:
    """The target of every row of the pool; fails if one has no row."""
    from tracemill.functions.text import as_target

    both = pool.select(F.col(key).alias("__k")).join(rows, F.col(key) == F.col("__k"), "left")
    return asserted(both, F.col(key).isNotNull(), "a row of the pool is missing").drop("__k").withColumn(text, as_target(F.col(text), reasoning))


def collected(results: DataFrame, by: list[str], ok: str, key: str) -> DataFrame:
    """One line for each combination of path columns: problems, tries, accuracy, pass, average of problems' means."""
    per = results.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(ok)).alias("ok"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("problems"), F.sum("n").alias("tries"), (100 * F.sum("ok") / F.sum("n")).alias("accuracy"),
        (100 * F.avg((F.col("ok") > 0).cast("double"))).alias("passed"), (100 * F.avg(F.col("ok") / F.col("n"))).alias("avg_at_n"),
    )


def compared(results: DataFrame, by: str, baseline: str, key: str, ok: str) -> DataFrame:
    """Each student against the baseline on the same problems: gained, lost and the exact sign test."""
    own = results.select(by, key, F.col(ok).alias("__ok"))
    base = own.filter(F.col(by) == baseline).select(F.col(key).alias("__key"), F.col("__ok").alias("__base"))
    both = own.filter(F.col(by) != baseline).join(base, F.col(key) == F.col("__key"))
    out = both.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("__ok") & ~F.col("__base")).alias("gained"), F.count_if(~F.col("__ok") & F.col("__base")).alias("lost")
    )
    return out.withColumn("p", stats.sign_test(F.col("gained"), F.col("lost")))


def gates(measures: DataFrame, rules: dict[str, tuple[str, float, bool]]) -> DataFrame:
    """(gate, value, ok) from one row of measures; rules: gate -> (column, bound, whether at least)."""
    rows = [
        F.struct(F.lit(g).alias("gate"), F.col(c).cast("double").alias("value"), F.coalesce(F.col(c) >= b if least else F.col(c) <= b, F.lit(False)).alias("ok"))
        for g, (c, b, least) in rules.items()
    ]
    return measures.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def waived(checks: DataFrame, waivers: DataFrame) -> DataFrame:
    """checks with mark: PASS, WAIVED where a waiver (gate, cause) names just this gate, else FAIL; values stay."""
    out = checks.join(waivers.select(F.col("gate").alias("__g"), "cause"), F.col("gate") == F.col("__g"), "left").drop("__g")
    return out.withColumn("mark", F.when(F.col("ok"), "PASS").when(F.col("cause").isNotNull(), "WAIVED").otherwise("FAIL"))


def agrees_with_record(values: DataFrame, recorded: DataFrame, key: str, value: str, off: float = 0.05) -> DataFrame:
    """(key, value, recorded, warn): warn where a recorded value differs from the recomputed one by more than `off`."""
    other = recorded.select(F.col(key).alias("__k"), F.col(value).alias("recorded"))
    both = values.join(other, F.col(key) == F.col("__k"), "left").drop("__k")
    return both.withColumn("warn", F.coalesce(F.abs(F.col(value) - F.col("recorded")) > off, F.lit(True)))


def poisson_weights(draws: int, *of: int) -> np.ndarray:
    """A Poisson weight of mean 1 for each draw, from a counter-based generator of these numbers alone."""
    h = hashlib.blake2b(repr(of).encode(), digest_size=16).digest()
    return np.random.Generator(np.random.Philox(key=np.frombuffer(h, np.uint64))).poisson(1.0, draws)


def bootstrap(rows: DataFrame, strata: str, key: str, value: str, draws: int, seed: int, held: int = 64) -> DataFrame:
    """(draw, mean): means over resampled strata of resampled rows, by Poisson weights from seeded hashes.

    Each row and each stratum has its weight in every draw, whatever task reads it. A task keeps two vectors of draws for
    each stratum it meets, the weights' sum and that of weighted values, and hands on what it has whenever there are over
    `held` strata; so memory is held * draws numbers, and no row is copied. strata and key are hashed (xxhash64). Rows
    with null values are left out. A draw in which no stratum has weight has a null mean.
    """
    kind = "stratum long, draw int, w double, wv double"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def shown() -> Iterator[pa.RecordBatch]:
            for s, (w, wv) in kept.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(draws, s, np.int64)), pa.array(np.arange(draws, dtype=np.int32)), pa.array(w), pa.array(wv)], ["stratum", "draw", "w", "wv"])
            kept.clear()

        for batch in batches:
            for s, k, v in zip(*(c.to_pylist() for c in batch.columns)):
                if s not in kept and len(kept) >= held:
                    yield from shown()
                both = kept.setdefault(s, np.zeros((2, draws)))
                w = poisson_weights(draws, seed, s, k)
                both[0] += w
                both[1] += w * v
        yield from shown()

    hashed = rows.filter(F.col(value).isNotNull()).select(F.xxhash64(strata).alias("s"), F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v"))
    inner = hashed.mapInArrow(sums, kind).groupBy("stratum", "draw").agg(F.sum("w").alias("w"), F.sum("wv").alias("wv"))
    means = inner.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("draw", F.try_divide("wv", "w").alias("m")))).alias("m"))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def outer(strata_: pd.Series) -> pd.Series:
        return strata_.map(lambda s: poisson_weights(draws, seed, s))

    weighted = means.select(F.explode(F.arrays_zip("m", outer("stratum").alias("w"))).alias("x")).select("x.m.draw", "x.m.m", "x.w")
    some = F.when(F.col("m").isNotNull(), F.col("w")).otherwise(0)
    return weighted.groupBy("draw").agg(F.try_divide(F.sum(some * F.coalesce("m", F.lit(0.0))), F.sum(some)).alias("mean"))


def top_by_product(rows: DataFrame, factors: list[str], n: int, key: str) -> DataFrame:
    """The n rows of the largest product of factors within [0, 1]; ties by key."""
    score = F.lit(1.0)
    for f in factors:
        score = score * F.least(F.greatest(F.col(f), F.lit(0.0)), F.lit(1.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), key).limit(n)


def first_usable(rows: DataFrame, gain: str, size: str, least: float = 5.0) -> DataFrame:
    """Of the rows that gain at least `least`, the largest size."""
    return first_by(rows.filter(F.col(gain) >= least).withColumn("__all", F.lit(1)), ["__all"], [F.col(size).desc()]).drop("__all")
