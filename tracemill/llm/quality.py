"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects documents whose value lies above a cutoff. The cutoffs that may be chosen are fixed beforehand; for
each stratum, rule and cutoff the labelled documents tell how many good ones it would reject. As rejections only grow
when a cutoff falls, the cutoffs of a rule are tested in that order: one is admitted if the exact (Clopper-Pearson) upper
bound on the share of good documents rejected is within the risk allowed, and the first that is not ends the sequence, so
the level need be divided by the rules and strata alone, not by the cutoffs. Of those admitted, the one that parts bad
from good best is used. Where none is, the rule is off. Strata with too few labels for any cutoff are judged as one, by
the cutoffs admitted on the labels of all of them together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GAP, WORD, documents, settle, shield, text_or_empty, unused
from .spans import let

#: Rule: (numerator, denominator, cutoffs).
RULES: dict[str, tuple[str, str, list[float]]] = {
    "symbols": ("n_symbols", "n_words", [0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.6, 0.8, 1.0, 1.5, 2.0]),
    "duplicate_lines": ("n_dup_lines", "n_lines", [0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]),
    "repeats": ("n_repeat_words", "n_words", [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45]),
    "capitals": ("n_capitals", "word_chars", [0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7]),
    "word_length": ("word_chars", "n_words", [6.0, 7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0]),
}


def _repeat_words(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more, in an array of words, which is worked out once: inside the
    lambdas below it would be worked out for each window."""
    return let(words, _covered)


def _covered(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more.

    Windows that differ have mostly different hashes; only if two hashes agree are the windows themselves sorted.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(places: Column) -> Column:
        steps = F.zip_with(
            places, F.slice(places, 2, F.size(places)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))
        )
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def twice(windows: Column) -> Column:
        pairs = F.zip_with(
            windows,
            F.slice(windows, 2, F.size(windows)),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return let(F.sort_array(F.array_distinct(F.flatten(pairs))), covered)

    windows = F.sort_array(
        F.transform(
            at,
            lambda i: F.struct(
                F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")
            ),
        )
    )
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 3, 0).when(some, let(windows, twice)).otherwise(0)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and the counts that the rules go by, as longs; columns of keep named like a count are replaced."""
    keep = [c for c in keep if c not in COUNTS]
    whole = unused(docs, "whole")
    rows, restore = shield(docs.select(*keep, text_or_empty().alias(whole)))
    *keep, whole = rows.columns
    text = F.col(whole)
    out = rows.withColumn("__words", F.array_remove(F.split(text, GAP), ""))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    counts = [
        F.size("__words"),
        F.length(F.regexp_replace(text, GAP, "")),
        F.regexp_count(text, F.lit("[#*$%&|<>]")),
        F.size("__lines") - F.size(F.array_distinct("__lines")),
        _repeat_words(F.col("__words")),
        F.size("__lines"),
        F.regexp_count(text, F.lit(r"\p{Lu}")),
    ]
    return restore(out.select(*keep, *[c.cast("long").alias(n) for c, n in zip(counts, COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p): the regularised incomplete beta function I(1 - p; n - k, k + 1)."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1, 1 - p
    if x < (a + 1) / (a + b + 2):
        return _beta_part(a, b, x)
    return 1 - _beta_part(b, a, p)


def _beta_part(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction."""
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * h


def _value(rule: str) -> Column:
    top, below, _ = RULES[rule]
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


#: The name under which the strata that have too few labels of their own are judged together.
REST = "\x00rest"


def fit(
    featured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.005, error: float = 0.05
) -> dict[str, dict[str, float]]:
    """The admitted cutoff of each rule, by stratum, and under REST for the strata of too few labels, null among them.

    risk bounds each rule's false rejections; those of all rules together are bounded by risk times their number.

    labels: doc_id, quality (1 good, 0 bad; of several rows for a document the least; null: not labelled). Only strata
    with as many good documents as a bound within the risk needs at the least come to the driver, at most 1 row for
    each rule and cutoff: never more than labels / needed strata.
    """
    rules = list(RULES)
    marks = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    marked = featured.filter(~base_failed()).join(
        marks.withColumnRenamed("doc_id", "__id"), F.col("doc_id") == F.col("__id")
    )
    steps = [
        F.struct(
            F.lit(i).alias("rule"),
            sum((F.when(_value(r) > c, 1).otherwise(0) for c in RULES[r][2]), F.lit(0)).alias("over"),
        )
        for i, r in enumerate(rules)
    ]
    counts = (
        marked.select(F.col(stratum).cast("string").alias("stratum"), "__quality", F.explode(F.array(*steps)).alias("s"))
        .groupBy("stratum", "s.rule", "s.over")
        .agg(F.count_if(F.col("__quality") == 1).alias("good"), F.count_if(F.col("__quality") != 1).alias("bad"))
    )
    counts = settle(counts)
    strata = counts.filter((F.col("rule") == 0) & F.col("stratum").isNotNull()).groupBy("stratum").agg(F.sum("good").alias("__good"))
    needed = math.log(len(rules) / error) / -math.log1p(-risk)
    enough = strata.filter(F.col("__good") >= needed).select(F.col("stratum").alias("__s"))
    named = counts.join(enough, F.col("stratum") == F.col("__s"), "left").withColumn("name", F.coalesce("__s", F.lit(REST)))
    rows = named.groupBy("name", "rule", "over").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    return admitted([tuple(r) for r in rows], risk, error)


def admitted(counts: list[tuple[str, int, int, int, int]], risk: float, error: float) -> dict[str, dict[str, float]]:
    """The cutoffs that fit() gives, from (stratum, rule, cutoffs exceeded, good documents, bad ones)."""
    rules = list(RULES)
    by: dict[tuple[str, int], list] = {}
    for name, rule, over, good, bad in counts:
        by.setdefault((name, rule), []).append((over, good, bad))
    level = error / max(1, len(rules) * len({s for s, _ in by}))
    out: dict[str, dict[str, float]] = {name: {} for name, _ in by}
    for (name, i), cells in sorted(by.items()):
        n_good, n_bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
        best = 0.0
        for j, cutoff in reversed(list(enumerate(RULES[rules[i]][2]))):
            lost = sum(c[1] for c in cells if c[0] > j)
            hit = sum(c[2] for c in cells if c[0] > j)
            if not n_good or binomial_tail(lost, n_good, risk) > level:
                break
            gain = hit / max(1, n_bad) - 10 * lost / n_good
            if gain > best:
                best = gain
                out[name][rules[i]] = cutoff
    return out


def verdict(cutoffs: dict[str, dict[str, float]], stratum: str = "lang") -> Column:
    """True unless a rule that is on in the document's stratum rejects it."""
    passed = F.lit(True)
    named = [s for s in cutoffs if s != REST]
    own = F.coalesce(F.col(stratum).cast("string").isin(named), F.lit(False)) if named else F.lit(False)
    for rule in RULES:
        known = {s: c[rule] for s, c in cutoffs.items() if rule in c}
        if known:
            table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
            cutoff = F.try_element_at(table, F.when(own, F.col(stratum).cast("string")).otherwise(F.lit(REST)))
            passed = passed & ~F.coalesce(_value(rule) > cutoff, F.lit(False))
    return passed


def judge(featured: DataFrame, cutoffs: dict[str, dict[str, float]], stratum: str = "lang") -> DataFrame:
    """Adds base_failed and kept.

    Null or empty text: no words, base_failed. A stratum that is null or has too few labels: judged with the others of
    this sort. Values equal to a cutoff pass. Null doc_id: judged, but never labelled. Repeated rows: each is judged, and
    counted where it is labelled. Very long texts: counted whole. Empty input or no labels: no cutoffs. Other columns
    stay; base_failed and kept are replaced.
    """
    out = featured.withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(cutoffs, stratum))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `judge` defines it; nulls, ties, long texts and empty tables likewise."""
    featured = settle(features(documents(spark, sf_dir), ["doc_id", "lang"]))
    out = judge(featured, fit(featured, labels_of(spark, sf_dir)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
