"""Small-sample statistics and decision rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Two-sided 95% points of Student's t by degrees of freedom, from any table.
T95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262}


def t_point(df: Column) -> Column:
    """The 95% point: from the table up to 9 degrees of freedom, beyond by the Cornish-Fisher expansion about the
    normal point (within 2e-4 of the true value)."""
    z = 1.959963984540054
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    table = F.create_map(*[F.lit(x) for pair in T95.items() for x in pair])
    far = sum((c / F.pow(df, F.lit(i + 1)) for i, c in enumerate(terms)), F.lit(z))
    return F.when(df <= 9, F.try_element_at(table, df.cast("int"))).otherwise(far)


def t_half_width(values: Column) -> Column:
    """Aggregate: half the width of the 95% interval of the mean; null with fewer than 2 values."""
    n = F.count(values)
    return F.when(n > 1, t_point(F.greatest(n - 1, F.lit(1))) * F.stddev_samp(values) / F.sqrt(n))


def wilson(ok: Column, n: Column, z: float = 1.96) -> Column:
    """{low, high} of the score interval; null for n = 0."""
    p = F.try_divide(ok, n)
    mid, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    whole = 1 + z * z / n
    return F.when(n > 0, F.struct(((mid - half) / whole).alias("low"), ((mid + half) / whole).alias("high")))


def sign_test(gained: Column, lost: Column) -> Column:
    """Exact two-sided p-value; 1 if nothing changed. Logarithms keep the binomial terms in range."""
    counts = F.struct((gained + lost).cast("long").alias("n"), F.least(gained, lost).cast("long").alias("k"))

    def summed(x: Column) -> Column:
        n = x["n"]
        first = -n * F.log(F.lit(2.0))
        start = F.struct(first.alias("term"), F.exp(first).alias("total"))

        def step(acc: Column, i: Column) -> Column:
            term = acc["term"] + F.log((n - i + 1) / i)
            return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

        steps = F.filter(F.sequence(F.lit(0).cast("long"), x["k"]), lambda i: i > 0)
        return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda a: a["total"])))

    return let(counts, summed)


def band_verdict(value: Column, references: dict[str, float], band: float = 2.0) -> Column:
    """The name of the first reference within `band` of value, else between."""
    out = F.lit("between")
    for name, ref in reversed(list(references.items())):
        out = F.when(F.abs(value - ref) <= band, name).otherwise(out)
    return out


def share_of_span(value: Column, low: Column, high: Column) -> Column:
    """Where value lies between low (0) and high (1)."""
    return F.try_divide(value - low, high - low)


def relative_drop(before: Column, after: Column) -> Column:
    return 1 - F.try_divide(after, before)


def reproduced(rerun: Column, recorded: Column, tolerance: float) -> Column:
    return F.abs(rerun - recorded) <= tolerance


def share_class(share: Column, many: float = 0.20, few: float = 0.05) -> Column:
    return F.when(share >= many, "many").when(share < few, "few").otherwise("some")


def floor_rule(mean: Column, half: Column, undefended: Column, untrained: Column) -> Column:
    """Whether a mean difference lies above a quarter of the span and its interval does not reach 0; null without one."""
    return (mean > 0.25 * (undefended - untrained)) & ((mean - half > 0) | (mean + half < 0))


def protection(undefended: Column, attacked: Column, reference: Column) -> Column:
    """(U - max(A, R)) / (U - R), where U is above R; else null."""
    return F.when(undefended > reference, (undefended - F.greatest(attacked, reference)) / (undefended - reference))


def kendall_terms(a: Column, b: Column, c: Column, d: Column) -> Column:
    """1 if two pairs of values are ordered alike, -1 if not, 0 for ties."""
    return F.signum(a - b) * F.signum(c - d)
