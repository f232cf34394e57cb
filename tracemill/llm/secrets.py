"""Secrets by a battery of randomness tests, in DataFrame operations only.

A candidate is any run of 16 or more characters of keys. Its encoding is inferred from the characters it uses; under
that alphabet, a chi-squared test of uniformity, a runs test about the alphabet's middle and a test of the correlation
of neighbours say how well it agrees with being drawn at random. At these lengths their normal approximations are
coarse, so they only rank: what counts is what ordinary writing reaches under the same alphabet and at the same length.
That null is learnt from decoys, for each candidate the text around it put as an identifier, slug or path of its
encoding, and tested alike. Within a class of encoding and length a candidate's p-value is the share of decoys that look
as random as it does, and the Benjamini-Hochberg rule over all candidates of the corpus bounds the share of false
discoveries.
"""

from __future__ import annotations

import math
from string import ascii_lowercase as LOWER
from string import ascii_uppercase as UPPER
from string import digits as DIGITS

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, unused
from .spans import SPANS, apart, found, let, replaced, text_of

KINDS = ["assign", "access", "hex", "random"]
ASSIGN, ACCESS, HEX, RANDOM = range(4)
_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
STRICT = {
    ASSIGN: _KEYWORD + r"""["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    ACCESS: r"AKIA[A-Z0-9]++",
    HEX: r"(?<![0-9a-f])[0-9a-f]{16,}+",
}
_VALUE = "^" + _KEYWORD + r"""["']?\x20*+[:=]\x20*+["']?"""
_RUN = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+=*+"
#: Encodings by the alphabet; the first whose alphabet holds all characters is inferred.
ENCODINGS = {
    "hex": DIGITS + "abcdef",
    "upper_hex": DIGITS + "ABCDEF",
    "lower": LOWER,
    "base32": UPPER + "234567",
    "upper_digits": DIGITS + UPPER,
    "lower_digits": DIGITS + LOWER,
    "letters_digits": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "url64": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
#: Lengths from which a class of its own begins, and how finely -log10 of the battery's p-value is told apart.
LENGTHS = [16, 20, 24, 32, 40, 56, 80]
#: Characters of the text on either side that decoys may be made of, decoys for a candidate at the most, and how many a
#: null distribution needs.
AROUND, DECOYS, ENOUGH = 600, 12, 100
FINE, DEEP = 5, 60


def _normal_tail(z: Column) -> Column:
    """P(N > z), by a rational approximation of the error function (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    upper = 0.5 * poly * F.exp(-x * x)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(s: Column, alphabet: Column) -> Column:
    """p-value of s being random over the alphabet: three times the least of the three tests' own."""

    def tests(x: Column) -> Column:
        codes, k, n = x["codes"], x["k"], x["n"]
        square = F.aggregate(
            F.sequence(F.lit(1), F.length(alphabet)),
            F.lit(0.0),
            lambda acc, j: acc
            + let(n - F.length(F.replace(s, alphabet.substr(j, F.lit(1)), F.lit(""))), lambda c: c * c),
        )
        pairs = F.zip_with(codes, F.slice(codes, 2, F.size(codes)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        pairs = F.slice(pairs, 1, F.size(codes) - 1)
        high = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + F.when(c >= k / 2, 1.0).otherwise(0.0))
        mean = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + c) / n

        def counted(y: Column) -> Column:
            mean, pairs = y["mean"], y["pairs"]
            runs = 1 + F.aggregate(
                pairs, F.lit(0.0), lambda acc, q: acc + F.when((q["a"] >= k / 2) != (q["b"] >= k / 2), 1.0).otherwise(0.0)
            )
            total = F.aggregate(codes, F.lit(0.0), lambda acc, c: acc + (c - mean) * (c - mean))
            lag = F.aggregate(pairs, F.lit(0.0), lambda acc, q: acc + (q["a"] - mean) * (q["b"] - mean))
            found = F.struct(y["square"].alias("square"), y["high"].alias("high"), runs.alias("runs"), total.alias("total"), lag.alias("lag"))
            return let(found, judged)

        def judged(z: Column) -> Column:
            chi, high = k / n * z["square"] - n, z["high"]
            p_chi = _normal_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))
            mu = 2 * high * (n - high) / n + 1
            spread = (mu - 1) * (mu - 2) / (n - 1)
            p_runs = F.when(spread > 0, 2 * _normal_tail(F.abs(z["runs"] - mu) / F.sqrt(spread))).otherwise(F.lit(0.0))
            off = (z["lag"] / z["total"] + 1 / (n - 1)) * F.sqrt(n)
            p_lag = F.when(z["total"] > 0, 2 * _normal_tail(F.abs(off))).otherwise(F.lit(0.0))
            return F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_lag))

        # worked out once each: what stands inside a lambda would be worked out for each of its elements
        return let(F.struct(square.alias("square"), high.alias("high"), mean.alias("mean"), pairs.alias("pairs")), counted)

    codes = F.transform(F.split(s, ""), lambda c: F.instr(alphabet, c) - 1)
    whole = F.struct(
        codes.alias("codes"), F.length(alphabet).cast("double").alias("k"), F.length(s).cast("double").alias("n")
    )
    return let(whole, tests)


def encoding(s: Column) -> Column:
    """The alphabet inferred."""
    out = F.lit(ENCODINGS["any"])
    for letters in reversed(list(ENCODINGS.values())):
        out = F.when(s.rlike(f"^[{letters.replace('-', '') + '-' * ('-' in letters)}]+$"), F.lit(letters)).otherwise(out)
    return out


def strict_spans(text: Column) -> Column:
    """The base spans by start, then kind; matches that fail their check are dropped."""
    assign = F.filter(
        found(text, STRICT[ASSIGN], ASSIGN, text.rlike(_KEYWORD)),
        lambda s: F.length(F.regexp_replace(s["m"], _VALUE, "")) >= 12,
    )
    access = F.filter(
        found(text, STRICT[ACCESS], ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["m"]) >= 18
    )
    return F.concat(assign, access, found(text, STRICT[HEX], HEX, text.rlike(STRICT[HEX])))


_FOUND = "array<struct<start:int,end:int,class:int,score:int,decoys:array<int>>>"


def _score(s: Column, alphabet: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(battery(s, alphabet), F.lit(1e-13))) * FINE), F.lit(DEEP)).cast("int")


def _prose(around: Column, alphabet: Column) -> Column:
    """The words of a text as an identifier, slug or path in the alphabet: its letters in the alphabet's case, what parts
    words as - or / where the alphabet has it, all else left out."""
    out = F.lit("")
    for letters in reversed(list(ENCODINGS.values())):
        small, large = "z" in letters or "f" in letters, "Z" in letters or "F" in letters
        text = F.initcap(around) if small and large else F.upper(around) if large else F.lower(around)
        if "-" in letters or "/" in letters:
            text = F.regexp_replace(text, r"\s+", "-" if "-" in letters else "/")
        allowed = letters.replace("-", "") + "-" * ("-" in letters)
        out = F.when(alphabet == letters, F.regexp_replace(text, f"[^{allowed}]", "")).otherwise(out)
    return out


def _length_class(n: Column) -> Column:
    return sum((F.when(n >= k, 1).otherwise(0) for k in LENGTHS[1:]), F.lit(0))


def candidates(text: Column, decoys: int = 0) -> Column:
    """Runs that may be keys: their class of encoding and length, and their score and their decoys'; the smaller, the
    more like random characters. Fewer decoys than asked for where the text around is too short."""
    order = list(ENCODINGS.values())
    spans = found(text, _RUN, RANDOM, text.rlike("[A-Za-z0-9+/_-]{16}"), around=AROUND if decoys else 0)

    def described(s: Column) -> Column:
        body = F.regexp_replace(s["m"], "=+$", "")
        n = F.length(body)
        least = F.get(F.array(*map(F.lit, LENGTHS)), _length_class(n))

        def parts(prose: Column, alphabet: Column) -> Column:
            pieces = F.transform(F.sequence(F.lit(0), F.lit(decoys - 1)), lambda i: F.substr(prose, i * n + 1, n))
            return F.transform(F.filter(pieces, lambda d: F.length(d) >= least), lambda d: _score(d, alphabet))

        def tested(alphabet: Column) -> Column:
            made = F.array().cast("array<int>")
            if decoys:
                near = F.regexp_replace(F.concat_ws(" ", s["before"], s["after"]), _RUN, " ")
                made = let(_prose(near, alphabet), lambda prose: parts(prose, alphabet))
            return F.struct(
                s["start"],
                s["end"],
                (F.array_position(F.array(*map(F.lit, order)), alphabet).cast("int") * 10 + _length_class(n)).alias("class"),
                _score(body, alphabet).alias("score"),
                made.alias("decoys"),
            )

        return let(encoding(body), tested)

    return F.transform(spans, described).cast(_FOUND)


def fit(docs: DataFrame, rate: float = 0.05) -> dict[int, int]:
    """For each class of encoding and length the largest score at which a candidate is discovered, at this
    false-discovery rate.

    At most len(ENCODINGS) * len(LENGTHS) * (DEEP + 1) rows reach the driver.
    """
    rows = docs.select(text_or_empty().alias("text")).filter(F.col("text").rlike("[A-Za-z0-9+/_-]{16}"))
    rows = rows.select(F.explode(candidates(F.col("text"), DECOYS)).alias("c"))
    both = F.concat(
        F.array(F.struct(F.lit(0).alias("null"), F.col("c.score").alias("score"))),
        F.transform("c.decoys", lambda d: F.struct(F.lit(1).alias("null"), d.alias("score"))),
    )
    rows = rows.select(F.col("c.class").alias("class"), F.explode(both).alias("x"))
    counts = rows.groupBy("class", "x.score").agg(
        F.count_if(F.col("x.null") == 0).alias("n"), F.count_if(F.col("x.null") == 1).alias("nulls")
    )
    return discovered([tuple(r) for r in counts.collect()], rate)


def discovered(counts: list[tuple[int, int, int, int]], rate: float, enough: int = ENOUGH) -> dict[int, int]:
    """Benjamini-Hochberg over cells (class, score, candidates, decoys).

    A class with fewer than `enough` decoys takes those of its encoding up to its length (shorter ones look more random,
    so this errs on the safe side), then those of its encoding, then all.
    """
    own: dict[int, list] = {}
    for c, score, n, nulls in counts:
        own.setdefault(c, []).append((score, n, nulls))
    cells = []
    for c, mine in sorted(own.items()):
        of = lambda fits: [x for d, other in own.items() if fits(d) for x in other]
        alike = lambda d: d // 10 == c // 10
        pools = [mine, of(lambda d: alike(d) and d <= c), of(alike), of(lambda d: True)]
        pool = next((p for p in pools if sum(x[2] for x in p) >= enough), pools[-1])
        all_null = sum(x[2] for x in pool)
        for score, n in sorted((score, n) for score, n, _ in mine if n):
            null = sum(x[2] for x in pool if x[0] <= score)
            cells.append(((1 + null) / (1 + all_null), c, score, n))
    total, seen, limit = sum(x[3] for x in cells), 0, 0.0
    ordered = sorted(cells)
    for i, (p, _, _, n) in enumerate(ordered):
        seen += n
        if (i + 1 == len(ordered) or ordered[i + 1][0] > p) and p * total <= rate * seen:
            limit = p
    out: dict[int, int] = {}
    for p, c, score, _ in cells:
        if p <= limit:
            out[c] = max(score, out.get(c, -1))
    return out


def all_spans(text: Column, limits: dict[int, int]) -> Column:
    """Base spans and, clear of them, the discoveries."""
    strict = strict_spans(text)
    if not limits:
        return strict
    table = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
    more = lambda: F.transform(
        F.filter(
            candidates(text),
            lambda c: F.coalesce(c["score"] <= F.try_element_at(table, c["class"]), F.lit(False)),
        ),
        lambda c: F.struct(F.lit(RANDOM).alias("kind"), c["start"], c["end"], F.lit("").alias("m")),
    ).cast(SPANS)
    together = let(strict, lambda base: F.concat(base, apart(more(), base)))
    worth = text.rlike("[A-Za-z0-9+/_-]{16}") | text.rlike(_KEYWORD)
    return F.when(worth, together).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, limits: dict[int, int], to: str = "__spans") -> DataFrame:
    """docs with the column `to` (replaced if there is one), the base and the added spans.

    Null text: no spans. Null doc_id and repeated rows: kept, a row each. Empty input: no rows. Texts are read whole, in
    time that grows little faster than their length. Ties do not arise: added spans overlap no others. Other columns
    stay as they are.
    """
    return docs.withColumn(to, all_spans(text_or_empty(), limits))


def redact(docs: DataFrame, limits: dict[int, int]) -> DataFrame:
    """docs, each span in its text put as <ASSIGN>, <ACCESS>, <HEX> or <RANDOM>; null texts stay null."""
    own = unused(docs, "spans")
    out = find(docs, limits, own).withColumn("text", replaced(F.col("text"), F.col(own), KINDS))
    return out.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `find` defines them; nulls, ties, long texts and empty tables likewise."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    limits = fit(docs)
    out = find(docs, limits).drop("text")
    place = lambda spans: F.transform(
        F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))),
        lambda s: F.struct(s["kind"], s["start"], s["end"]),
    )
    base = F.filter("__spans", lambda s: s["kind"] != RANDOM)
    count = lambda k: F.size(F.filter("__spans", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in (ASSIGN, ACCESS, HEX)],
        F.sha2(text_of(place(base), KINDS).cast("binary"), 256).alias("base_sha256"),
        text_of(place(F.col("__spans")), KINDS).alias("spans"),
    )
