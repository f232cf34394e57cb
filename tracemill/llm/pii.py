"""Personal data by candidate gradient boosting, in DataFrame operations only.

Loose generators propose overlapping spans. Each span is a cell of small integers: its format (groups, separators, check
sum) and its context. Boosted trees are fitted to counted cells, so at most CELLS rows of a table of counts reach the
driver, whatever the size of the corpus. Labels come from two sides: `examples`, texts made here of which it is known
where personal data stands (strict and loose forms) and what only looks like it (dates, amounts, book and version
numbers, other codes); and the corpus, whose strict spans are sure cases of their kind and whose dates and amounts are
sure cases of none. Other candidates of the corpus are unlabelled and stay out of the fit. On folds that the trees have
not seen, isotonic regression turns scores into probabilities; a candidate is taken from a stated probability on.
"""

from __future__ import annotations

import json
import math
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settle, text_or_empty, unused
from .spans import SPANS, apart, first_of_overlapping, found, let, replaced, text_of

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)

#: The strict rules. Runs are possessive and begin where no run goes on, so that no text takes quadratic time.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
STRICT = {
    EMAIL: _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The loose generators: mail, dotted quads, digit groups.
LOOSE = [
    _LOCAL + r" ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?: ?\. ?[0-9]++){3}",
    r"(?<![0-9])\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
]
#: What may stand shortly before a span of each kind.
CUES = [
    r"(?i)e-?mail|courriel|correo|contact|write",
    r"(?i)\bip\b|addr|host|server",
    r"(?i)card|visa|master|karte|carte|tarjeta",
    r"(?i)tel|phone|call|fax|mobil|llam|appel|anruf",
]
#: What says that a number is of another sort, before and after it.
OTHER = [
    r"(?i)(?:isbn|issn|doi|order|invoice|version|release|build|part|serial|date|since|until|total|sold|sum|price|about|page|no\.|nr\.|#|[$€£v])[ :]*$",
    r"(?i)^ ?(?:%|[$€£]|eur|usd|units|people|years|km|kg|tons|dollars|euros|bytes|items|votes|uhr|o'clock|pm\b|am\b)",
]
_DAY, _MONTH, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: The shape of a number: the first that fits, from 1 on; 0 is any other.
SHAPES = [
    r"^[0-9]+$",
    rf"^(?:{_YEAR}([ .-])?{_MONTH}\1?{_DAY}|{_DAY}([ .-]){_MONTH}\2{_YEAR})(?![0-9]{{2}}[ .-]?[0-9]{{4}}$)",
    r"^[1-9][0-9]{0,2}(?:([ .])[0-9]{3})(?:\1[0-9]{3})*$",
    r"^97[89][ -]?[0-9](?:[ -]?[0-9]){9}$",
    r"^[0-9]{4}(?:[ .-]{1,2}[0-9]{4}){3}$",
    r"^\+?(?:[0-9]{1,3}[ .-])?\(?0?[0-9]{2,4}\)?[ .-]{1,2}[0-9]{3,4}[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2})?$",
    r"^[0-9]{1,3}(?: ?\. ?[0-9]{1,3}){3}$",
]
RUN, DATE, AMOUNT, BOOK = 1, 2, 3, 4
#: Features of a candidate and how many values each has.
SIZES = {
    "gen": 3, "digits": 8, "seps": 6, "shape": len(SHAPES) + 1, "luhn": 2, "cue": 5, "other": 2, "left": 2, "right": 2,
    "octets": 2, "lead": 4,
}
CELLS = math.prod(SIZES.values())
_CAND = "array<struct<start:int,end:int," + ",".join(f"{f}:int" for f in SIZES) + ">>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits, up to some dozens of them, pass the check sum."""

    def add(acc: Column, i: Column) -> Column:
        v = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return m.rlike(rf"^{octet}(?: ?\. ?{octet}){{3}}$")


def strict_spans(text: Column) -> Column:
    """The base spans, by kind, then start; matches that fail their check are dropped."""
    digit = text.rlike("[0-9]")
    email = found(text, STRICT[EMAIL], EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(found(text, STRICT[IP], IP, digit), lambda s: _octets(s["m"]))
    card = F.filter(
        found(text, STRICT[CARD], CARD, text.rlike("[0-9](?:[ -]?[0-9]){12}")),
        lambda s: let(
            _digits(s["m"]), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False))
        ),
    )
    phone = F.filter(
        found(text, STRICT[PHONE], PHONE, F.contains(text, F.lit("+"))),
        lambda s: F.length(_digits(s["m"])).between(9, 15),
    )
    return F.concat(email, ip, card, phone)


def candidates(text: Column) -> Column:
    """What the generators propose, with features; spans may overlap."""
    worth = [text.rlike(r"@|[\[(]at[\])]"), text.rlike("[0-9]"), text.rlike("[0-9](?:[ ().-]{0,2}[0-9]){6}")]
    spans = F.concat(*[found(text, p, i, w, around=24) for i, (p, w) in enumerate(zip(LOOSE, worth))])

    def described(s: Column) -> Column:
        m, before, after = s["m"], s["before"], s["after"]
        d = _digits(m)
        n = F.length(d)
        size = sum((F.when(n >= k, 1).otherwise(0) for k in (7, 9, 11, 13, 16, 17, 20)), F.lit(0))
        has = lambda c: F.contains(m, F.lit(c))
        mixed = F.when(has("("), 5).when(has(" ") & has("-") & ~has("."), 4).when(has(".") & (has(" ") | has("-")), 5)
        seps = mixed.when(has("-"), 3).when(has("."), 2).when(has(" "), 1).otherwise(0)
        cue, shape = F.lit(0), F.lit(0)
        for i, c in enumerate(CUES):
            cue = F.when(before.rlike(c), i + 1).otherwise(cue)
        for i in reversed(range(len(SHAPES))):
            shape = F.when(m.rlike(SHAPES[i]), i + 1).otherwise(shape)
        first = F.left(m, F.lit(1))
        return F.struct(
            s["start"],
            s["end"],
            s["kind"].alias("gen"),
            size.alias("digits"),
            seps.alias("seps"),
            F.when(s["kind"] == 0, 0).otherwise(shape).alias("shape"),
            F.when(n.between(13, 19), luhn(d)).otherwise(F.lit(False)).cast("int").alias("luhn"),
            cue.alias("cue"),
            (before.rlike(OTHER[0]) | after.rlike(OTHER[1])).cast("int").alias("other"),
            (~before.rlike("[A-Za-z0-9_]$")).cast("int").alias("left"),
            (~after.rlike("^[A-Za-z0-9_]")).cast("int").alias("right"),
            F.when(s["kind"] == 1, _octets(m)).otherwise(m.rlike(r"[.\])][ ]?[a-z]{2,}$")).cast("int").alias("octets"),
            F.when(first == "+", 3).when(first == "(", 2).when(first == "0", 1).otherwise(0).alias("lead"),
        )

    return F.transform(spans, described).cast(_CAND)


def examples(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """(id, text, kind, start, end): made-up texts, each with one number or address at a known place; kind -1: nothing
    personal. Seven in sixteen are personal, of each kind strict and loose forms, with a telling word before them or not.
    """
    draw = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m)).cast("int")
    digits = lambda salt, k: F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**k)).cast("string"), k, "0")
    pick = lambda salt, options: F.get(F.array(*[o if isinstance(o, Column) else F.lit(o) for o in options]), draw(salt, len(options)))
    octet, day, month = lambda i: draw(i, 256).cast("string"), F.lpad((draw(61, 28) + 1).cast("string"), 2, "0"), F.lpad((draw(62, 12) + 1).cast("string"), 2, "0")
    year = (draw(63, 80) + 1950).cast("string")
    name, place = pick(1, ["bob", "anna.k", "j_smith", "li99", "m-r"]), pick(2, ["example", "mail-box", "uni7", "post"])
    end = pick(3, ["com", "org", "de", "net"])
    mail = pick(4, [
        F.concat(name, F.lit("@"), place, F.lit("."), end), F.concat(name, F.lit(" [at] "), place, F.lit(" [dot] "), end),
        F.concat(name, F.lit("(at)"), place, F.lit("(dot)"), end), F.concat(name, F.lit(" @ "), place, F.lit("."), end),
        F.concat(name, F.lit(" (at) "), place, F.lit("."), end),
    ])
    dot = pick(5, [".", ".", " . ", ". "])
    quad = F.concat(octet(11), dot, octet(12), dot, octet(13), dot, octet(14))
    body = F.concat((draw(21, 3) + 3).cast("string"), digits(22, 14))
    card = F.concat(body, F.get(F.filter(F.array(*[F.lit(str(c)) for c in range(10)]), lambda c: luhn(F.concat(body, c))), F.lit(0)))
    off = F.concat(F.left(card, F.lit(15)), ((F.right(card, F.lit(1)).cast("int") + 1 + draw(23, 9)) % 10).cast("string"))
    four = lambda d, by: F.concat_ws(by, d.substr(1, 4), d.substr(5, 4), d.substr(9, 4), d.substr(13, 4))
    cards = pick(24, [card, four(card, " "), four(card, "-"), four(card, "."), four(card, "  ")])
    a, b, c = digits(31, 3), digits(32, 3), digits(33, 4)
    area = F.concat((draw(34, 8) + 2).cast("string"), digits(35, 2))
    phone = pick(36, [
        F.concat(F.lit("+"), (draw(37, 89) + 10).cast("string"), F.lit(" "), area, F.lit(" "), b, c),
        F.concat(F.lit("("), area, F.lit(") "), b, F.lit("-"), c), F.concat_ws("-", area, b, c), F.concat_ws(".", area, b, c),
        F.concat(F.lit("0"), area, F.lit(" "), b, c), F.concat(F.lit("0"), area, F.lit("-"), c, b),
        F.concat(F.lit("("), F.lit("0"), area, F.lit(") "), c, F.lit(" "), b),
    ])
    date = pick(41, [
        F.concat_ws("-", year, month, day), F.concat(F.concat_ws("-", year, month, day), F.lit(" 12 30")),
        F.concat_ws(".", day, month, year), F.concat(F.concat_ws(".", day, month, year), F.lit(" 14.30")),
        F.concat(year, month, day), F.concat(year, month, day, F.lit("-"), digits(42, 6)), F.concat(year, F.lit("-"), year),
        F.concat(F.concat_ws(" ", day, month, year), F.lit(" 10 15")),
    ])
    lead = (draw(43, 999) + 1).cast("string")
    amount = pick(44, [
        F.concat_ws(" ", lead, a, b), F.concat_ws(" ", lead, a, b, digits(45, 3)), F.concat_ws(".", lead, a, b),
        F.concat_ws(" ", lead, F.lit("000"), F.lit("000"), F.lit("000")), F.concat_ws(" ", lead, F.lit("000"), F.lit("000")),
        F.concat(lead, F.lit("."), digits(46, 9)), F.concat_ws("-", digits(47, 4), digits(48, 4)),
    ])
    code = pick(51, [
        F.concat(F.lit("978-"), digits(52, 1), F.lit("-"), digits(53, 2), F.lit("-"), digits(54, 6), F.lit("-"), digits(55, 1)),
        F.concat(F.lit("978"), digits(56, 10)), F.concat_ws(".", digits(57, 1), digits(58, 1), digits(59, 4), digits(60, 1)),
        F.concat_ws(".", (draw(64, 20) + 300).cast("string"), digits(65, 1), digits(66, 2), digits(67, 3)), off, four(off, " "),
        four(off, "."), digits(68, 8), digits(69, 10), digits(70, 12), F.concat_ws("-", digits(71, 5), digits(72, 6)),
        F.concat(F.lit("price @ "), digits(73, 1), F.lit("."), digits(74, 2)), F.concat(digits(75, 11), digits(76, 11)),
    ])
    kind = F.get(F.array(*[F.lit(k) for k in [0, 0, 1, 2, 2, 3, 3, -1, -1, -1, -2, -2, -2, -3, -3, -3]]), draw(0, 16))
    planted = F.when(kind == 0, mail).when(kind == 1, quad).when(kind == 2, cards).when(kind == 3, phone)
    planted = planted.when(kind == -1, date).when(kind == -2, amount).otherwise(code)
    plain = ["then ", "we saw ", "und ", "la ", "it was ", "(", "see ", ""]
    cues = F.when(kind == 0, pick(81, ["e-mail: ", "contact ", "courriel "])).when(kind == 1, pick(81, ["host ", "server ", "IP "]))
    cues = cues.when(kind == 2, pick(81, ["card ", "visa: ", "Karte "])).when(kind == 3, pick(81, ["tel. ", "phone ", "call "]))
    others = F.when(kind == -1, pick(81, ["date ", "since ", "until "])).when(kind == -2, pick(81, ["about ", "total ", "sold "]))
    cues = cues.otherwise(others.otherwise(pick(81, ["order ", "version ", "ISBN "])))
    before = F.when(draw(82, 2) == 0, cues).otherwise(pick(83, plain))
    after = F.when((kind == -2) & (draw(84, 2) == 0), pick(85, [" units", " km", " EUR"])).otherwise(pick(86, [".", ", and", " so", ")", ""]))
    out = spark.range(n).select("id", kind.alias("kind"), planted.alias("p"), F.concat(F.lit("some words "), before).alias("b"), after.alias("a"))
    begin = F.length("b")
    return out.select(
        "id", F.concat("b", "p", "a").alias("text"), F.greatest("kind", F.lit(-1)).alias("kind"),
        begin.alias("start"), (begin + F.length("p")).alias("end"),
    )


Tree = tuple  # (test, (test, leaf, leaf), (test, leaf, leaf)); a test is (feature, value, whether at least)


def _tests() -> list[tuple[str, int, bool]]:
    return [(f, v, least) for f, n in SIZES.items() for v, least in product(range(n), (False, True)) if v or not least]


def _outcomes(cells: list, tests: list) -> np.ndarray:
    """A row for each cell, a column for each test."""
    x = {f: np.array([c[0][f] for c in cells]) for f in SIZES}
    return np.stack([x[f] >= v if least else x[f] == v for f, v, least in tests], axis=1)


def boosted(cells: list, rounds: int = 30, rate: float = 0.4, ridge: float = 1.0) -> tuple[float, list[Tree]]:
    """Trees of depth two for cells (features, yes, no), fitted round by round to the logistic loss."""
    tests = _tests()
    holds = _outcomes(cells, tests)
    yes, no = np.array([c[1] for c in cells], float), np.array([c[2] for c in cells], float)
    base = math.log((yes.sum() + 0.5) / (no.sum() + 0.5))
    score, trees = np.full(len(cells), base), []

    def split(rows: np.ndarray, slope: np.ndarray, bend: np.ndarray) -> int | None:
        """The test that gains most over the rows."""
        g, h, t = slope[rows], bend[rows], holds[rows]
        gy, hy = g @ t, h @ t
        gain = gy**2 / (hy + ridge) + (g.sum() - gy) ** 2 / (h.sum() - hy + ridge) - g.sum() ** 2 / (h.sum() + ridge)
        gain[t.all(axis=0) | ~t.any(axis=0)] = 0
        top = int(np.argmax(gain)) if len(rows) else 0
        return top if len(rows) and gain[top] > 1e-9 else None

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        slope, bend = yes * (1 - p) - no * p, (yes + no) * p * (1 - p)
        every = np.arange(len(cells))
        top = split(every, slope, bend)
        if top is None:
            break
        sides = []
        for rows in (every[holds[:, top]], every[~holds[:, top]]):
            t = split(rows, slope, bend)
            parts = (rows, rows[:0]) if t is None else (rows[holds[rows, t]], rows[~holds[rows, t]])
            leaves = [float(rate * slope[part].sum() / (bend[part].sum() + ridge)) for part in parts]
            for part, leaf in zip(parts, leaves):
                score[part] += leaf
            sides.append((None if t is None else tests[t], *leaves))
        trees.append((tests[top], *sides))
    return base, trees


def _holds(x: dict[str, int], test: tuple[str, int, bool]) -> bool:
    feature, value, least = test
    return x[feature] >= value if least else x[feature] == value


def score_of(x, model: tuple[float, list[Tree]], holds, pick):
    base, trees = model
    total = base
    for top, *sides in trees:
        leaves = [a if t is None else pick(holds(x, t), a, b) for t, a, b in sides]
        total = total + pick(holds(x, top), *leaves)
    return total


def score_column(x: Column, model: tuple[float, list[Tree]]) -> Column:
    """score_of as a column, for the features in order as an array. The trees are one constant that is folded over, so
    that the plan stays small however many there are."""
    order = list(SIZES)

    def node(test, a: float, b: float) -> dict:
        f, v, least = test or (order[0], 0, True)  # a test that always holds
        return {"f": order.index(f), "v": v, "least": least, "a": a, "b": b if test else a}

    rows = [{"t": node(top, 0.0, 0.0), "l": node(*sides[0]), "r": node(*sides[1])} for top, *sides in model[1]]
    kind = "struct<f:int,v:int,least:boolean,a:double,b:double>"
    trees = F.from_json(F.lit(json.dumps(rows)), f"array<struct<t:{kind},l:{kind},r:{kind}>>")

    def holds(n: Column) -> Column:
        value = F.get(x, n["f"])
        return F.when(n["least"], value >= n["v"]).otherwise(value == n["v"])

    leaf = lambda n: F.when(holds(n), n["a"]).otherwise(n["b"])
    return F.aggregate(trees, F.lit(model[0]), lambda acc, t: acc + F.when(holds(t["t"]), leaf(t["l"])).otherwise(leaf(t["r"])))


def calibrated(scored: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(least score, probability), rising: isotonic regression of (score, yes, no) by pooling adjacent violators."""
    pools: list[list[float]] = []  # least score, yes, all
    for s, yes, no in sorted(scored):
        if pools and pools[-1][0] == s:
            pools[-1][1:] = pools[-1][1] + yes, pools[-1][2] + yes + no
        else:
            pools.append([s, yes, yes + no])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, yes, n = pools.pop()
            pools[-1][1:] = pools[-1][1] + yes, pools[-1][2] + n
    return [(s, yes / n) for s, yes, n in pools if n > 0]


def _counted(rows: DataFrame) -> list:
    """Rows (held, truth, c) as counted cells; truth is a kind, or -1 for none."""
    counts = rows.groupBy("held", *[F.col(f"c.{f}").alias(f) for f in SIZES])
    return counts.agg(*[F.count_if(F.col("truth") == k).alias(f"k{k}") for k in range(4)], F.count(F.lit(1)).alias("n")).collect()


def fit(docs: DataFrame, probability: float = 0.9, folds: int = 4) -> dict[int, tuple]:
    """For each kind its trees and the least score of calibrated probability of at least `probability`, if there is one.

    One document or example in `folds`, by its id's hash, calibrates; the others fit the trees. The cells of the corpus
    together weigh as much as the examples at the most.
    """
    held = lambda i: (F.pmod(F.xxhash64(i), F.lit(folds)) == 0).alias("held")
    made = settle(examples(docs.sparkSession))  # else each use of the text would make it again
    made = made.withColumn("c", F.explode(candidates(F.col("text"))))
    right = (F.col("c.start") == F.col("start")) & (F.col("c.end") == F.col("end"))
    made = _counted(made.select(held("id"), F.when(right, F.col("kind")).otherwise(-1).alias("truth"), "c"))

    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("__cand", candidates(F.col("text")))
    rows = rows.filter(F.size("__cand") > 0).select(held("doc_id"), F.explode(_known(F.col("__cand"), strict_spans(F.col("text")))).alias("x"))
    rows = rows.select("held", "x.truth", "x.c")
    sure = (F.col("truth") >= 0) | F.col("c.shape").isin(DATE, AMOUNT, BOOK) | (F.col("c.other") == 1)
    seen = _counted(rows.filter(sure))
    weight = min(1.0, sum(r["n"] for r in made) / max(1, sum(r["n"] for r in seen)))
    models = {}
    for k in range(4):
        cells = [
            ({f: r[f] for f in SIZES}, w * r[f"k{k}"], w * (r["n"] - r[f"k{k}"]), r["held"])
            for part, w in ((made, 1.0), (seen, weight))
            for r in part
        ]
        cells.sort(key=lambda c: (c[3], tuple(c[0].values()), c[1:3]))
        model = boosted([c[:3] for c in cells if not c[3]])
        pick = lambda test, a, b: a if test else b
        curve = calibrated([(round(score_of(x, model, _holds, pick), 9), yes, no) for x, yes, no, out in cells if out])
        least = next((s for s, p in curve if p >= probability), None)
        if least is not None:
            models[k] = (model, least)
    return models


def _known(cand: Column, strict: Column) -> Column:
    """{truth, c} for each candidate: the kind of the strict span in the same place, or -1.

    In order of place a candidate stands next to its strict span, or behind one other candidate of that place.
    """
    row = lambda s, tag, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), tag.alias("tag"), c.alias("c"))
    nothing = F.lit(None).cast(_CAND[6:-1])
    both = F.concat(F.transform(strict, lambda s: row(s, s["kind"], nothing)), F.transform(cand, lambda c: row(c, F.lit(4), c)))

    def labelled(x: Column) -> Column:
        one, n = F.slice(x, 1, 1), F.size(x)
        back = F.zip_with(
            F.concat(one, F.slice(x, 1, n - 1)), F.concat(one, one, F.slice(x, 1, F.greatest(n - 2, F.lit(0)))),
            lambda p, q: F.struct(p.alias("p"), q.alias("q")),
        )
        same = lambda s, y: (y["tag"] < 4) & (y["start"] == s["start"]) & (y["end"] == s["end"])
        truth = lambda s, y: F.when(same(s, y["p"]), y["p"]["tag"]).when(same(s, y["q"]), y["q"]["tag"]).otherwise(-1)
        return F.filter(
            F.zip_with(x, back, lambda s, y: F.struct(truth(s, y).alias("truth"), s["c"].alias("c"))), lambda z: z["c"].isNotNull()
        )

    return let(F.sort_array(both), labelled)


def all_spans(text: Column, models: dict[int, tuple]) -> Column:
    """Base spans and, clear of them, the candidates that the trees take; added ones have an empty m."""

    def taken(c: Column) -> Column:
        def first(x: Column) -> Column:
            one = lambda k, m: F.when(
                score_column(x, m[0]) >= m[1] - 1e-6, F.struct(F.lit(k).alias("kind"), c["start"], c["end"], F.lit("").alias("m"))
            )
            return F.coalesce(*[one(k, m) for k, m in models.items()])

        return let(F.array(*[c[f] for f in SIZES]), first)

    strict = strict_spans(text)
    if not models:
        return strict
    more = lambda base: apart(
        F.filter(F.transform(candidates(text), taken), lambda s: s.isNotNull()).cast(SPANS), base
    )
    together = lambda base: F.concat(base, first_of_overlapping(more(base)))
    # without a digit or the sign of a mail address no generator proposes anything
    return F.when(text.rlike(r"[0-9]|@|[\[(]at[\])]"), let(strict, together)).otherwise(F.array().cast(SPANS))


def find(docs: DataFrame, models: dict[int, tuple], to: str = "__spans") -> DataFrame:
    """docs with the column `to` (replaced if there is one), the base and the added spans.

    Null text: no spans. Null doc_id and repeated rows: kept, a row each. Ties, that is equal starts: the longer span
    is behind the shorter one. Empty input: no rows. Texts are read whole, in time that grows little faster than their
    length. Other columns stay as they are.
    """
    return docs.withColumn(to, all_spans(text_or_empty(), models))


def redact(docs: DataFrame, models: dict[int, tuple]) -> DataFrame:
    """docs, each span in its text put as <EMAIL>, <IP>, <CARD> or <PHONE>; null texts stay null."""
    own = unused(docs, "spans")
    out = find(docs, models, own).withColumn("text", replaced(F.col("text"), F.col(own), KINDS))
    return out.select(*docs.columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `find` defines them; nulls, ties, long texts and empty tables likewise."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    models = fit(docs)
    text = text_or_empty()
    out = docs.withColumn("__spans", all_spans(text, models)).drop("text")
    # strict spans carry their text, added ones none
    base = F.filter("__spans", lambda s: s["m"] != "")
    ordered = F.sort_array("__spans")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(text_of(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        text_of(ordered, KINDS).alias("spans"),
    )
