"""Functions that SQL cannot state, against plain definitions and known cases; sources and sinks on awkward files."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions import alignment, answers, copies, expressions, lexicon, markers, puzzles, stats, strips, text, tokens
from tracemill.operators import assembly, extend, ordered, packing, rises
from tracemill.operators.common import scratch
from tracemill.plans import catalog
from tracemill.plans.fixtures import traces
from tracemill.sources import runs, sinks

SF = "/root/testdata/sf0.001"


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def one(spark, value, *columns, schema="t string"):
    return spark.createDataFrame([value if isinstance(value, tuple) else (value,)], schema).select(*columns).collect()[0]


def packed(t, most, tail):
    """Segments by a plain loop."""
    parts = re.split(r"(\n[ \t]*\n\s*)", t)
    items = list(zip(parts[0::2], [*parts[1::2], ""]))
    out = []
    for p, gap in items:
        n = len((p + gap).split())
        if out and out[-1][2] + n <= most:
            out[-1] = (out[-1][0] + out[-1][1] + p, gap, out[-1][2] + n)
        else:
            out.append((p, gap, n))
    if len(out) > 1 and out[-1][2] < tail:
        a, b = out[-2:]
        out[-2:] = [(a[0] + a[1] + b[0], b[1], a[2] + b[2])]
    return out


def test_segments(spark):
    assert len(packed("a b\n\nc d e\n\n\nf", 3, 0)) == 3
    rng = random.Random(2)
    cases = ["a b\n\nc d e\n\n\nf", "", "x", "\n\n", "a\n\n\n\nb"]
    for _ in range(60):
        cases.append("".join(rng.choice(["a", " ", "bb ", "\n\n", "\n \n\n", "word ", "\n"]) for _ in range(rng.randint(0, 80))))
    cases += ["a\n\n" * 3000, *["a b\n\nc"] * 2]
    df = rows(spark, list(enumerate([*cases, None])), "k int, t string").repartition(3)
    for most, tail in ((3, 0), (3, 2), (8, None)):
        got = {}
        for r in packing.packed(df, "t", most, least_tail=tail).collect():
            got.setdefault(r["k"], []).append((r["position"], r["text"], r["gap"], r["tokens"]))
        assert len(got) == len(cases)
        for k, t in enumerate(cases):
            assert [x[1:] for x in sorted(got[k])] == packed(t, most, most // 4 if tail is None else tail), t


def test_known_numbers_and_guards(spark):
    n = lambda t: set(one(spark, t, text.numbers(F.col("t")))[0])
    assert n("1,000 and 1000 and 29.98, then 3.") == {"1000", "29.98", "3"}
    assert n("1,000,000,000 1,00 12,345,6789") == {"1000000000", "1", "00", "12345", "6789"}
    m = one(spark, ("x = 12, y = 7", "x = 12"), text.missing_numbers(F.col("a"), F.col("b")), schema="a string, b string")[0]
    assert tuple(m) == (1, 2)
    why = lambda a, b, finish="stop", p=1: one(spark, (a, b, finish), text.check(F.col("a"), F.col("b"), p, F.col("f")), schema="a string, b string, f string")[0]
    long = "The value of the first sum " * 20
    assert why("a", "a") is None and why("a", "b", "length") == "truncated" and why("a", " \n") == "empty"
    assert why(long, long[:100]).startswith("too_short:0.1") and why(long, long * 2) == "too_long:2.00"
    assert why("1 2 3 4 5", "none") == "numbers_missing:5/5" and why("alpha betas gammas deltas omega", "alpha") == "content_lost:0.20"
    assert why("a", "1. a\n2. b\n- c") == "list_introduced:3"
    assert one(spark, ("a", "1. a\n2. b\n- c"), text.check_revoice(F.col("a"), F.col("b"), F.lit("stop")), schema="a string, b string")[0] == "list_introduced"


def test_boxes_of_any_length(spark):
    huge = "\\boxed{" + "x{y}" * 50_000 + "}"
    assert len(one(spark, huge, answers.boxed(F.col("t")))[0][0]) == 200_000
    assert len(one(spark, huge, answers.extract_answer(F.col("t")))[0]) == 200_000
    got = one(spark, "t</think>\\boxed{1}\nso \\boxed{81} and \\boxed{2{5}6}", answers.own_answer(F.col("t")))[0]
    assert got == ["81", "2{5}6"] and one(spark, "\\boxed{1}", answers.own_answer(F.col("t")))[0] is None


@pytest.mark.parametrize("a,b,same", [
    ("1/2", "0.5", True), ("\\frac{1}{2}", "\\dfrac12", True), ("-\\frac{3}{4}", "-0.75", True), ("50\\%", "50", True), ("1,000", "1000", True),
    ("x+1", "x + 1", True), ("x", "y", False), ("", "", False), (None, "1", False), ("3.00001", "3", True), ("3.01", "3", False), ("\\text{Yes}", "yes", True),
    ("90^\\circ", "90", True), ("1/0", "2", False),
])
def test_math_equal(spark, a, b, same):
    assert one(spark, (a, b), answers.math_equal(F.col("a"), F.col("b")), schema="a string, b string")[0] is same


def test_clean_prefix(spark):
    def ratio(w, n):
        g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        return 1.0 if len(w) < 4 * n else len(set(g)) / len(g)

    def plain(t):
        w = t.split()
        cut = next((i for i in range(0, len(w) - 400, 100) if ratio(w[i : i + 400], 8) < 0.6), len(w))
        if len(w) < 400 or cut < 400:
            return None
        out = " ".join(w[:cut])
        b = out.rfind(". ")
        out = (out[: b + 1] if b > len(out) * 0.5 else out).strip()
        return out if ratio(out.split(), 12) >= 0.6 else None

    rng = random.Random(4)
    cases = ["short", "a " * 3000]
    for k in range(8):
        body = [rng.choice(["w%d" % rng.randint(0, 5000), "end."]) if rng.random() < 0.1 else f"w{rng.randint(0, 5000)}" for _ in range(300 + 150 * k)]
        cases.append(" ".join(body + body[-20:] * (40 if k % 2 else 0)))
    got = rows(spark, [(c,) for c in cases], "t string").select("t", text.clean_prefix(F.col("t")).alias("p")).collect()
    for r in got:
        assert r["p"] == plain(r["t"])
    assert sum(r["p"] is not None for r in got) >= 4
    built = lambda mode, a, b: one(spark, (mode, a, b), text.build_output(F.col("m"), F.col("r"), F.col("c")), schema="m string, r string, c string")[0]
    assert built("style", "thought", " c ") == "c" and built("search", "<think>r</think>", "c") == "r\n\nc" and built("solo", "r", "") == "r" and built("solo", None, None) is None


def test_one_pass_counts_what_each_pattern_counts(spark):
    rng = random.Random(8)
    pieces = [x for lists in markers.LISTS.values() for p in lists for x in lexicon.phrases(p)]
    pieces = [x.strip("\x01\x02") for x in pieces] + [" ", " ", ", ", "\n", "a", "é", "_", ".", "hm", "no,\t", "wait", "-", "İ"]
    texts = ["".join(rng.choice((str.upper, str.lower, str))(rng.choice(pieces)) for _ in range(rng.randrange(30))) for _ in range(600)]
    book = lexicon.Lexicon(markers.LISTS)
    for t in texts:
        want = [sum(1 for _ in re.finditer("|".join(f"(?:{p})" for p in own), t, re.I | re.A)) for own in markers.LISTS.values()]
        assert book.counts(t) == want, t
    assert lexicon.phrases(r"\ba(b|cd?)[ -]e?\s") == ["\x01ab e\x02", "\x01ab \x02", "\x01ab-e\x02", "\x01ab-\x02", "\x01acd e\x02", "\x01acd \x02", "\x01acd-e\x02", "\x01acd-\x02", "\x01ac e\x02", "\x01ac \x02", "\x01ac-e\x02", "\x01ac-\x02"]
    assert one(spark, (None,), markers.lexicon_counts(F.col("t"))["nine"].alias("n"))[0] == 0


EQUAL = [
    ('x+1', '1+x'),
    ('(x+1)^2', 'x^2+2x+1'),
    ('\\frac{1}{2}', '0.5'),
    ('\\frac12', '1/2'),
    ('\\sqrt{8}', '2\\sqrt2'),
    ('\\frac{x^2-1}{x-1}', 'x+1'),
    ('\\{1,2\\}', '\\{2, 1\\}'),
    ('1,2', '2,1'),
    ('[0,\\infty)', '\\left[0, \\infty\\right)'),
    ('x=5', '5'),
    ('2x+y=3', 'y+2x-3=0'),
    ('4x+2y=6', '2x+y=3'),
    ('\\pm 2', '\\{-2,2\\}'),
    ('1,000', '1000'),
    ('5\\text{ cm}', '5'),
    ('90^\\circ', '90'),
    ('2\\pi r', 'r\\cdot 2\\pi'),
    ('\\sin(2x)', '\\sin(x+x)'),
    ('\\frac{1}{\\sqrt{2}}', '\\frac{\\sqrt{2}}{2}'),
    ('3\\frac{1}{2}', '3.5'),
    ('x^{-1}', '1/x'),
    ('(-\\infty,1)\\cup(2,3]', '(2,3]\\cup(-\\infty,1)'),
    ('-x^2', '-(x^2)'),
    ('x^{1/2}', '\\sqrt{x}'),
    ('\\sqrt{x^2y}', 'x\\sqrt{y}'),
    ('a_1+b_{12}', 'b_{12}+a_1'),
    ('2^{10}', '1024'),
    ('5!', '120'),
    ('x \\in [0,1]', '[0,1]'),
    ('y = 2x+1', '2x+1'),
    ('(\\sqrt2+\\sqrt3)^2', '5+2\\sqrt6'),
    ('\\text{yes}', 'YES'),
    ('50\\%', '0.5'),
    ('50\\%', '50'),
]
OTHER = [
    ('x+1', 'x+2'),
    ('(1,2)', '(2,1)'),
    ('[0,1]', '(0,1]'),
    ('x', 'y'),
    ('\\{1,2\\}', '\\{1,2,3\\}'),
    ('x^2', '2x'),
    ('-x^2', '(-x)^2'),
    ('\\frac{1}{0}', '\\frac{2}{0}'),
    ('', ''),
    ('2x+y=3', '2x+y=4'),
    ('\\sin x', '\\cos x'),
    ('abc', 'abd'),
    ('((', ')('),
    (None, None),
    ('1', None),
    ('\\frac{', '1'),
    ("{" * 3000, "}" * 3000),
]


def test_expressions(spark):
    df = rows(spark, [(i, a, b) for i, (a, b) in enumerate(EQUAL + OTHER)], "i int, a string, b string")
    got = {r["i"]: r["e"] for r in df.select("i", expressions.math_equal(F.col("a"), F.col("b")).alias("e")).collect()}
    assert [p for i, p in enumerate(EQUAL) if not got[i]] == [] and [p for i, p in enumerate(OTHER) if got[len(EQUAL) + i]] == []


def test_rational_expressions_against_exact_arithmetic():
    from fractions import Fraction

    rng = random.Random(4)

    def made(depth):
        """An expression and its value at x = 3/7, by fractions; written in several ways."""
        if depth == 0:
            n, d = rng.randrange(1, 9), rng.randrange(1, 5)
            return rng.choice([("x", Fraction(3, 7)), (str(n), Fraction(n)), (f"\\frac{{{n}}}{{{d}}}", Fraction(n, d))])
        (a, u), (b, v) = made(depth - 1), made(depth - 1)
        op = rng.choice("+-*/")
        if op == "/" and v:
            return f"\\frac{{{a}}}{{{b}}}", u / v
        return (f"({a})({b})", u * v) if op == "*" else (f"({a}) {op if op in '+-' else '+'} ({b})", u - v if op == "-" else u + v)

    def at(text):
        form, _, _ = expressions.expression(text.replace("x", "(3/7)"))
        return form

    for _ in range(300):
        a, u = made(3)
        assert at(a) == at(f"\\frac{{{u.numerator}}}{{{u.denominator}}}"), a
        assert at(a) != at(f"\\frac{{{u.numerator + 1}}}{{{u.denominator}}}")
        b, v = made(2)
        same = {expressions.expression(f"({a})({b}) - {b.join('()')}")[0], expressions.expression(f"({b})({a}) - ({b})")[0], expressions.expression(f"(({a}) - 1)*({b})")[0]}
        assert len(same) == 1


def test_strips(spark):
    edits = (strips.without_words, strips.without_clauses, strips.without_sentences)
    gap = " " * 250 + "\n" * 130
    cases = {
        "Wait, let me see. $wait$ is fine; hmm, maybe not. So actually we go.\nPerhaps: yes": (
            "Let me see. $wait$ is fine; not. So we go.\nYes", "let me see. $wait$ is fine. \nyes.", ""),
        "No doubt here. \\( maybe \\) stays.": ("No doubt here. \\( maybe \\) stays.", "No doubt here. \\( maybe \\) stays.", "No doubt here.\n\\( maybe \\) stays."),
        f"One.{gap}maybe two here": (f"One. {gap.strip(' ')}Two here", f"One. {gap.strip(' ')}", "One."),
        f"one.{gap}two": (f"One. {gap.strip(' ')}Two", f"one. {gap.strip(' ')}two", "one.\ntwo"),
        " \n , hmm \\boxed{wait {maybe}} x": ("\\boxed{wait {maybe}} x", "\n.", ""),
        "so\n\n ;; b": ("So\n; b", "so\n\n ;; b", "so\n ;; b"),
        "A waiting one, and waits. hmmm": ("A waiting one, and waits. Hmmm", "A waiting one, and waits. hmmm", "A waiting one, and waits.\nhmmm"),
        "x, wait - y! no": ("X, y! No", "x. no", "no"),
        "": ("", "", ""),
    }
    for t, want in cases.items():
        assert "".join(x for _, x in strips.tokens(t)) == t
        assert tuple(e(t) for e in edits) == want, t
    got = one(spark, (None,), *[c(F.col("t")) for c in (strips.strip_words, strips.strip_clauses, strips.strip_sentences)])
    assert tuple(got) == (None, None, None)
    start = time.perf_counter()
    strips.without_words(("maybe " + gap) * 2_000)
    assert time.perf_counter() - start < 5


def test_puzzle_labels(spark):
    names = ["Ann", "Bob"]
    read = lambda t, reasoning=False: one(spark, (t, names), puzzles.parse_labels(F.col("t"), F.col("n"), reasoning), schema="t string, n array<string>")[0]
    assert read("CONCLUSION:\n(1) Ann is a knight\n(2) Bob is a knave\nBob is a knight") == [True, False]
    assert read("conclusion : Ann is knight and Bob is a knave\n\nAnn is a knave") == [True, False]
    assert read("CONCLUSION: Ann is a knight") is None and read("none") is None and read("CONCLUSION:\n(1) Ann is a knight", True) is None
    assert read("x</think>Conclusion:\n(1) Ann is a knave (2)\n(1) Ann is a knight\n(2) Bob is a knave", True) == [False, False]
    five = one(spark, ([True] * 5,), puzzles.other_labels(F.col("v")), schema="v array<boolean>")[0]
    assert len({tuple(v) for v in five}) == 31 and [True] * 5 not in five


def common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def best_window(s, t, cutoff):
    """Every window tried."""
    if not s or not t:
        return 0.0, 0
    if s in t:
        return 100.0, t.find(s)

    def best(needle, text):
        places = range(1 - len(needle), len(text))
        windows = [(max(0, i), min(len(text), i + len(needle))) for i in places]
        scores = [(200 * common_subsequence(needle, text[a:b]) / (len(needle) + b - a), -a) for a, b in windows]
        return max(scores)

    found = []
    if len(s) <= len(t):
        score, at = best(s, t)
        found.append((score, -at))
    if len(s) >= len(t):
        found.append((best(t, s)[0], 0))
    score, at = max(found, key=lambda x: x[0])
    return (score, at) if score >= cutoff and score > 0 else (0.0, 0)


def test_alignment_tries_all_windows():
    rng = random.Random(6)
    pairs = []
    for _ in range(30):
        letters = "abcde \u00e9"[: rng.choice([2, 4, 7])]
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))
        shorts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 100))) for _ in range(3)]
        x = list(t[len(t) // 3 : len(t) // 3 + 70])
        for _ in range(min(3, len(x))):
            x[rng.randrange(len(x))] = "z"
        pairs.append(([*shorts, "".join(x)], t))
    for cutoff in (0, 70.0):
        got = alignment.align(pairs, cutoff)
        want = [[best_window(s, t, cutoff) for s in shorts] for shorts, t in pairs]
        assert got == [[(pytest.approx(a), b) for a, b in w] for w in want]
    long = "".join(rng.choice("abcdef") for _ in range(700))  # needles of more words than are counted at once
    other = "x" * 50 + long[:300] + "yy" + long[300:] + "x" * 60
    (((score, at),),) = alignment.align([([long], other)], 50.0)
    assert (score, at) == best_window(long, other, 50.0)


def test_alignment_of_rows(spark):
    df = spark.createDataFrame([(1, [f"unit number {i} of many" for i in range(150)], "unit number 7 of many, unit number 99 of Many"), (2, None, "x"), (3, [None, "abc"], None)], "k int, s array<string>, t string")
    got = {(r["k"], r["m"]["at"]): (r["m"]["score"], r["m"]["start"]) for r in alignment.aligned(df, "s", "t", 90.0, "m", chunk=40).collect()}
    assert len(got) == 152 and got[1, 7] == (100.0, 0) and got[1, 99] == (pytest.approx(100 * 42 / 44), 23) and got[3, 0] == got[3, 1] == (0.0, 0)
    before = "The first long sentence is here. The second long sentence is there. The third long sentence ends it."
    after = "The third long sentence ends it. The first long sentence is here. The second long sentence is there."
    rows_ = spark.createDataFrame([(1, before, after, ["The 3rd long sentence ends it.", "short"]), (2, before, after, ["The first long sentence is here."])], "k int, a string, b string, s array<string>")
    assert {r["k"]: r["hoisted"] for r in alignment.hoisted(rows_, ["k"], "a", "b", "s").collect()} == {1: 1, 2: 0}
    assert sorted(map(tuple, alignment.lexical_match(rows_, ["k"], "a", "b").collect())) == [(1, 3, 3), (2, 3, 3)]


def longest_rise(v):
    best = [0] * len(v)
    for i in range(len(v)):
        best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
    return max(best, default=0)


def test_rises(spark):
    rng = random.Random(6)
    lists = [[rng.randint(0, 9) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    got = rows(spark, list(enumerate(lists)), "i int, v array<int>").select("i", ordered.rise(F.col("v")).alias("n")).collect()
    assert [r["n"] for r in sorted(got)] == [longest_rise(v) for v in lists]


def test_rises_of_a_hot_key(spark):
    rng = random.Random(9)
    data = [("hot", i, float(v)) for i, v in enumerate(rng.choice([rng.randrange(2000), i // 2, 7, -i]) for i in range(2700))]
    data += [("small", i, float(i % 5)) for i in range(40)] + [(None, 1, 3.0), (None, 2, 4.0), ("hot", 9999, None), ("one", 5, float("nan")), ("equal", 1, 2.0), ("equal", 2, 2.0)]
    df = rows(spark, data, "k string, i long, v double").repartition(5)
    want = {}
    for k in ("hot", "small", None, "equal"):
        values = [v for kk, _, v in sorted(data, key=lambda x: x[1]) if kk == k and v is not None]
        want[k] = (len(values), longest_rise(values))
    for block in (100_000, 700):
        got = {r["k"]: (r["n"], r["longest"]) for r in rises.longest_rises(df, "k", ["i"], "v", block).collect()}
        assert got == want, block
    assert rises.longest_rises(df.limit(0), "k", ["i"], "v").count() == 0


def test_later_copies_go_where_they_are_sentences(spark):
    s = "The answer has to be even."
    cases = [
        (f"We see. {s}", f"{s} We see. {s}", [s], f"{s} We see.", 1, 0),
        (f"We see. {s}", f"{s} We see that {s[:-1]} or not.", [s[:-1]], None, 0, 1),
        (f"{s} {s}", f"{s} {s}", [s], None, 0, 0),
        (s, f"{s} So, we know {s} {s} End.", [s, s], f"{s} End.", 2, 0),  # a lead-in goes too
        (s, f"{s} Since one two three four five {s}", [s], None, 0, 1),
        (s, f"{s}\n\n{s}\n\nNext.", [s], f"{s}\n\nNext.", 1, 0),
        (f"x {s[:-1]}! y", f"{s[:-1]}. {s[:-1]}! (Then) z", [s[:-1]], f"{s[:-1]}. (Then) z", 1, 0),
        (s, f"{s} Well {s[:-1]}.5 {s}", [s[:-1]], None, 0, 2),
        (s, f"{s} Well {s[:-1]}.5 is. {s}", [s[:-1]], f"{s} Well {s[:-1]}.5 is.", 1, 1),
        ("a \\E b is never an easy thing.", "a \\E b is never an easy thing. a \\E b is never an easy thing.", ["a \\E b is never an easy thing."], "a \\E b is never an easy thing.", 1, 0),
        (s, f"{s} {s}", ["short", None, "not in the first text at all"], None, 0, 0),
        (None, None, None, "", 0, 0),
    ]
    df = rows(spark, [(i, a, b, c) for i, (a, b, c, *_) in enumerate(cases)], "i int, a string, b string, c array<string>")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", copies.without_copies(F.col("a"), F.col("b"), F.col("c")).alias("x")).collect()}
    assert got == {i: (b if want is None else want, removed, left) for i, (_, b, _, want, removed, left) in enumerate(cases)}


def test_statistics(spark):
    from math import comb

    got = rows(spark, [(a, b) for a in range(12) for b in range(12)], "a int, b int").select("a", "b", stats.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    for r in got:
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        assert r["p"] == pytest.approx(min(1, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n) if n else 1)
    known = {10: 2.228, 20: 2.086, 30: 2.042, 60: 2.000, 120: 1.980, 1000: 1.962}
    t = rows(spark, [(k,) for k in known], "d int").select("d", stats.t_point(F.col("d")).alias("t")).collect()
    assert all(r["t"] == pytest.approx(known[r["d"]], abs=6e-4) for r in t)


def test_bootstrap_against_plain_loops(spark):
    rng = random.Random(5)
    data = [(f"s{rng.randrange(9)}", i, rng.uniform(-3, 9) if i % 10 else None) for i in range(240)]
    df = rows(spark, data, "s string, k long, v double").repartition(4)
    hashes = {r["k"]: (r["hs"], r["hk"]) for r in df.select("k", F.xxhash64("s").alias("hs"), F.xxhash64("k").alias("hk")).collect()}
    draws, seed = 37, 11
    top, below = {}, {}
    for s, k, v in data:
        if v is not None:
            w = assembly.poisson_weights(draws, seed, *hashes[k])
            a, b = top.get(hashes[k][0], (0, 0))
            top[hashes[k][0]] = (a + w, b + w * v)
    for d in range(draws):
        parts = [(assembly.poisson_weights(draws, seed, s)[d], b[d] / a[d]) for s, (a, b) in top.items() if a[d]]
        below[d] = sum(w * m for w, m in parts) / sum(w for w, _ in parts) if sum(w for w, _ in parts) else None
    for held in (2, 64):
        got = {r["draw"]: r["mean"] for r in assembly.bootstrap(df, "s", "k", "v", draws, seed, held).collect()}
        assert got == {d: None if m is None else pytest.approx(m) for d, m in below.items()}


def test_bootstrap_means_spread_about_the_mean(spark):
    got = [r["mean"] for r in catalog.QUERIES["st13_bootstrap"](spark, "/root/testdata/sf0.01").collect()]
    draws = [m for m in got if m is not None]  # five strata all have weight 0 in one draw of 150
    per = spark.read.parquet("/root/testdata/sf0.01/events.parquet").groupBy("user_id").agg(F.avg("value").alias("v")).withColumn("s", F.col("user_id") % 5)
    means = np.array([r["m"] for r in per.groupBy("s").agg(F.avg("v").alias("m")).collect()])
    assert len(got) == 200 and len(draws) >= 190 and abs(np.mean(draws) - means.mean()) < 3 * np.std(draws) / 190**0.5 + 0.2
    assert 0.3 * means.std() / 5**0.5 < np.std(draws) < 4 * means.std() / 5**0.5 + 2
    weights = assembly.poisson_weights(200_000, 1, 2)
    assert abs(weights.mean() - 1) < 0.02 and abs(weights.var() - 1) < 0.03 and weights.max() >= 7


def test_corrupted_vectors_are_never_the_truth(spark):
    pool = rows(spark, [(i, [bool(i >> b & 1) for b in range(3)] if i % 10 else None) for i in range(200)], "id long, labels array<boolean>")
    levels = {p: {r["id"]: r for r in assembly.corrupted(pool, "id", "labels", p, 3).collect()} for p in (30, 50)}
    bad = {p: {i for i, r in v.items() if r["corrupted"]} for p, v in levels.items()}
    assert len(bad[30]) == 54 and len(bad[50]) == 90 and bad[30] < bad[50]
    for i in bad[30]:
        assert levels[30][i]["released"] != levels[30][i]["labels"] and levels[30][i]["released"] == levels[50][i]["released"]
    assert all(r["released"] == r["labels"] for i, r in levels[30].items() if i not in bad[30])


def test_retry_budget(spark):
    values = [(i, a, "t", False, None, False) for i in range(5) for a in range(4)]
    df = rows(spark, values, "id long, attempt int, text string, agrees boolean, judged boolean, too_long boolean")
    got = {r["id"]: (r["verdict"], r["attempts"]) for r in assembly.final_verdicts(df, "id", "attempt", 3, 6).collect()}
    assert got == {0: ("wrong_answer", 3), 1: ("wrong_answer", 2), 2: ("wrong_answer", 2), 3: ("wrong_answer", 2), 4: ("wrong_answer", 2)}


def test_pilot_and_quantiles_take_no_row_twice(spark):
    df = rows(spark, [(i, i % 7) for i in range(100)], "k long, n long")
    got = ordered.pilot(df, "k", "n", 20).collect()
    assert len({r["k"] for r in got}) == 20 and sum(r["part"] == "even" for r in got) == 10
    q = ordered.quantile_rows(rows(spark, [], "k string, v double"), "k", "v", {"m": F.floor(F.col("n") / 2)})
    assert q.count() == 0


def test_torn_files_and_settings(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "a"}\n\n{"k": 2, "v": "b"}\n{"k": 1, "v": "c"}\n{"k": 3, "v"')
    path = str(tmp_path / "a.jsonl")
    assert runs.torn_lines(spark, path, "k long, v string").collect()[0].asDict() == {"lines": 4, "torn": 1}
    done, left = runs.resumed(spark, path, rows(spark, [(i,) for i in range(4)], "k long"), "k", "k long, v string")
    assert sorted(r["k"] for r in done.collect()) == [1, 2] and sorted(r["k"] for r in left.collect()) == [0, 3]
    settings = runs.read_settings("data:\n  path: 'a b'\n  sizes: [1, 2.5]\n# note\nmodel:\n  deep:\n    on: true\n  names:\n    - x\n    - y\nk: ~\n")
    assert settings == {"data": {"path": "a b", "sizes": [1, 2.5]}, "model": {"deep": {"on": True}, "names": ["x", "y"]}, "k": None}
    assert one(spark, "t0.7_k4_s0_e100.jsonl", *runs.name_parameters(F.col("t")).values()) == (0.7, 4, 0, 100)


def test_settings_of_lists_and_maps():
    text_ = "runs:\n  - name: a\n    size: [1, 9]\n    at:\n      - x\n      - 'y: z'\n  -\n    name: b\n  - - 1\n    - 2\nlast:\n- 1\n- deep:\n    k: v\nnone:\nurl: http://x:1/y # why\n"
    want = {"runs": [{"name": "a", "size": [1, 9], "at": ["x", "y: z"]}, {"name": "b"}, [1, 2]], "last": [1, {"deep": {"k": "v"}}], "none": None, "url": "http://x:1/y"}
    assert runs.read_settings(text_) == want and runs.read_settings("# nothing\n") == {}


def test_arrays_of_any_layout(spark, tmp_path):
    for name, body in (("a", '[{"v": [1, 2]},\n {"v": []}]'), ("b", '[\n{"v": [3]}\n]\n'), ("c", "[]")):
        (tmp_path / name).write_text(body)
    path = str(tmp_path)
    for by_line in (True, False):
        got = runs.read_json_array(spark, path, "v array<int>", by_line).collect()
        assert sorted((r["idx"], r["v"]) for r in got) == [(0, [1, 2]), (1, []), (2, [3])]
    df = rows(spark, [(i, f"x]{i}") for i in range(500)], "k int, t string").repartition(7)
    sinks.write_json_array(df, f"{path}/out", "k")
    back = runs.read_json_array(spark, f"{path}/out", "k int, t string").collect()
    assert sorted(map(tuple, back)) == [(i, i, f"x]{i}") for i in range(500)]
    sinks.write_json_array(df.limit(0), f"{path}/none", "k")
    assert runs.read_json_array(spark, f"{path}/none", "k int, t string").count() == 0


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "a.json").write_text("".join(f'{{"k": {i % 3}, "v": {i}}}\n' for i in range(3000)))
    (tmp_path / "b.json").write_text('{"k": 0, "v": -1}\n')
    found = runs.last_per_key(runs.with_place(spark.read.schema("k int, v int").json(str(tmp_path))), "k", "place")
    assert sorted((r["k"], r["v"]) for r in found.collect()) == [(0, -1), (1, 2998), (2, 2999)]


def test_tokens_of_pieces_are_those_of_texts(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    own = tokens.encoder(path, pattern)
    c = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "text")
    c = c.union(rows(spark, [(-1, None), (-2, ""), (None, "it's  1 to 3\n\n "), (-3, "same word " * 900), (-3, "é" * 99)], "conv_id long, text string"))
    want = {}
    for r in c.collect():
        want[r["conv_id"]] = want.get(r["conv_id"], 0) + len(own.encode_ordinary(r["text"] or ""))
    got = {r["conv_id"]: r["tokens"] for r in tokens.token_counts(c, ["conv_id"], "text", path, pattern).collect()}
    assert got == want
    again = {r["conv_id"]: r["tokens"] for r in tokens.token_counts(c, ["conv_id"], "text", path, pattern, most=10**6).collect()}
    assert again == want
    words = rows(spark, [("the",), ("waiting",), ("zzqqjx",), (None,), ("",)], "w string")
    for r in tokens.resolved(words, "w", path, pattern).collect():
        ids = own.encode_ordinary(r["w"] or "")
        assert r["token_id"] == (ids[0] if len(ids) == 1 else None)


def test_sidecar_of_another_length_fails(spark):
    root = scratch(spark)
    sinks.write_json_array(rows(spark, [(i,) for i in range(3)], "a long"), f"{root}/a", "a")
    sinks.write_json_array(rows(spark, [(i,) for i in range(2)], "a long"), f"{root}/b", "a")
    with pytest.raises(Exception, match="differ in number"):
        runs.with_sidecar(spark, f"{root}/a", f"{root}/b", "a long", "a long").withColumnRenamed("a", "x").toDF("idx", "x", "y").collect()


def test_a_defense_that_changes_more_than_outputs_fails(spark):
    class Bad:
        def apply(self, t):
            return t.withColumn("instruction", F.lit("x"))

        def metadata(self):
            return {}

    with pytest.raises(Exception, match="outputs alone"):
        extend.applied(Bad(), traces(spark.read.parquet(f"{SF}/documents.parquet"))).collect()
