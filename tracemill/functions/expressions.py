"""Equality of mathematical answers: expressions become fingerprints, so that equal ones are found by comparing or joining.

An expression in LaTeX or plain writing is read once and worked out at seeded points of two prime fields: letters are
random elements, so two expressions that are the same function have the same values, and others differ but for a chance
of about their degree in 2**80 (Schwartz and Zippel). The primes are one less than a multiple of 8 and of all odd primes up
to 47, so the products of these have square roots, and x ** ((p + 1) / 4) is a root that keeps products. Functions without
a meaning in a field (sin, log, powers with letters) are elements drawn by their name and their argument's values.
Constants have a numeric value besides. Sets, tuples, intervals, unions and equations are made of such fingerprints.
"""

from __future__ import annotations

import hashlib
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import answers

_SMOOTH = 8 * math.prod((3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47))


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _primes(many: int, start: int = 1 << 24) -> list[int]:
    out, k = [], start
    while len(out) < many:
        k += 1
        if _is_prime(k * _SMOOTH - 1):
            out.append(k * _SMOOTH - 1)
    return out


PRIMES = _primes(2)
_TOKEN = re.compile(r"\\[a-zA-Z]+|\\.|[0-9]+(?:\.[0-9]+)?|\.[0-9]+|\S")
_DROPPED = {"\\left", "\\right", "\\displaystyle", "\\,", "\\;", "\\!", "\\:", "\\quad", "\\qquad", "\\ ", "$", "\\(", "\\)", "\\[", "\\]", "\\circ", "\\degree", "°"}
_NAMES = {"\\pi": math.pi, "π": math.pi, "e": math.e}
_FUNCTIONS = {"\\sin": math.sin, "\\cos": math.cos, "\\tan": math.tan, "\\ln": math.log, "\\log": math.log10, "\\exp": math.exp, "\\arctan": math.atan, "\\arcsin": math.asin, "\\arccos": math.acos}
_SIGNS = {"−": "-", "–": "-", "×": "*", "·": "*", "⋅": "*", "\\cdot": "*", "\\times": "*", "\\div": "/", "÷": "/", "\\dfrac": "\\frac", "\\tfrac": "\\frac", "\\lbrace": "\\{", "\\rbrace": "\\}", "∞": "\\infty", "∪": "\\cup", "√": "\\sqrt", "≤": "\\le", "≥": "\\ge", "\\leq": "\\le", "\\geq": "\\ge", "±": "\\pm"}
_MOST = 2_000


class Unreadable(ValueError):
    """What is not an expression."""


class Value:
    """An element of each field, and the number that it is if no letter takes part."""

    __slots__ = ("at", "number")

    def __init__(self, at: tuple[int, ...], number: float | None):
        self.at, self.number = at, number


def _drawn(name: str) -> tuple[int, ...]:
    """Elements that depend on a name alone; squares, so that they have roots."""
    out = []
    for p in PRIMES:
        h = int.from_bytes(hashlib.sha256(f"{p}:{name}".encode()).digest()) % p
        out.append(h * h % p)
    return tuple(out)


def _of(text: str) -> Value:
    whole, _, part = text.partition(".")
    n, d = int((whole or "0") + part), 10 ** len(part)
    return Value(tuple(n * pow(d, -1, p) % p for p in PRIMES), n / d if n < 10**300 else None)


def _numeric(f, *values: Value) -> float | None:
    if any(v.number is None for v in values):
        return None
    try:
        out = f(*(v.number for v in values))
    except (ArithmeticError, ValueError):
        return None
    return out if isinstance(out, float) and math.isfinite(out) else float(out) if isinstance(out, int) else None


def _plus(a: Value, b: Value) -> Value:
    return Value(tuple((x + y) % p for x, y, p in zip(a.at, b.at, PRIMES)), _numeric(lambda x, y: x + y, a, b))


def _times(a: Value, b: Value) -> Value:
    return Value(tuple(x * y % p for x, y, p in zip(a.at, b.at, PRIMES)), _numeric(lambda x, y: x * y, a, b))


def _minus(a: Value) -> Value:
    return Value(tuple(-x % p for x, p in zip(a.at, PRIMES)), None if a.number is None else -a.number)


def _over(a: Value, b: Value) -> Value:
    if not all(b.at):
        raise Unreadable("division by zero")
    return Value(tuple(x * pow(y, -1, p) % p for x, y, p in zip(a.at, b.at, PRIMES)), _numeric(lambda x, y: x / y, a, b))


def _root(a: Value) -> Value:
    return Value(tuple(pow(x, (p + 1) // 4, p) for x, p in zip(a.at, PRIMES)), _numeric(math.sqrt, a))


def _opaque(name: str, f, *values: Value) -> Value:
    return Value(_drawn(f"{name}:{[v.at for v in values]}"), _numeric(f, *values))


def _power(a: Value, b: Value) -> Value:
    if b.number is not None and b.number == int(b.number) and abs(b.number) <= 10_000:
        n = int(b.number)
        if n < 0 and not all(a.at):
            raise Unreadable("division by zero")
        return Value(tuple(pow(x, n, p) for x, p in zip(a.at, PRIMES)), _numeric(lambda x: float(x) ** n, a))
    if b.number is not None and 2 * b.number == int(2 * b.number) and abs(b.number) <= 10_000:
        return _power(_root(a), Value(b.at, 2 * b.number))
    return _opaque("^", lambda x, y: x**y if x > 0 else math.nan, a, b)


class _Reader:
    """Reads one expression by descent. What stands side by side is multiplied, as closely as *."""

    def __init__(self, tokens: list[str]):
        self.tokens, self.at = tokens, 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> str:
        token = self.peek()
        if not token or (wanted and token != wanted):
            raise Unreadable(f"{wanted or 'more'} expected")
        self.at += 1
        return token

    def sum(self) -> Value:
        out = self.product(self.sign())
        while self.peek() in ("+", "-"):
            out = _plus(out, self.product(self.sign()))
        return out

    def sign(self) -> bool:
        """Whether the signs taken are negative together."""
        negative = False
        while self.peek() in ("+", "-"):
            negative ^= self.take() == "-"
        return negative

    def product(self, negative: bool) -> Value:
        out = self.factor()
        while (t := self.peek()) and t not in "+-)]}=,|" and t not in ("\\}", "\\cup"):
            if t == "*":
                self.take()
                out = _times(out, self.signed())
            elif t == "/":
                self.take()
                out = _over(out, self.signed())
            else:
                mixed = self.tokens[self.at - 1].isdigit() and t == "\\frac" and (self.at < 2 or self.tokens[self.at - 2] not in "^/*")
                out = _plus(out, self.factor()) if mixed else _times(out, self.factor())
        return _minus(out) if negative else out

    def signed(self) -> Value:
        negative = self.sign()
        out = self.factor()
        return _minus(out) if negative else out

    def factor(self) -> Value:
        out = self.atom()
        while self.peek() in ("^", "!", "\\%", "%"):
            t = self.take()
            if t == "^":
                if self.peek() == "":
                    break
                power = self.signed() if self.peek() == "-" else self.atom()
                out = _power(out, power)
            elif t == "!":
                out = _opaque("!", lambda x: float(math.factorial(int(x))) if x == int(x) and 0 <= x <= 100 else math.nan, out)
            else:
                out = _over(out, _of("100"))
        return out

    def group(self, close: str) -> Value:
        out = self.sum()
        self.take(close)
        return out

    def argument(self) -> Value:
        """What a command applies to: a group, or the next digit or letter."""
        if self.peek() == "{":
            self.take()
            return self.group("}")
        t = self.peek()
        if t.isdigit() and len(t) > 1:  # \frac12 is one half
            self.tokens[self.at : self.at + 1] = [t[0], t[1:]]
        return self.atom()

    def atom(self) -> Value:
        t = self.take()
        if t[0].isdigit() or (t[0] == "." and len(t) > 1):
            return _of(t)
        if t in ("(", "{", "["):
            return self.group({"(": ")", "{": "}", "[": "]"}[t])
        if t == "|":
            return _opaque("abs", abs, self.group("|"))
        if t == "\\frac":
            above = self.argument()
            return _over(above, self.argument())
        if t == "\\sqrt":
            if self.peek() == "[":
                self.take()
                degree = self.group("]")
                return _power(self.argument(), _over(_of("1"), degree)) if degree.number == 2 else _opaque("root", lambda n, x: x ** (1 / n), degree, self.argument())
            return _root(self.argument())
        if t in _FUNCTIONS:
            return _opaque(t, _FUNCTIONS[t], self.argument() if self.peek() in ("{", "(") else self.product(False))
        if t == "\\infty":
            return Value(_drawn("infinity"), None)
        if t in _NAMES:
            return Value(_drawn(t.replace("π", "\\pi")), _NAMES[t])
        if t.rstrip("'").isalpha() or (t[0] == "\\" and t[1:].isalpha()):
            name = t
            if self.peek() == "_":
                self.take()
                name += "_" + ("".join(self.braced()) if self.peek() == "{" else self.take())
            return Value(_drawn(name), None)
        raise Unreadable(t)

    def braced(self) -> list[str]:
        out, depth = [], 0
        while True:
            t = self.take()
            depth += (t == "{") - (t == "}")
            out.append(t)
            if not depth:
                return out


def _split(tokens: list[str], marks: tuple[str, ...]) -> list[list[str]]:
    """Parts between marks that stand outside of all brackets."""
    out, depth = [[]], 0
    for t in tokens:
        depth += (t in ("(", "[", "{", "\\{")) - (t in (")", "]", "}", "\\}"))
        if depth == 0 and t in marks:
            out.append([])
        else:
            out[-1].append(t)
    return out


def _form(tokens: list[str]) -> tuple[str, float | None]:
    if not tokens or len(tokens) > _MOST:
        raise Unreadable("nothing" if not tokens else "too long")
    if "\\pm" in tokens:
        i = tokens.index("\\pm")
        both = sorted({_form([*tokens[:i], s, *tokens[i + 1 :]])[0] for s in "+-"})
        return "set(" + ",".join(both) + ")", None
    if len(parts := _split(tokens, ("\\cup",))) > 1:
        return "union(" + ",".join(sorted({_form(p)[0] for p in parts})) + ")", None
    if tokens[0] == "\\{" and tokens[-1] == "\\}":
        inner = _split(tokens[1:-1], (",", ";"))
        return "set(" + ",".join(sorted({_form(p)[0] for p in inner if p})) + ")", None
    if tokens[0] in "([" and tokens[-1] in ")]" and len(parts := _split(tokens[1:-1], (",", ";"))) > 1:
        return tokens[0] + ",".join(_form(p)[0] for p in parts) + tokens[-1], None
    if len(parts := _split(tokens, (",", ";"))) > 1:
        return "set(" + ",".join(sorted({_form(p)[0] for p in parts})) + ")", None
    if len(parts := _split(tokens, ("\\in",))) == 2:
        return _form(parts[1])
    if len(parts := _split(tokens, ("=",))) == 2:
        if len(parts[0]) == 1 and parts[0][0].isalpha():
            return _form(parts[1])
        left, right = (_read(p) for p in parts)
        gap = _plus(left, _minus(right))
        if not any(gap.at):
            return "true", None
        # an equation is its difference but for a factor: its values at one point are divided by those at another
        other = [t if t in _NAMES or not t.isalpha() else t + "'" for t in [*parts[0], "-", "(", *parts[1], ")"]]
        again = _read(other)
        return "equation" + str(_over(gap, again).at if all(again.at) else gap.at), None
    value = _read(tokens)
    return str(value.at), value.number


def _read(tokens: list[str]) -> Value:
    reader = _Reader(list(tokens))
    out = reader.sum()
    if reader.peek():
        raise Unreadable(reader.peek())
    return out


def expression(text: str | None) -> tuple[str | None, float | None, bool]:
    """(fingerprint, number, whether a percent sign is in it); nulls for what cannot be read."""
    if text is None:
        return None, None, False
    bare = re.sub(r"(?<=[0-9}])\s*\\(?:text|mathrm|mbox)\{[^{}]*\}\s*\.?\s*$", "", text)
    bare = re.sub(r"\\(?:text|mathrm|textbf|mathbf|mbox)\{([^{}]*)\}", r"\1", bare)
    bare = re.sub(r"(?<=[0-9]),(?:\\!)?(?=[0-9]{3}(?![0-9]))", "", bare).strip().rstrip(".")
    tokens = [_SIGNS.get(t, t) for t in _TOKEN.findall(bare) if t not in _DROPPED]
    tokens = [t for i, t in enumerate(tokens) if not (t == "^" and (i + 1 == len(tokens) or tokens[i + 1 : i + 3] == ["{", "}"]))]
    percent = "%" in bare
    try:
        form, number = _form([t for i, t in enumerate(tokens) if not (t in "{}" and ("{" + "}") in ("".join(tokens[i : i + 2]), "".join(tokens[max(0, i - 1) : i + 1])))])
    except (Unreadable, RecursionError, OverflowError):
        return None, None, percent
    return hashlib.sha256(form.encode()).hexdigest()[:32], number, percent


_KIND = T.StructType([T.StructField("form", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("percent", T.BooleanType())])


@F.pandas_udf(_KIND)
def expression_of(texts: pd.Series) -> pd.DataFrame:
    """{form, number, percent} of each answer; equal forms are equal expressions."""
    return pd.DataFrame([expression(t) for t in texts], columns=["form", "number", "percent"])


@F.pandas_udf(T.ArrayType(_KIND))
def expressions_of(lists: pd.Series) -> pd.Series:
    """expression_of for each answer of an array."""
    return lists.map(lambda ts: None if ts is None else [dict(zip(("form", "number", "percent"), expression(t))) for t in ts])


def same_expression(a: Column, b: Column, near: float = 1e-4) -> Column:
    """Whether two such structs are equal: the same function, or numbers within a relative `near`, percents also against
    whole numbers. What cannot be read is equal to nothing; never null."""
    u, v = a["number"], b["number"]
    close = lambda p, q: F.abs(p - q) <= near * F.greatest(F.abs(p), F.abs(q))
    percent = (a["percent"] != b["percent"]) & (close(u, 100 * v) | close(100 * u, v))
    return F.coalesce((a["form"] == b["form"]), F.lit(False)) | F.coalesce(close(u, v) | percent, F.lit(False))


def math_equal(a: Column, b: Column, near: float = 1e-4) -> Column:
    """Whether two answers are equal as plain text whatever the case, as numbers within `near`, or as expressions."""
    return answers.math_equal(a, b, near) | same_expression(expression_of(a), expression_of(b), near)


def answers_agree(source: Column, rewrite: Column, near: float = 1e-4) -> Column:
    """answers.answers_agree by math_equal: each part of source's last box equals some part or whole of a box of rewrite."""
    gold, offered = answers.last_parts(source), answers.offered_parts(rewrite)
    kind = lambda texts: F.arrays_zip(texts.alias("t"), expressions_of(texts).alias("e"))
    same = lambda g, p: answers.math_equal(g["t"], p["t"], near) | same_expression(g["e"], p["e"], near)
    agree = F.forall(kind(gold), lambda g: F.exists(kind(offered), lambda p: same(g, p)))
    return F.when(gold.isNotNull() & offered.isNotNull(), agree)
