"""Answers in texts: boxes, final lines, references, and whether two answers are equal, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip, word_count

#: A box with one level of braces inside, and the lines that state a final answer.
BOXED = r"\\boxed\{((?:[^{}]++|\{[^{}]*+\})*+)\}"
FINAL_LINE = r"(?s)Final Answer:\s*The final answer is\s*\$?(.+?)\$?\s*\.\s*I hope"
FINAL_BOX = r"\\boxed\{(?:[^{}]++|\{[^{}]*+\})*+\}\s*(?:\\\]|\$)?\s*\.?\s*$"
SHOWN_ANSWER = r"The answer is\s*([^\n]*)"
SHOWN_NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def boxed(text: Column) -> Column:
    """Contents of all \\boxed{...}, with one level of braces inside."""
    return F.regexp_extract_all(text, F.lit(BOXED), F.lit(1))


def boxed_spans(text: Column) -> Column:
    """{start, content} of each box, places from 0, in order."""
    def placed(x: Column) -> Column:
        gaps = F.transform(x["gaps"], lambda g: F.length(g))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,content:string>>").alias("out"))

        def step(acc: Column, y: Column) -> Column:
            start = acc["at"] + y["gap"]
            item = F.struct(start.alias("start"), y["c"].alias("content"))
            return F.struct((start + F.length(y["m"])).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        rows = F.zip_with(F.zip_with(x["m"], x["c"], lambda m, c: F.struct(m.alias("m"), c.alias("c"))), F.slice(gaps, F.lit(1), F.size(x["m"])),
                          lambda p, g: F.struct(p["m"].alias("m"), p["c"].alias("c"), g.alias("gap")))
        return F.aggregate(rows, begin, step, lambda acc: acc["out"])

    parts = F.struct(
        F.regexp_extract_all(text, F.lit(BOXED), F.lit(0)).alias("m"), boxed(text).alias("c"), F.split(text, BOXED, -1).alias("gaps")
    )
    return let(parts, placed)


def own_answer(text: Column) -> Column:
    """Contents of the boxes that start on the line of the last one, behind the last </think>; null without either."""
    after = F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1))

    def last_line(t: Column) -> Column:
        def kept(spans: Column) -> Column:
            head = F.left(t, F.element_at(spans, -1)["start"])
            line = F.length(head) - F.length(F.substring_index(head, "\n", -1))
            return F.transform(F.filter(spans, lambda s: s["start"] >= line), lambda s: s["content"])

        return let(boxed_spans(t), lambda spans: F.when(F.size(spans) > 0, kept(spans)))

    return let(after, lambda t: F.when(t.isNotNull(), last_line(t)))


def plain(answer: Column) -> Column:
    """An answer without what does not bear on its value: math signs, sizes, text wrappers, units' spaces, commas in numbers."""
    out = F.regexp_replace(answer, r"\\(?:left|right|displaystyle|!|,|;|:|quad|qquad)|\$|\\[()\[\]]|\s+", "")
    out = F.regexp_replace(out, r"\\[dt]frac", r"\\frac")
    out = F.regexp_replace(out, r"\\(?:text|mathrm|textbf|mathbf)\{([^{}]*)\}", "$1")
    out = F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9]{3}(?![0-9]))", "")
    out = F.regexp_replace(out, r"\^\{?\\circ\}?|\\degree|\.$", "")
    return F.regexp_replace(out, r"\\frac([0-9])([0-9])", r"\\frac{$1}{$2}")


def value(answer: Column) -> Column:
    """The number that a plain answer stands for, fractions and percents included; null for others."""
    number = r"(-?[0-9]*\.?[0-9]+)"
    frac = rf"^(-?)\\frac\{{{number}\}}\{{{number}\}}$"
    ratio = rf"^{number}/{number}$"
    part = lambda pattern, i: F.regexp_extract(answer, pattern, i).try_cast("double")
    sign = F.when(F.regexp_extract(answer, frac, 1) == "-", -1.0).otherwise(1.0)
    percent = r"^(-?[0-9]*\.?[0-9]+)\\?%$"
    return (
        F.when(answer.rlike(frac), sign * F.try_divide(part(frac, 2), part(frac, 3)))
        .when(answer.rlike(ratio), F.try_divide(part(ratio, 1), part(ratio, 2)))
        .when(answer.rlike(percent), part(percent, 1) / 100)
        .when(answer.rlike(rf"^{number}$"), answer.try_cast("double"))
    )


def math_equal(a: Column, b: Column, near: float = 1e-4) -> Column:
    """Whether two answers are equal: as plain text whatever the case, or as numbers within a relative `near`, percents
    also against whole numbers. Null or unreadable is equal to nothing; never null."""

    def compared(x: Column) -> Column:
        u, v = x["u"], x["v"]
        close = lambda p, q: F.abs(p - q) <= near * F.greatest(F.abs(p), F.abs(q))
        percent = (F.contains(x["a"], F.lit("%")) != F.contains(x["b"], F.lit("%"))) & (close(u, 100 * v) | close(100 * u, v))
        return (F.lower(x["a"]) == F.lower(x["b"])) | F.coalesce(close(u, v) | percent, F.lit(False))

    def valued(x: Column) -> Column:
        return let(F.struct(x["a"].alias("a"), x["b"].alias("b"), value(x["a"]).alias("u"), value(x["b"]).alias("v")), compared)

    both = F.struct(plain(a).alias("a"), plain(b).alias("b"))
    return F.coalesce(let(both, lambda x: F.when((x["a"] != "") & (x["b"] != ""), valued(x))), F.lit(False))


def _parts(box: Column) -> Column:
    own = F.filter(F.transform(F.split(box, "[,;]"), strip), lambda x: x != "")
    return let(own, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(box)))


def last_parts(text: Column) -> Column:
    """The parts, split at , and ;, of the last box; null without a box."""
    return let(boxed(text), lambda b: F.when(F.size(b) > 0, _parts(F.element_at(b, -1))))


def offered_parts(text: Column) -> Column:
    """The parts of all boxes and the boxes themselves, each once; null without a box."""
    return let(boxed(text), lambda b: F.when(F.size(b) > 0, F.array_distinct(F.concat(F.flatten(F.transform(b, _parts)), b))))


def answers_agree(source: Column, rewrite: Column, equal: Callable[[Column, Column], Column] = math_equal) -> Column:
    """Whether each part of source's last box equals some part or whole of a box of rewrite; null if either has no box."""
    both = F.struct(last_parts(source).alias("g"), offered_parts(rewrite).alias("p"))
    agree = lambda x: F.forall(x["g"], lambda g: F.exists(x["p"], lambda p: equal(g, p)))
    return let(both, lambda x: F.when(x["g"].isNotNull() & x["p"].isNotNull(), agree(x)))


def extract_answer(text: Column, fallback: bool = False) -> Column:
    """The last box's content; with fallback the last number of a text without a box, else null."""
    from .text import last_number

    box = F.try_element_at(boxed(text), F.lit(-1))
    return F.coalesce(box, last_number(text)) if fallback else box


def hash_gold(text: Column) -> Column:
    """What follows the last ####, without commas, dollar signs and trailing points; null if nothing does."""
    tail = strip(F.substring_index(text, "####", -1))
    return F.when(F.contains(text, F.lit("####")), F.nullif(F.rtrim(F.regexp_replace(tail, "[,$]", ""), F.lit(".")), F.lit("")))


def shown_solution(text: Column) -> Column:
    """A completion cut at its first "The answer is" and ended in a box with the first number there; null without one."""
    said = F.regexp_extract(text, SHOWN_ANSWER, 1)
    number = F.replace(F.regexp_substr(said, F.lit(SHOWN_NUMBER)), F.lit(","))
    before = strip(F.substring_index(text, "The answer is", 1))
    end = F.concat(F.lit("The answer is \\boxed{"), number, F.lit("}."))
    return F.when(number.isNotNull() & text.rlike(SHOWN_ANSWER), strip(F.concat_ws(" ", before, end)))


def final_line_solution(text: Column) -> Column:
    """A completion cut before its "Final Answer:" and ended in a box: its own, or that line's answer; null without."""
    body, said = strip(F.substring_index(text, "Final Answer:", 1)), strip(F.regexp_extract(text, FINAL_LINE, 1))
    end = F.concat(body, F.lit("\nThe final answer is $\\boxed{"), said, F.lit("}$."))
    return F.when(F.contains(body, F.lit("\\boxed{")), body).when(said != "", end)


def teacher_reference(trace: Column, raw_answer: Column, forced: Column, forced_answer: Column, extracted: Column) -> Column:
    """The released answer as a box: the last box, but for the word ANSWER, of the trace if it had an answer, else of the
    forced ending, else the extracted answer; empty if neither had one."""
    has = lambda a: a.isNotNull() & ~a.isin("None", "")
    own = lambda t: F.filter(boxed(F.coalesce(t, F.lit(""))), lambda c: F.upper(plain(c)) != "ANSWER")
    shown = lambda t: F.concat(
        F.lit("\\boxed{"), F.coalesce(strip(F.try_element_at(own(t), F.lit(-1))), extracted, F.lit("")), F.lit("}")
    )
    return F.when(has(raw_answer), shown(trace)).when(has(forced_answer), shown(forced)).otherwise("")


def matches_label(answer: Column, label: Column) -> Column:
    """answer equals label; a missing or empty label is matched by nothing."""
    return F.when(F.coalesce(label, F.lit("")) == "", F.lit(False)).otherwise(math_equal(answer, label))


def format_ok(text: Column, mode: str, min_words: int = 0) -> Column:
    """anywhere: a box; final: exactly one, at the end; final_reasoned: as final, behind at least min_words words."""
    t = strip(text)
    n = F.regexp_count(t, F.lit(r"\\boxed\{"))
    if mode == "anywhere":
        return n > 0
    out = (n == 1) & t.rlike(FINAL_BOX)
    return out if mode == "final" else out & (word_count(F.substring_index(t, "\\boxed{", 1)) >= min_words)


def reward_exact(text: Column, label: Column) -> Column:
    return matches_label(extract_answer(text), label).cast("double")


def reward_mix(text: Column, label: Column) -> Column:
    """-1 without a box, 1 for the label, -0.5 for another answer."""
    return F.when(~F.contains(text, F.lit("\\boxed{")), -1.0).when(matches_label(extract_answer(text), label), 1.0).otherwise(-0.5)


def true_or_said(verdict: Column) -> Column:
    """A verdict kept as a boolean or as the text True."""
    return F.coalesce(verdict.cast("string").isin("true", "True"), F.lit(False))


def known(answer: Column) -> Column:
    """Null for what stands for no answer: None as text, and nothing."""
    return F.when(~answer.isin("None", ""), answer)
