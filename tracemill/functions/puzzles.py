"""Answers of knight-and-knave puzzles: labels read from texts, criteria, rewards and formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, strip

#: The marks of a conclusion, of a final channel, and what ends an answer for the published criterion.
CONCLUSIONS = ["CONCLUSION:", "Conclusion:", "conclusion:"]
STOPS = ["### Reason", "Let's think step by step again", "let's go back and check", "###"]
FINAL_CHANNEL = "<|channel|>final<|message|>"
HEADING = r"(?i)[*_`#\s]*conclusion[*_`]*\s*:"


def final_part(text: Column, reasoning: bool) -> Column:
    """What a reasoning model writes behind its last </think>, null if it never gets there; else the text."""
    return F.when(F.contains(text, F.lit("</think>")), F.substring_index(text, "</think>", -1)) if reasoning else text


def parse_labels(text: Column, names: Column, reasoning: bool = False) -> Column:
    """For each name whether the last conclusion calls it a knight (true) or a knave; null unless each has just one label.

    Numbered lines (1) to (n) are read, of equal numbers the first; without any, what stands before the first empty line.
    """
    plain = F.lower(F.regexp_replace(final_part(text, reasoning), "[*_`]", ""))
    tails = F.split(plain, r"conclusion\s*:", -1)

    def read(tail: Column) -> Column:
        lines = F.filter(F.split(tail, "\n"), lambda x: x.rlike(r"\([0-9]+\)"))
        items = F.transform(lines, lambda x: F.struct(
            F.regexp_extract(x, r"\(([0-9]+)\)", 1).try_cast("int").alias("i"), F.regexp_extract(x, r"\([0-9]+\)(.*)", 1).alias("line")))
        of = lambda i: F.coalesce(F.get(F.filter(items, lambda y: y["i"] == i), F.lit(0))["line"], F.lit(""))
        numbered = F.array_join(F.transform(F.sequence(F.lit(1), F.size(names)), of), " ")
        whole = F.when(F.size(lines) > 0, numbered).otherwise(F.get(F.split(strip(tail), r"\n\s*\n", 2), F.lit(0)))

        def label(t: Column, name: Column) -> Column:
            quoted = F.concat(F.lit(r"\Q"), F.lower(name), F.lit(r"\E"))
            said = F.array_distinct(F.regexp_extract_all(t, F.concat(F.lit(r"\b"), quoted, F.lit(r"\s+is\s+(?:a\s+)?(knight|knave)\b")), F.lit(1)))
            return F.when(F.size(said) == 1, said[0] == "knight")

        labels = lambda t: F.transform(names, lambda n: label(t, n))
        return let(let(whole, labels), lambda x: F.when(~F.exists(x, lambda y: y.isNull()), x))

    return F.when(F.size(tails) > 1, let(F.element_at(tails, -1), read))


def strict_correct(text: Column, names: Column, solution: Column, reasoning: bool = False) -> Column:
    """All labels are read and right."""
    return F.coalesce(parse_labels(text, names, reasoning) == solution, F.lit(False))


def published_correct(text: Column, solution_text: Column, reasoning: bool = False) -> Column:
    """The text behind the first mark of a conclusion, up to a stop, holds every part of the solution, no item beyond
    them and no "if"."""
    part = final_part(text, reasoning)
    behind = [F.when(F.contains(part, F.lit(c)), F.substr(part, F.locate(c, part) + len(c))) for c in CONCLUSIONS]
    said = F.coalesce(*[F.nullif(b, F.lit("")) for b in behind])
    gold = F.transform(F.split(F.replace(F.replace(solution_text, F.lit(" and ")), F.lit(".")), ","), strip)
    for stop in STOPS:
        said = F.substring_index(said, stop, 1)

    def judged(x: Column) -> Column:
        beyond = F.concat(F.lit("("), (F.size(x["gold"]) + 1).cast("string"), F.lit(")"))
        bad = F.contains(x["said"], beyond) | F.contains(x["said"], F.lit("if"))
        return ~bad & F.forall(x["gold"], lambda g: F.contains(x["said"], g))

    return F.coalesce(let(F.struct(said.alias("said"), gold.alias("gold")), lambda x: F.when(x["said"].isNotNull(), judged(x))), F.lit(False))


def share_right(labels: Column, solution: Column) -> Column:
    """Share of labels that are right; 0 if none could be read."""
    same = F.filter(F.zip_with(labels, solution, lambda a, b: a == b), lambda x: x)
    return F.when(labels.isNull(), 0.0).otherwise(F.size(same) / F.size(solution))


def conclusion(names: Column, labels: Column) -> Column:
    """The answer's form: a heading and a numbered line for each name."""
    n = F.sequence(F.lit(1), F.size(names))
    rows = F.zip_with(F.zip_with(names, labels, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), n, lambda x, i: F.concat(
        F.lit("("), i.cast("string"), F.lit(") "), x["a"], F.lit(" is a "), F.when(x["b"], "knight").otherwise("knave"), F.lit("\n")))
    return F.concat(F.lit("CONCLUSION:\n"), F.array_join(rows, ""))


def hint_text(names: Column, labels: Column) -> Column:
    """The note that gives the identities away."""
    said = F.zip_with(names, labels, lambda a, b: F.concat(a, F.lit(" is a "), F.when(b, "knight").otherwise("knave")))
    return F.concat(F.lit("\n(The correct identities are: "), F.array_join(said, ", "), F.lit(". Show the reasoning that leads to them.)"))


def teacher_conclusion(text: Column, people: Column) -> Column:
    """The last conclusion behind the scratchpad, up to the line with which as many numbers have been seen as there are
    people; null without it."""
    part = final_part(text, True)
    n = F.length(part) - F.length(F.element_at(F.split(part, HEADING, -1), -1))
    heading = F.element_at(F.regexp_extract_all(part, F.lit(HEADING), F.lit(0)), -1)
    tail = strip(F.substr(part, n - F.length(heading) + 1))

    def cut(lines: Column) -> Column:
        number = F.transform(lines, lambda x: F.nullif(F.regexp_extract(x, r"^\s*[*_]*\(([0-9]+)\)", 1), F.lit("")))
        seen = lambda i: F.size(F.array_distinct(F.array_compact(F.slice(number, F.lit(1), i))))
        ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: seen(i) >= people)
        return F.when(F.size(ends) > 0, strip(F.array_join(F.slice(lines, F.lit(1), F.get(ends, F.lit(0))), "\n")))

    return F.when(part.rlike(HEADING), let(F.split(tail, "\n"), cut))


def split_output(text: Column, channel: bool = False, thinks: bool = True) -> Column:
    """{ended, reasoning, rewrite} of one generation: by its final channel, or by its last </think>."""
    row = lambda e, r, w: F.struct(F.lit(e).alias("ended"), r.alias("reasoning"), w.alias("rewrite"))
    if channel:
        token = r"<\|[a-z_]+\|>"
        head = F.left(text, F.length(text) - F.length(F.substring_index(text, FINAL_CHANNEL, -1)) - len(FINAL_CHANNEL))
        last = strip(F.regexp_replace(F.substring_index(text, FINAL_CHANNEL, -1), token, ""))
        return F.when(F.contains(text, F.lit(FINAL_CHANNEL)), row(True, head, last)).otherwise(row(False, text, strip(F.regexp_replace(text, token, " "))))
    if not thinks:
        return row(True, F.lit(""), text)
    head = F.left(text, F.length(text) - F.length(F.substring_index(text, "</think>", -1)) - len("</think>"))
    return F.when(F.contains(text, F.lit("</think>")), row(True, head, F.substring_index(text, "</think>", -1))).otherwise(row(False, text, text))


def first_answer(text: Column, reach: int = 600) -> Column:
    """Behind the first </think>, up to `reach` characters beyond the first conclusion."""
    part = F.substr(text, F.when(F.contains(text, F.lit("</think>")), F.locate("</think>", text) + 8).otherwise(1))
    at = F.regexp_instr(part, F.lit("(?i)conclusion"))
    return F.when(at > 0, F.left(part, at - 1 + reach)).otherwise(part)


def other_labels(truth: Column) -> Column:
    """All vectors of as many booleans as truth has, but truth itself; their number doubles with each name.

    Vectors of over 20 names would not fit a row; such truths give null.
    """
    n = F.size(truth)
    every = F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2), n).cast("long") - 1)
    vector = lambda v: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.getbit(v, i) == 1)
    return F.when(n.between(1, 20), F.filter(F.transform(every, vector), lambda v: v != truth))
