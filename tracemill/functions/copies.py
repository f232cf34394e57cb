"""Later copies of sentences: taken out where they are sentences of their own, counted where they are not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import MIN_UNIT_CHARS, let, strip

_BEGINS = r"\n[ \t]*|[.!?][\"')\]]?[ \t]+"
_LEAD_IN = r"(?:[A-Za-z]+,?[ \t]+){0,4}\z"
_ENDS = r"[.!?][\"')\]]?\z"


def _literal(s: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, s: Column) -> Column:
    """How often text holds s, copies that overlap an earlier one not counted."""
    return F.size(F.split(text, _literal(s), -1)) - 1


def without_copies(first: Column, second: Column, subs: Column) -> Column:
    """{text, removed, left}: second without the copies of sub-conclusions that it holds more often than first does.

    The first copy of each stays, in second as a whole. A later one goes if it is a sentence of its own: it begins one,
    but for a lead-in of at most four plain words, which goes too, and a full stop ends it. `removed` counts those, `left`
    the later ones inside of other sentences that were passed while there were copies too many. Sub-conclusions of under
    20 characters, or that first does not hold, are let alone. Null texts are empty; null subs are none.
    """
    first, second = (F.coalesce(c, F.lit("")) for c in (first, second))
    wanted = F.array_distinct(F.transform(F.filter(F.coalesce(subs, F.array().cast("array<string>")), lambda x: x.isNotNull()), strip))
    kind = "struct<text:string,removed:int,left:int>"

    def one(acc: Column, s: Column) -> Column:
        def scan(x: Column) -> Column:
            pieces, spare = x["pieces"], x["spare"]
            start = F.struct(F.get(pieces, F.lit(0)).alias("text"), spare.alias("spare"), acc["removed"].alias("removed"), acc["left"].alias("left"))

            def step(a: Column, i: Column) -> Column:
                behind = F.get(pieces, i + 1)
                mark = F.when(s.rlike(r"[.!?]\z") | ~behind.rlike(r"\A[.!?]"), "").otherwise(F.left(behind, F.lit(1)))
                rest = F.substr(behind, F.length(mark) + 1)
                last = i + 2 == F.size(pieces)
                before = F.concat(F.right(s, F.lit(2)), F.get(pieces, i))
                own = before.rlike(f"(?:{_BEGINS}){_LEAD_IN}") & F.concat(s, mark).rlike(_ENDS) & (rest.rlike(r"\A\s") | last & (rest == ""))
                later = (i > 0) & (a["spare"] > 0)

                def cut(c: Column) -> Column:
                    tail = F.ltrim(c["rest"], F.lit(" \t"))
                    ended = last & (tail == "") | F.startswith(tail, F.lit("\n"))
                    head = F.regexp_replace(a["text"], rf"(\A|{_BEGINS}){_LEAD_IN}", "$1")
                    head = F.when(ended, F.rtrim(head, F.lit(" \t"))).otherwise(head)
                    lines = F.endswith(head, F.lit("\n")) & F.startswith(tail, F.lit("\n"))
                    return F.concat(head, F.when(lines, F.ltrim(tail, F.lit("\n"))).otherwise(tail))

                return let(
                    F.struct((later & own).alias("goes"), later.alias("later"), rest.alias("rest"), behind.alias("behind")),
                    lambda c: F.struct(
                        F.when(c["goes"], cut(c)).otherwise(F.concat(a["text"], s, c["behind"])).alias("text"),
                        (a["spare"] - c["goes"].cast("int")).alias("spare"),
                        (a["removed"] + c["goes"].cast("int")).alias("removed"),
                        (a["left"] + (c["later"] & ~c["goes"]).cast("int")).alias("left"),
                    ),
                )

            done = F.aggregate(F.sequence(F.lit(0), F.size(pieces) - 2), start, step)
            return let(done, lambda d: F.struct(d["text"].alias("text"), d["removed"].alias("removed"), d["left"].alias("left")))

        known = F.when(F.length(s) >= MIN_UNIT_CHARS, occurrences(first, s)).otherwise(0)
        found = F.struct(F.split(acc["text"], _literal(s), -1).alias("pieces"), known.alias("known"))
        spare = lambda x: F.when(x["known"] > 0, F.size(x["pieces"]) - 1 - x["known"]).otherwise(0)
        too_many = let(found, lambda x: F.struct(x["pieces"].alias("pieces"), spare(x).alias("spare")))
        return let(too_many, lambda x: F.when(x["spare"] > 0, scan(x)).otherwise(acc))

    start = F.struct(second.alias("text"), F.lit(0).alias("removed"), F.lit(0).alias("left")).cast(kind)
    return F.aggregate(wanted, start, one)
