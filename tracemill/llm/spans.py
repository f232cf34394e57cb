"""Regular-expression matches with their places, as array columns: {kind, start, end, m}, code points, end exclusive.

A list of n spans takes about n ** (4/3) steps at most, whatever the operation: running values are worked out in blocks,
overlaps by sorting, and no place in a long text is looked up from the text's beginning for each span.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<kind:int,start:int,end:int,m:string>>"
FAR = 2**31 - 1


def none() -> Column:
    return F.array().cast(SPANS)


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def blocks(items: Column, size: Column) -> Column:
    """items in consecutive arrays of `size`; none for an empty array."""
    starts = F.filter(F.sequence(F.lit(0), F.size(items), size), lambda i: i < F.size(items))
    return F.transform(starts, lambda i: F.slice(items, i + 1, size))


def running(values: Column, add, zero: int) -> Column:
    """add folded over each value and those before it, for an array of integers and an associative add."""

    def listed(items: Column, begin: Column, value) -> Column:
        """The folds before each item, and the one after all."""
        start = F.struct(begin.alias("at"), F.array(begin).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = add(acc["at"], value(x))
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(items, start, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        own = lambda p: F.aggregate(p, F.lit(zero), add)
        bases = listed(parts, F.lit(zero), own)
        each = F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda p, b: F.slice(listed(p, b, lambda x: x), 2, F.size(p)))
        return F.flatten(each)

    size = lambda v: F.greatest(F.ceil(F.cbrt(F.size(v))).cast("int"), F.lit(32))
    return let(values, lambda v: let(blocks(v, size(v)), whole))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _most(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def _fewest(a: Column, b: Column) -> Column:
    return F.least(a, b)


def found(text: Column, pattern: str, kind: int, worth: Column | None = None, around: int = 0) -> Column:
    """Leftmost non-overlapping matches of pattern in text; worth: a cheap test that is true wherever one can be.

    The pieces between matches, from a split, give the places. around: if given, each span also has `before` and
    `after`, up to so many characters on either side, but no farther than the match before and the match after.
    """

    def placed(x: Column) -> Column:
        n = F.size(x["m"])
        steps = F.zip_with(x["m"], F.slice(x["gaps"], 1, n), lambda m, gap: F.length(gap) + F.length(m))
        ends = running(steps, _plus, 0)

        def span(m: Column, end: Column) -> list[Column]:
            return [F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("m")]

        plain = F.zip_with(x["m"], ends, lambda m, end: F.struct(*span(m, end)))
        if not around:
            return plain
        left = F.zip_with(F.concat(F.array(F.lit("")), F.slice(x["m"], 1, n - 1)), F.slice(x["gaps"], 1, n), lambda m, gap: F.right(F.concat(F.right(m, F.lit(around)), F.right(gap, F.lit(around))), F.lit(around)))
        right = F.zip_with(F.slice(x["gaps"], 2, n), F.concat(F.slice(x["m"], 2, n), F.array(F.lit(""))), lambda gap, m: F.left(F.concat(F.left(gap, F.lit(around)), F.left(m, F.lit(around))), F.lit(around)))
        sides = F.zip_with(left, right, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        return F.zip_with(
            plain, sides, lambda s, c: F.struct(s["kind"], s["start"], s["end"], s["m"], c["before"], c["after"])
        )

    both = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")
    )
    empty = F.array().cast(SPANS[:-2] + ",before:string,after:string>>") if around else none()
    spans = let(both, lambda x: F.when(F.size(x["m"]) > 0, placed(x)).otherwise(empty))
    return spans if worth is None else F.when(worth, spans).otherwise(empty)


def apart(spans: Column, others: Column) -> Column:
    """Those spans that overlap none of the others, by start."""

    def kept(both: Column) -> Column:
        ends = running(F.transform(both, lambda x: F.when(x["own"], -1).otherwise(x["s"]["end"])), _most, -1)
        back = F.transform(F.reverse(both), lambda x: F.when(x["own"], FAR).otherwise(x["start"]))
        begins = F.reverse(running(back, _fewest, FAR))
        clear = F.zip_with(
            both,
            F.zip_with(ends, begins, lambda e, b: F.struct(e.alias("e"), b.alias("b"))),
            lambda x, y: F.struct(x["s"].alias("s"), (x["own"] & (y["e"] <= x["start"]) & (y["b"] >= x["s"]["end"])).alias("clear")),
        )
        return F.transform(F.filter(clear, lambda x: x["clear"]), lambda x: x["s"])

    tagged = lambda a, own: F.transform(
        a, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s.alias("s"))
    )
    both = F.sort_array(F.concat(tagged(spans, True), tagged(others, False)))
    clear = lambda own: F.when(F.size(others) == 0, own).otherwise(let(both, kept))
    return F.when(F.size(spans) == 0, none()).otherwise(clear(spans))


def first_of_overlapping(spans: Column) -> Column:
    """spans by start, without those that overlap one kept before."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["m"])))

    def greedy(run: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.slice(run, 1, 0).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            new = s["start"] >= acc["at"]
            return F.struct(
                F.when(new, s["end"]).otherwise(acc["at"]).alias("at"),
                F.when(new, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"),
            )

        return F.when(F.size(run) == 1, run).otherwise(F.aggregate(run, begin, step, lambda acc: acc["out"]))

    def kept(sorted_: Column) -> Column:
        n = F.size(sorted_)
        ends = running(F.transform(sorted_, lambda s: s["end"]), _most, 0)
        behind = F.zip_with(
            F.concat(F.array(F.lit(0)), F.slice(ends, 1, n - 1)),
            F.zip_with(sorted_, F.sequence(F.lit(1), n), lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"))),
            lambda e, x: F.when(x["start"] >= e, x["i"]),
        )
        heads = F.array_compact(behind)  # spans behind all ends before them: what was kept before does not matter there
        runs = lambda h: F.zip_with(h, F.concat(F.slice(h, 2, n), F.array(n + 1)), lambda a, b: F.slice(sorted_, a, b - a))
        out = F.flatten(F.transform(let(heads, runs), greedy))
        return F.transform(out, lambda s: F.struct(s["kind"], s["start"], s["end"], s["m"]))

    return F.when(F.size(spans) == 0, none()).otherwise(let(ordered, kept)).cast(SPANS)


def text_of(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def replaced(text: Column, spans: Column, kinds: list[str]) -> Column:
    """text with each span put in the form <KIND>; of overlapping spans, the first that starts names the union.

    The text is cut once for each block of spans, and a block's piece once for each of its spans.
    """
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in kinds])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def cuts(sorted_: Column) -> Column:
        """{at, start, end, kind}: the text from `at` to `start`, then the name if start is not below at."""
        ends = running(F.transform(sorted_, lambda s: s["end"]), _most, 0)
        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        return F.zip_with(
            sorted_, before, lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        )

    def block(part: Column) -> Column:
        low = F.get(part, F.lit(0))["at"]
        high = F.greatest(low, F.element_at(part, -1)["start"])

        def joined(piece: Column) -> Column:
            one = lambda c: F.when(
                c["start"] >= c["at"],
                F.concat(piece.substr(c["at"] - low + 1, c["start"] - c["at"]), F.get(names, c["kind"])),
            ).otherwise("")
            return F.array_join(F.transform(part, one), "")

        return let(text.substr(low + 1, high - low), joined)

    def whole(all_cuts: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(all_cuts))).cast("int")
        last = F.greatest(F.element_at(all_cuts, -1)["at"], F.element_at(all_cuts, -1)["end"])
        pieces = F.transform(blocks(all_cuts, size), block)
        return F.concat(F.array_join(pieces, ""), text.substr(last + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(let(ordered, cuts), whole))
