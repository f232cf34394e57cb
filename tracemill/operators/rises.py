"""Longest rising subsequences by key, with keys of any size.

A key's rows, in order, are cut into blocks, and its values into ranges; a tile is what of a block lies in a range. How
long a rise can end at a row depends on rows of the same tile, on what earlier blocks have reached in the same range (a
staircase by value), and on what lower ranges have reached so far (a staircase by place). So tiles of one diagonal
do not depend on each other: they are a round, and hand their staircases on, to the next block and to the next range.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, settled

#: What a row of a tile is: an element (place, value), a step of either staircase (value or place, length), the longest rise.
_ELEMENT, _BY_VALUE, _BY_PLACE, _LONGEST = range(4)


def _step(xs: list[float], ends: list[int], x: float, n: int) -> None:
    """Puts (x, n) into a staircase, along which both rise."""
    at = bisect_left(xs, x)
    if at and ends[at - 1] >= n:
        return
    stop = at
    while stop < len(xs) and ends[stop] <= n:
        stop += 1
    xs[at:stop], ends[at:stop] = [x], [n]


def tile(rows: list[tuple[int, float, float]]) -> tuple[list[tuple[float, int]], list[tuple[float, int]], int]:
    """Of (kind, x, y) of a tile: the staircase by value for the next block, that by place for the next range, the longest
    rise that ends here."""
    by_value: tuple[list[float], list[int]] = ([], [])
    by_place: tuple[list[float], list[int]] = ([], [])
    for kind, x, y in rows:
        if kind != _ELEMENT:
            _step(*(by_value if kind == _BY_VALUE else by_place), x, int(y))
    longest = 0
    onward = [(-1.0, by_value[1][-1])] if by_value[1] else []  # all that earlier blocks have in this range lies below the next
    onward += zip(*by_place)
    reached = lambda stairs, x: stairs[1][at - 1] if (at := bisect_left(stairs[0], x)) else 0
    for _, place, value in sorted(r for r in rows if r[0] == _ELEMENT):
        n = 1 + max(reached(by_value, value), reached(by_place, place))
        _step(*by_value, value, n)
        onward.append((place + 0.5, n))
        longest = max(longest, n)
    following: tuple[list[float], list[int]] = ([], [])
    for place, n in sorted(onward):
        _step(*following, place, n)
    return list(zip(*by_value)), list(zip(*following)), longest


def longest_rises(df: DataFrame, key: str, order: list[str], value: str, block: int = 100_000) -> DataFrame:
    """(key, n, longest): each key's rows with a value, and the length of their longest strictly rising subsequence in order.

    Keys of up to `block` rows are one tile. Larger ones, of which there are fewer than 10,000, are cut into blocks and as
    many ranges; a round has a task for each tile of a diagonal. Order has to be without ties. Null keys are a key; NaN
    and null values are left out. Values are compared as doubles.
    """
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).alias("key"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"))
    placed = settled(ranked(rows, [F.col("key"), *[F.col(f"o{i}") for i in range(len(order))]], "place").select("key", "place", "v"))
    sizes = settled(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")))
    most, total = sizes.agg(F.max("n"), F.sum("n")).first()
    block = max(block, (total or 0) // 10_000)
    parts = max(1, -(-(most or 0) // block))
    hot = sizes.filter(F.col("n") > block)
    if parts > 1:
        is_hot = placed.join(F.broadcast(hot.select(F.col("key").alias("k"))), F.col("key").eqNullSafe(F.col("k")))
        cuts = is_hot.groupBy("k").agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("cuts"))
        hot = settled(hot.join(cuts, F.col("key").eqNullSafe(F.col("k"))).select("k", "first", "cuts"))
        known = placed.join(F.broadcast(hot), F.col("key").eqNullSafe(F.col("k")), "left")
        b, r = F.floor((F.col("place") - F.col("first")) / block), F.size(F.filter("cuts", lambda c: c < F.col("v")))
        tiles = known.select("key", F.coalesce(b, F.lit(0)).cast("int").alias("b"), F.when(F.col("k").isNotNull() | F.col("first").isNotNull(), r).otherwise(0).alias("r"), "place", "v")
    else:
        tiles = placed.select("key", F.lit(0).alias("b"), F.lit(0).alias("r"), "place", "v")
    tiles = settled(tiles.select("key", "b", "r", F.lit(_ELEMENT).alias("kind"), F.col("place").cast("double").alias("x"), F.col("v").alias("y")))
    schema = tiles.schema
    kinds = pa.schema([("b", pa.int32()), ("r", pa.int32()), ("kind", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        b, r = table.column("b")[0].as_py(), table.column("r")[0].as_py()
        by_value, by_place, longest = tile(list(zip(*(table.column(c).to_pylist() for c in ("kind", "x", "y")))))
        out = [(b + 1, r, _BY_VALUE, x, float(n)) for x, n in by_value] if b + 1 < parts else []
        out += [(b, r + 1, _BY_PLACE, x, float(n)) for x, n in by_place] if r + 1 < parts else []
        out.append((b, r, _LONGEST, 0.0, float(longest)))
        keys = table.column("key").slice(0, 1).combine_chunks().take(pa.array([0] * len(out)))
        made = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kinds)], schema=kinds)
        return made.add_column(0, "key", keys)

    handed, found = None, None
    for diagonal in range(2 * parts - 1):
        here = tiles.filter(F.col("b") + F.col("r") == diagonal)
        if handed is not None:
            here = here.unionByName(handed.filter(F.col("kind") != _LONGEST))
        handed = settled(here.groupBy("key", "b", "r").applyInArrow(run, schema))
        ends = handed.filter(F.col("kind") == _LONGEST).select("key", "y")
        found = ends if found is None else found.unionByName(ends)
    longest = found.groupBy("key").agg(F.max("y").cast("long").alias("longest")).withColumnRenamed("key", "k")
    return sizes.join(longest, F.col("key").eqNullSafe(F.col("k"))).select(F.col("key").alias(key), "n", "longest")
