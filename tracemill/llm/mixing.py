"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A source's share follows a linear schedule over training time t in [0, 1]: share(t) = target * (1 + slope * (2t - 1)).
Integrated, its demand by time t is target * (t + slope * (t^2 - t)); the time at which a document of the source is due
is that integral inverted at the words the source has given before. Documents, range-sorted by time, are the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, WORD, documents, occurrence, row_hash, running_start, settle, shield, word_count

#: Tables up to this size, as measured, are broadcast.
SMALL = 32 << 20


def _numbered(df: DataFrame, order: list[Column]) -> DataFrame:
    """Adds __rank from 0 by order: rows are range-sorted into partitions, whose counts give each one's offset."""
    ranged = settle(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    counts = counts.select(
        F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    rows = ranged.withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    joined = rows.join(counts, F.col("__part") == F.col("__p"))
    return joined.withColumn("__rank", F.col("__offset") + F.col("__in") - 1).drop("__part", "__p", "__offset", "__in")


def source_targets(
    sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, __rows, target): weights repeat over the sources by code point, null last.

    Together the sources get share * all sizes, by weight; a target stops at most * its source's size and the rest
    is shared again by weight among the others, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("__rows"))
    ranked = _numbered(per, [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = settle(ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * F.lit(most)))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # a source once at its cap stays there, as the others' level only rises
        at_cap = F.col("__w") * F.lit(level) > F.col("__cap") if capped >= 0 else F.lit(False)
        n, fixed, open_w = ranked.agg(
            F.count_if(at_cap),
            F.coalesce(F.sum(F.when(at_cap, F.col("__cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at_cap, F.col("__w"))), F.lit(0.0)),
        ).first()
        if n == capped or not open_w:
            break
        level, capped = (share * total - fixed) / open_w, n
    target = F.least(F.col("__w") * F.lit(level), F.col("__cap")).cast("double")
    return ranked.select("source", "source_size", "__rows", target.alias("target"))


def due(words: Column, target: Column, slope: Column) -> Column:
    """The time at which the source's demand reaches words: the root in [0, 1] of slope t^2 + (1 - slope) t = words / target."""
    x = words / target
    linear = 1 - slope
    root = F.sqrt(linear * linear + 4 * slope * x)
    return F.when(F.abs(slope) < 1e-9, x).otherwise(2 * x / (linear + root))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    slopes: tuple[float, ...] = (0.5, -0.5, 0.0),
    bucket_rows: tuple[int, int] = (64, 20_000),
    tolerance: float | None = None,
    with_text: bool = True,
) -> DataFrame:
    """All rows with size, source_size, target, taken, and due_1 and due_2, the times of a document's two passes.

    Within its source a document's place is by a seeded hash of all its columns, so only rows that are alike tie, and it
    does not matter which of them comes first. Words start .. start + size are its first pass, the same plus source_size
    its second; taken is how many of them lie below the target. So a source's taken words add up to its target, rounded
    down, one document of it being cut. tolerance: the pass that crosses the target is taken whole if more than half of it
    lies below, else left, unless its size is over this share of the target; then it is cut. due_k is null if pass k is
    not taken. with_text False: the result has no text, and only sizes travel.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: hashes like any value. Repeated rows:
    each has a place of its own. Very long texts: whole. No words at all: targets are 0. Empty input: no rows. Columns of
    docs with the names that are added here are replaced; others stay. docs has to be a scan or a checkpoint.
    """
    docs, restore = shield(docs.drop("size", "source_size", "target", "taken", "due_1", "due_2"))
    sized = docs.withColumn("__size", word_count(F.col("text"))).withColumn("__row", row_hash(docs))
    if not with_text:
        sized = settle(sized.drop("text"))  # counted once
    targets = settle(source_targets(sized.select("source", "__size"), weights, share, most))
    rows, n_sources, name_bytes = targets.agg(F.sum("__rows"), F.count(F.lit(1)), F.sum(F.octet_length(F.col("source").cast("string")))).first()
    rows, held = rows or 0, 64 * n_sources + (name_bytes or 0)
    per = min(max(rows // 2048, bucket_rows[0]), bucket_rows[1])
    slope = F.element_at(F.array(*map(F.lit, slopes)), (F.pmod(F.xxhash64("__s"), F.lit(len(slopes))) + 1).cast("int"))
    known = targets.select(
        F.col("source").alias("__s"), "source_size", "target", F.ceil(F.col("__rows") / per).alias("__buckets")
    ).withColumn("__slope", slope)
    known = F.broadcast(known) if held <= SMALL else known
    placed = occurrence(sized, "__row", bucket_rows[1], "__copy")
    placed = placed.withColumn("__h", F.xxhash64(F.lit(seed), "__row", "__copy"))
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    placed = placed.withColumn("__b", F.pmod(F.col("__h"), F.col("__buckets")))
    sums = placed.groupBy("source", "__b").agg(F.sum("__size").alias("__sum"))
    starts = running_start(sums, ["source"], "__b", "__sum", "__before").select(
        F.col("source").alias("__s"), F.col("__b").alias("__k"), "__before"
    )
    within = Window.partitionBy("source", "__b").orderBy("__h", "__row", "__size")
    inner = F.coalesce(F.sum("__size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    longest_name = -(-(name_bytes or 0) // max(1, n_sources))  # on average
    starts = F.broadcast(starts) if (rows // per + n_sources) * (64 + longest_name) <= SMALL else starts
    placed = (
        placed.withColumn("__inner", inner)
        .join(starts, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
        .withColumn("__start", F.col("__before") + F.col("__inner"))
    )
    goal = F.floor(F.col("target"))
    taken, times = F.lit(0), []
    for p in range(most):
        start = F.col("__start") + p * F.col("source_size")
        part = F.greatest(F.least(F.col("__size"), goal - start), F.lit(0))
        if tolerance is not None:
            rounded = F.when(2 * part > F.col("__size"), F.col("__size")).otherwise(F.lit(0))
            part = F.when(F.col("__size") <= tolerance * F.col("target"), rounded).otherwise(part)
        taken = taken + part
        times.append(F.when(part > 0, due(start, F.col("target"), F.col("__slope"))))
    return restore(
        placed.select(
            *[F.col(f"`{c}`") for c in docs.columns if c in placed.columns],
            F.col("__size").cast("long").alias("size"),
            F.col("source_size").cast("long").alias("source_size"),
            "target",
            taken.cast("long").alias("taken"),
            *[t.cast("double").alias(f"due_{p + 1}") for p, t in enumerate(times)],
        )
    )


def curriculum(mixed: DataFrame) -> DataFrame:
    """The training order: a row per pass taken, with its words and position, range-sorted by position, then doc_id.

    mixed: rows of mix. The last pass of a document may be cut; its words are then fewer than its size. Columns named
    position or words are replaced, due_1 and due_2 go. Empty input: no rows. Equal positions and ids: in any order.
    """
    mixed, restore = shield(mixed)
    passes = F.array(
        *[
            F.struct(
                F.col(f"due_{p}").alias("position"),
                F.least(F.col("size"), F.col("taken") - (p - 1) * F.col("size")).alias("words"),
            )
            for p in (1, 2)
        ]
    )
    out = mixed.withColumn("__pass", F.explode(F.filter(passes, lambda x: x["position"].isNotNull())))
    keep = [c for c in mixed.columns if c not in ("due_1", "due_2", "position", "words")]
    out = out.select(*keep, "__pass.position", "__pass.words")
    return restore(out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id"))


def taken_texts(passes: DataFrame) -> DataFrame:
    """The texts cut to the words that their passes take; whole passes keep their text as it is.

    passes: rows of curriculum with a column text. Null texts have no words, so no pass takes them. n_chars, if there is
    such a column or not, is set to the length of the text. Other columns stay.
    """
    words = F.regexp_extract_all("text", F.lit(f"{GAP[:-1]}*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    return passes.withColumn("text", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text"))).withColumn(
        "n_chars", F.length("text").cast("long")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `mix` defines it; nulls, ties, long texts and empty tables likewise."""
    out = mix(documents(spark, sf_dir).select("doc_id", "source", "text"), with_text=False)
    out = out.repartitionByRange(F.col("due_1").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(
        F.col("due_1").asc_nulls_last(), "doc_id"
    )
    return out.select("doc_id", "size", "source_size", "target", "taken", "due_1", "due_2")
