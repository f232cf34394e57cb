"""SimHash near-duplicates by the generalised pigeonhole principle.

Correlated bits are grouped into parts. Part i gets a threshold t_i of differing bits, -1 for none, with
sum(t_i + 1) = limit + 1: then two fingerprints that differ in at most `limit` bits differ in at most t_i bits of some
part i. The thresholds are dealt out by dynamic programming on candidate counts estimated from a bounded sample, which
bears on cost alone. Every distinct fingerprint is indexed at its parts' values and probes the values within the
thresholds; each pair that meets is verified. Large buckets are dealt out in blocks, and each pair of blocks gives a
spanning forest of its links rather than all of them, so that no link between components is lost and no group is
written out pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settle
from .components import components

BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """Bit b is set if more than half of the shingles' XXH64 (seed 42) have it; 0 without words. As a signed long."""
    words = (text or "").encode().lower().split()  # bytes: letters A to Z, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    count = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest, seen = xxhash.xxh64_digest, np.zeros(BITS, np.int64)
    for first in range(0, count, 65_536):
        part = b"".join(
            [digest(joined[s : e - 1], 42) for s, e in zip(starts[first : first + 65_536], last[first : first + 65_536])]
        )
        seen += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * seen > count).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                fps = [fingerprint(t, shingle) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each value, lowest bit first."""
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def correlated(sample: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in groups of nearly equal size: each group grows by the bit that correlates most with it."""
    x = _bits(sample).astype(np.float64)
    x -= x.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    free, groups = set(range(BITS)), []
    for p in range(parts):
        size = (BITS - sum(map(len, groups))) // (parts - p)
        group = [max(sorted(free), key=lambda b: sum(corr[b, c] for c in free))]
        free -= set(group)
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: sum(corr[b, c] for c in group)))
            free.discard(group[-1])
        groups.append(sorted(group))
    return groups


def masks(width: int, threshold: int) -> list[int]:
    """All sets of at most threshold bits, but the empty one."""
    return [sum(1 << b for b in s) for k in range(1, threshold + 1) for s in combinations(range(width), k)]


def _meetings(values: np.ndarray, width: int, threshold: int) -> float:
    """Pairs of the sample whose part differs in at most threshold bits."""
    own, n = np.unique(values, return_counts=True)
    total = float((n * (n - 1) // 2).sum())
    for m in masks(width, threshold):
        other = own ^ m
        at = np.minimum(np.searchsorted(own, other), len(own) - 1)
        total += float((n * np.where(own[at] == other, n[at], 0)).sum()) / 2
    return total


def allotted(sample: np.ndarray, rows: int, limit: int, most_entries: int = 400) -> list[tuple[list[int], int]]:
    """Parts and their thresholds: for each number of parts, a dynamic programme over what is left of limit + 1.

    Fewer, wider parts with more probes pay off the more rows there are; no part gets a threshold for which a
    fingerprint would have more than most_entries entries, on average.
    """
    best = (float("inf"), [])
    scale = (rows / max(1, len(sample))) ** 2
    for parts in range(2, limit + 2):
        groups = correlated(sample, parts)
        rest: dict[int, tuple[float, list]] = {0: (0.0, [])}
        for g in groups:
            values = (_bits(sample)[:, g].astype(np.int64) << np.arange(len(g))).sum(axis=1)
            cost = {0: 0.0}
            for t in range(min(2, limit) + 1):
                probes = 1 + len(masks(len(g), t)) / 2
                if probes > most_entries:
                    break
                cost[t + 1] = 3 * rows * probes + scale * _meetings(values, len(g), t)
            step: dict[int, tuple[float, list]] = {}
            for used, (c, chosen) in rest.items():
                for units, more in cost.items():
                    total = used + units
                    if total <= limit + 1 and c + more < step.get(total, (float("inf"),))[0]:
                        step[total] = c + more, [*chosen, (g, units - 1)]
            rest = step
        if limit + 1 in rest and rest[limit + 1][0] < best[0]:
            best = rest[limit + 1]
    return [(g, t) for g, t in best[1] if t >= 0]


def _part(fp: Column, bits: list[int]) -> Column:
    value = F.lit(0).cast("long")
    for to, b in enumerate(bits):
        value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), to))
    return value


def _entries(value: Column, part: int, flips: list[int]) -> Column:
    def row(v: Column, probe: bool) -> Column:
        return F.struct(F.lit(part).alias("part"), v.alias("value"), F.lit(probe).alias("probe"))

    own = F.array(row(value, False))
    if not flips:
        return own
    sets = F.array(
        *[
            F.struct(F.lit(m).cast("long").alias("m"), F.lit(1 << (m.bit_length() - 1)).cast("long").alias("top"))
            for m in flips
        ]
    )
    free = F.filter(sets, lambda x: value.bitwiseAND(x["top"]) == 0)
    return F.concat(own, F.transform(free, lambda x: row(value.bitwiseXOR(x["m"]), True)))


def _records(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(part, value, fp, probe). Of two values that differ, the one with the highest differing bit 0 probes the other."""
    valued = fps.select("fp", *[_part(F.col("fp"), g).alias(f"__v{i}") for i, (g, _) in enumerate(parts)])
    entries = [_entries(F.col(f"__v{i}"), i, masks(len(g), t)) for i, (g, t) in enumerate(parts)]
    return valued.select("fp", F.explode(F.concat(*entries)).alias("r")).select("fp", "r.part", "r.value", "r.probe")


def forest(a: np.ndarray, b: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between blocks a and b of fingerprints, thinned: each linked node with one node of its component."""
    near = np.bitwise_count(a[:, None] ^ b[None, :]) <= limit
    big = len(a) + len(b)
    la, lb = np.arange(len(a)), np.full(len(b), big)
    while True:
        nb = np.minimum(lb, np.where(near, la[:, None], big).min(axis=0, initial=big))
        na = np.minimum(la, np.where(near, nb[None, :], big).min(axis=1, initial=big))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    keep_a, keep_b = la != np.arange(len(a)), lb < big
    left = np.concatenate([a[keep_a], b[keep_b]])
    right = a[np.concatenate([la[keep_a], lb[keep_b]])]
    differ = left != right
    return left[differ], right[differ]


def links(
    fps: DataFrame, limit: int = 4, sample_rows: int = 20_000, least_rows: int = 1_000_000, bucket: int = 256, block: int = 768
) -> DataFrame:
    """(a, b): links enough that their components are those of all pairs of fps that differ in at most limit bits.

    fps: distinct fingerprints, as a checkpoint or scan. sample_rows bounds the sample that estimates costs. The
    thresholds are planned for the number of fingerprints there are, or for least_rows if there are fewer: below that
    plans cost next to nothing either way, and one plan for all small inputs keeps their cost in proportion. bucket is
    the largest that is joined pair by pair, block the largest that a task compares with another at once.
    """
    rows = fps.count()
    sample = fps.orderBy(F.xxhash64("fp")).limit(sample_rows).collect()  # bounded
    if rows < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    parts = allotted(np.array([r[0] for r in sample], np.int64), max(rows, least_rows), limit)
    records = settle(_records(fps, parts))
    sizes = records.groupBy("part", "value").agg(
        F.count_if(~F.col("probe")).alias("__idx"), F.count(F.lit(1)).alias("__all")
    )
    hot = settle(sizes.filter((F.col("__idx") > 0) & (F.col("__all") > bucket)))
    hot_n = hot.count()
    key = ["part", "value"]
    index = records.filter(~F.col("probe")).select(*key, F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= limit
    cold = records if hot_n == 0 else records.join(F.broadcast(hot) if hot_n <= 10_000 else hot, key, "left_anti")
    cold_index = cold.filter(~F.col("probe")).select(F.col("part").alias("p"), F.col("value").alias("v"), F.col("fp").alias("a"))
    others = cold.select("part", "value", F.col("fp").alias("b"), "probe")
    on = (F.col("part") == F.col("p")) & (F.col("value") == F.col("v"))
    found = cold_index.join(others, on & near & (F.col("probe") | (F.col("a") < F.col("b")))).select("a", "b")
    if hot_n == 0:
        return found
    sized = records.join(F.broadcast(hot) if hot_n <= 10_000 else hot, key)
    idx_blocks = F.ceil(F.col("__idx") / block).cast("int")
    probe_blocks = F.ceil((F.col("__all") - F.col("__idx")) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("probe"), probe_blocks).otherwise(idx_blocks)).cast("int")
    # index block i meets index blocks j >= i, and all probe blocks (numbered from idx_blocks on)
    all_idx = F.sequence(F.lit(0), idx_blocks - 1)
    all_blocks = F.sequence(F.lit(0), idx_blocks + probe_blocks - 1)
    task = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    as_probe = F.transform(all_idx, lambda i: task(i, own + idx_blocks, 1))
    as_index = F.transform(
        all_blocks, lambda j: F.when(j >= own, task(own, j, 0)).otherwise(task(j, own, 1))
    )
    dealt = sized.select(*key, "fp", F.explode(F.when(F.col("probe"), as_probe).otherwise(as_index)).alias("t"))
    dealt = dealt.select(*key, "fp", "t.i", "t.j", "t.side")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, side = pdf["fp"].to_numpy(np.int64), pdf["side"].to_numpy()
        a = fp[side == 0]
        b = a if pdf["i"].iat[0] == pdf["j"].iat[0] else fp[side == 1]
        left, right = forest(a, b, limit) if len(a) and len(b) else (a[:0], a[:0])
        return pd.DataFrame({"a": left, "b": right})

    return found.union(dealt.groupBy(*key, "i", "j").applyInPandas(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 4, limit: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the document's own included.

    Null or empty text, or one without words: fingerprint 0, linked like any other. Fewer words than a shingle: the
    whole sequence is the one shingle. Very long texts: read whole. Null doc_id: such a row has the component_id of the
    others of its component, null if all are null. Ties, that is repeated rows: a row each. Empty input: no rows. Other
    columns do not matter.
    """
    marked = settle(fingerprints(docs, shingle))
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("__least")))
    roots = components(links(fps.select("fp"), limit))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "__least", F.coalesce("root", "fp").alias("root")
    )
    rooted = settle(rooted)
    least = rooted.groupBy("root").agg(F.min("__least").alias("component_id")).withColumnRenamed("root", "__root")
    named = rooted.join(least, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `near_duplicates` defines it; nulls, ties and empty tables likewise."""
    out = near_duplicates(documents(spark, sf_dir), shingle=4, limit=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
