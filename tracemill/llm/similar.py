"""Near-duplicates by the Jaccard similarity of shingle sets, beside the SimHash links of the same shingles.

MinHash bands name the candidates: two sets of similarity 0.8 share none of the 25 bands of 5 rows with a probability of
5e-5, closer ones with less. Each candidate is then held against the exact sets, unless the sizes alone rule it out or it
is known by then that both are of one component: first each set against the least one of the bucket that most of its
buckets agree on, then the sets of buckets that still hold several components against each other in blocks, those of a
bucket's largest component only against the others. So no pair that shares a bucket is left open, and no group is written
out pair by pair. Texts travel, not sets: they are smaller, and
each task works its sets out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_folder, settle, shield
from .components import components
from .simhash import fingerprint, links

BANDS, ROWS = 25, 5
_rng = np.random.default_rng(8)
_TIMES = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)[:, None] * np.uint64(2)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """The distinct XXH64 (seed 42) of the shingles, sorted; words and short texts as simhash.fingerprint has them."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    last = ends[min(shingle, len(words)) - 1 :] if words else []
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s : e - 1], 42) for s, e in zip([0, *ends], last)], np.uint64))


def bands(found: np.ndarray) -> list[int]:
    """A value for each band, as a signed long. Values of different bands do not meet."""
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for first in range(0, len(found), 1024):
        np.minimum(low, (found[None, first : first + 1024] * _TIMES + _PLUS).min(axis=1), out=low)
    raw = low.tobytes()
    values = [xxhash.xxh64_intdigest(raw[8 * ROWS * b : 8 * ROWS * (b + 1)], b) for b in range(BANDS)]
    return np.array(values, np.uint64).view(np.int64).tolist()


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fp, key, size, bands): key stands for the shingle set, size is its own; null key and bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                fps, keys, sizes, values = [], [], [], []
                for text in part.column(1).to_pylist():
                    found = shingles(text, shingle)
                    fps.append(fingerprint(text, shingle))
                    keys.append(int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64)) if len(found) else None)
                    sizes.append(len(found))
                    values.append(bands(found) if len(found) else None)
                columns = [*(pa.array(x, pa.int64()) for x in (fps, keys, sizes)), pa.array(values, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "fp", "key", "size", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, fp long, key long, size long, bands array<long>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least percent."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _linked(pdf: pd.DataFrame, shingle: int, percent: int) -> pd.DataFrame:
    """Links between components among the sets of a task: rows of side 0 with those of side 1, and, where `both`, those
    of side 1 among themselves."""
    root = {x: x for x in pdf["label"]}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    rows = [(a, b, shingles(t, shingle)) for a, b, t in zip(pdf["label"], pdf["side"], pdf["text"])]
    within, out = bool(pdf["both"].iat[0]), []
    for k, (a, side, left) in enumerate(rows):
        for b, other, right in rows[:k]:
            if (side != other or (within and side == 1)) and find(a) != find(b) and alike(left, right, percent):
                root[find(a)] = find(b)
                out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _close(sizes: tuple[str, str], percent: int) -> Column:
    """Whether the sizes of two sets allow for a similarity of at least percent."""
    return 100 * F.least(*sizes) >= percent * F.greatest(*sizes)


def _stars(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, task: int) -> DataFrame:
    """(a, b): those of the pairs (key, rep) of sets that are alike; `task` is how many shingles a task holds."""
    sized = pairs.join(texts.select(F.col("key").alias("__k"), F.col("size").alias("__size")), F.col("key") == F.col("__k")).drop("__k")
    parts = sized.groupBy("rep").agg(F.greatest(F.ceil(F.sum("__size") / task), F.lit(1)).cast("int").alias("parts"))
    parts = parts.select(F.col("rep").alias("__rep"), "parts")
    own = pairs.join(parts, F.col("rep") == F.col("__rep")).select("key", "rep", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    other = parts.select(F.col("__rep").alias("key"), F.col("__rep").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = own.withColumn("side", F.lit(1)).union(other.withColumn("side", F.lit(0)))
    rows = rows.join(texts.select(F.col("key").alias("__k"), "text"), F.col("key") == F.col("__k"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = shingles(pdf.loc[pdf["side"] == 0, "text"].iat[0], shingle)
        mine = pdf[pdf["side"] == 1]
        near = [alike(rep, shingles(t, shingle), percent) for t in mine["text"]]
        found = mine[np.array(near, bool)]
        return pd.DataFrame({"a": found["key"], "b": found["rep"]})

    return rows.select("rep", "part", "key", "side", "text").groupBy("rep", "part").applyInPandas(compare, "a long, b long")


def _blocks(members: DataFrame, texts: DataFrame, shingle: int, percent: int, task: int) -> DataFrame:
    """(a, b): links between the labels of buckets (value, key, label, size) that hold several."""
    counted = members.groupBy("value", "label").agg(F.sum("size").alias("__s"), F.count(F.lit(1)).alias("__n"))
    whole = counted.groupBy("value").agg(
        F.max_by("label", F.struct("__s", "label")).alias("main"), F.max("__s").alias("__main"), F.sum("__s").alias("__all"), F.count(F.lit(1)).alias("__labels")
    )
    half = max(1, task // 2)
    whole = whole.filter("__labels > 1").select(
        F.col("value").alias("__value"), "main", F.ceil(F.col("__main") / half).cast("int").alias("mains"),
        F.ceil((F.col("__all") - F.col("__main")) / half).cast("int").alias("rests"),
    )
    rows = members.join(whole, F.col("value") == F.col("__value"))
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("key"), F.when(is_main, F.col("mains")).otherwise(F.col("rests"))).cast("int")
    # a task is (i, j): rests i with mains j (j < 0: -1 - j), or rests i with rests j >= i
    rest, main = F.sequence(F.lit(0), F.col("rests") - 1), F.sequence(F.lit(0), F.col("mains") - 1)
    spot = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    as_main = F.transform(rest, lambda i: spot(i, -1 - own, 0))
    as_rest = F.concat(
        F.transform(main, lambda j: spot(own, -1 - j, 1)), F.transform(rest, lambda k: F.when(k >= own, spot(own, k, 1)).otherwise(spot(k, own, 0)))
    )
    dealt = rows.select("value", "label", "key", F.explode(F.when(is_main, as_main).otherwise(as_rest)).alias("t"))
    dealt = dealt.select("value", "label", "key", "t.*").withColumn("both", F.col("i") == F.col("j"))
    dealt = dealt.join(texts.select(F.col("key").alias("__k"), "text"), F.col("key") == F.col("__k"))
    dealt = dealt.select("value", "i", "j", "label", "side", "both", "text")
    return dealt.groupBy("value", "i", "j").applyInPandas(lambda pdf: _linked(pdf, shingle, percent), "a long, b long")


def grouped(docs: DataFrame, shingle: int = 5, limit: int = 4, percent: int = 80, task: int = 1 << 18) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id that links reach, the document's own included.

    Links: shingle sets of Jaccard similarity of at least percent, and fingerprints that differ in at most limit bits.
    doc_id: of any comparable type, and different for each row. Null or empty text, or one without words: fingerprint 0,
    no shingles, linked by fingerprint alone. Sets are known by 64 bits. Very long texts: read whole; a task holds about
    `task` shingles, or two longer texts. Empty input: no rows.
    """
    marked = settle(_sketches(docs, shingle))
    fps = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("__least")))
    known = marked.filter(F.col("key").isNotNull())
    # rows of one fingerprint are one component, so links are given between fingerprints
    sets = settle(
        known.groupBy("key").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    )
    fp_of = sets.select(F.col("key").alias("__key"), F.col("fp").alias("__fp"))
    same = known.select("fp", "key").distinct().join(fp_of, F.col("key") == F.col("__key"))
    same = same.select(F.col("fp").alias("a"), F.col("__fp").alias("b"))

    entries = sets.select("key", "size", F.explode("bands").alias("value"))
    buckets = entries.groupBy("value").agg(F.min(F.struct("key", "size")).alias("r"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = buckets.select(F.col("value").alias("__value"), F.col("r.key").alias("rep"), F.col("r.size").alias("rep_size"))
    members = settle(entries.join(buckets, F.col("value") == F.col("__value")).drop("__value"))
    wanted = members.select(F.col("key").alias("__w")).distinct().join(sets, F.col("key") == F.col("__w")).select("key", "size", F.col("doc_id").alias("__id"))
    texts = docs.join(wanted, F.col("doc_id") == F.col("__id")).select("key", "size", F.col("text").cast("string").alias("text"))
    path = f"{checkpoint_folder(docs.sparkSession)}/similar-{uuid4().hex}"
    texts.write.parquet(path)  # smaller than a checkpoint
    texts = docs.sparkSession.read.parquet(path)

    def rooted(before: DataFrame, edges: DataFrame) -> DataFrame:
        """(fp, __least, label): the least fingerprint of the component that edges join labels to."""
        roots = components(edges)
        out = before.join(roots, F.col("label") == F.col("node"), "left")
        return settle(out.select("fp", "__least", F.coalesce("root", "label").alias("label")))

    def of_labels(pairs: DataFrame) -> DataFrame:
        """Pairs of keys as pairs of their fingerprints."""
        two = fp_of.select(F.col("__key").alias("__other"), F.col("__fp").alias("b_fp"))
        out = pairs.join(fp_of, F.col("a") == F.col("__key")).join(two, F.col("b") == F.col("__other"))
        return out.select(F.col("__fp").alias("a"), F.col("b_fp").alias("b"))

    pairs = members.filter((F.col("key") != F.col("rep")) & _close(("size", "rep_size"), percent))
    pairs = pairs.groupBy("key", "rep").agg(F.count(F.lit(1)).alias("n"))
    first = pairs.groupBy("key").agg(F.max_by("rep", F.struct(F.col("n"), -F.col("rep"))).alias("rep"))
    labels = fps.select("fp", "__least", F.col("fp").alias("label"))
    stars = of_labels(_stars(first, texts, shingle, percent, task))
    labels = rooted(labels, links(fps.select("fp"), limit).union(same).union(stars))

    label_of = fp_of.join(labels.select("fp", "label"), F.col("__fp") == F.col("fp")).select("__key", "label")
    rest = members.join(label_of, F.col("key") == F.col("__key")).select("value", "key", "label", "size")
    labels = rooted(labels, _blocks(rest, texts, shingle, percent, task))
    least = labels.groupBy("label").agg(F.min("__least").alias("component_id")).withColumnRenamed("label", "__label")
    named = labels.join(least, F.col("label") == F.col("__label")).select(F.col("fp").alias("__fp"), "component_id")
    return marked.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, limit: int = 4, percent: int = 80) -> DataFrame:
    """One whole row of each component: that of the least doc_id, null last; of its rows the first by place.

    docs has to be read straight from Parquet files: a row is known by its id, a hash of its file's whole path and its
    number there. Null texts and texts without words are one component. Very long texts: read whole. Ties, that is
    repeated rows: one stays. Empty input: no rows. All columns stay, those named like this function's own as well.
    """
    docs, restore = shield(docs)
    place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), *place)
    groups = grouped(docs.select(first.alias("doc_id"), "text"), shingle, limit, percent)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).select(*[F.col(f"doc_id.{c}").alias(f"__{c}") for c in ("file", "row", "id")])
    placed = docs.select("*", place[0].alias("__f"), place[1].alias("__r"))
    on = (F.col("__f") == F.col("__file")) & (F.col("__r") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return restore(placed.join(kept, on, "left_semi").drop("__f", "__r"))
