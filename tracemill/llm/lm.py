"""Interpolated modified Kneser-Ney bigram model, counted in Spark and stored as sorted hash arrays.

Three passes over the texts. The first counts words: each word is known by its 64-bit hash, the sorted hashes are the
vocabulary and a word's number is its place among them. The second counts pairs of numbers in the training documents;
pairs are dealt by a hash to shards, and each shard's task writes its sorted pairs and their counts. The third scores:
workers memory-map the arrays, look a block of documents' distinct pairs up in order, and add up the logarithms. Rows
that are shuffled hold packed runs of sorted, distinct keys, so that a frequent word or pair costs one entry a block.

The arrays lie below the checkpoint folder, which all workers have to see as a file path (a mounted folder), as they are
memory-mapped. Words are numbered in 32 bits, so that a pair is one 64-bit key; more distinct words raise an error.
"""

from __future__ import annotations

import math
import os
import shutil
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, documents

#: A word has no space in it, so no word is the end of a text.
END = b" "


def words_of(text: str | None) -> list[bytes]:
    """Of bytes, lower() changes A to Z and split() parts at the six ASCII white spaces, nothing else."""
    return (text or "").encode().lower().split()


def hash_of(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def pack(keys: np.ndarray) -> bytes:
    """Sorted distinct unsigned longs as the first and the differences, byte by byte plane, upper zero planes left out."""
    planes = np.diff(keys).astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max((i + 1 for i in range(8) if planes[i].any()), default=0)
    return keys[:1].astype("<u8").tobytes() + bytes([used]) + planes[:used].tobytes()


def unpack(data: bytes, n: int) -> np.ndarray:
    steps = np.zeros((n, 8), np.uint8)
    if data[8]:
        steps[1:, : data[8]] = np.frombuffer(data, np.uint8, offset=9).reshape(data[8], n - 1).T
    steps[0] = np.frombuffer(data, np.uint8, 8)
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def mixed(pairs: np.ndarray) -> np.ndarray:
    """A hash of the pairs, for dealing them out."""
    x = pairs.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def save(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all, so that a task may run again."""
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{folder}/{name}.npy")


def load(folder: str, name: str) -> np.ndarray:
    return np.load(f"{folder}/{name}.npy", mmap_mode="r")


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and the few numbers that hold for all. offsets: the number of each vocabulary shard's first word."""

    folder: str
    offsets: tuple[int, ...]
    shards: int = 0
    tokens: int = 0
    starts: tuple[int, int, int, int] = (0, 0, 0, 0)  # documents; of the pairs they begin, those seen once, twice, more
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    pair_types: int = 0
    word_types: tuple[int, int, int] = (0, 0, 0)

    @property
    def words(self) -> int:
        return self.offsets[-1]


class Arrays:
    """A model's arrays as a worker sees them: memory-mapped, opened when first used."""

    def __init__(self, model: Model):
        self.model, self.maps = model, {}

    def at(self, name: str) -> np.ndarray:
        if name not in self.maps:
            self.maps[name] = load(self.model.folder, name)
        return self.maps[name]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers; model.words + 1 for words not in the vocabulary."""
        out = np.full(len(hashes), self.model.words + 1, np.uint64)
        order = np.argsort(hashes)
        ordered = hashes[order]
        parts = len(self.model.offsets) - 1
        bounds = np.searchsorted(ordered, [(s << 64) // parts for s in range(1, parts)]) if parts > 1 else []
        for s, part in enumerate(np.split(order, bounds)):
            known = self.model.offsets[s + 1] - self.model.offsets[s]
            if len(part) and known:
                own = self.at(f"hash-{s}")
                place = np.minimum(np.searchsorted(own, hashes[part]), known - 1)
                hit = own[place] == hashes[part]
                out[part[hit]] = (place[hit] + self.model.offsets[s]).astype(np.uint64)
        return out

    def of_words(self, name: str, numbers: np.ndarray) -> np.ndarray:
        """name's values for words; 0 for the beginning and for unknown words."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.model.offsets, numbers, side="right") - 1
        for s in np.unique(shard):
            if s < len(self.model.offsets) - 1:
                part = shard == s
                out[part] = self.at(f"{name}-{s}")[numbers[part].astype(np.int64) - self.model.offsets[s]]
        return out

    def of_pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Training counts of distinct sorted pairs."""
        out = np.zeros(len(pairs), np.int64)
        shard = mixed(pairs) % np.uint64(self.model.shards)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if len(part):
                own = self.at(f"pair-{shard[part[0]]}")
                if len(own):
                    place = np.minimum(np.searchsorted(own, pairs[part]), len(own) - 1)
                    hit = own[place] == pairs[part]
                    out[part[hit]] = self.at(f"pair_count-{shard[part[0]]}")[place[hit]]
        return out


_OPEN: dict[Model, Arrays] = {}


def arrays(model: Model) -> Arrays:
    if model not in _OPEN:
        _OPEN.clear()
        _OPEN[model] = Arrays(model)
    return _OPEN[model]


def blocks(batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Rows without their text, and their words, about `tokens` words at a time; the text is the last column."""
    rows, texts, n = [], [], 0
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            columns = [part.column(i).to_pylist() for i in range(part.num_columns)]
            for *row, text in zip(*columns):
                rows.append(row)
                texts.append(words_of(text))
                n += len(texts[-1]) + 1
                if n >= tokens:
                    yield rows, texts
                    rows, texts, n = [], [], 0
    if rows:
        yield rows, texts


def numbered(texts: list[list[bytes]], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's tokens as numbers, an end after each text; what stands before each; each text's tokens."""
    flat: list[bytes] = []
    for t in texts:
        flat += t
        flat.append(END)
    own = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    hashes = np.fromiter(map(hash_of, own), np.uint64, len(own))
    tokens = arrays(model).numbers(hashes)[np.fromiter(map(own.__getitem__, flat), np.int64, len(flat))]
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = model.words
    return tokens, before, sizes


def _rows(shards: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
    """A row for each shard: its keys, packed, and their values. keys are sorted within a shard."""
    order = np.argsort(shards, kind="stable")
    cuts = np.flatnonzero(np.diff(shards[order])) + 1
    out: list[list] = [[], [], []]
    for part in np.split(order, cuts):
        if len(part):
            out[0].append(int(shards[part[0]]))
            out[1].append(len(part))
            out[2].append(b"".join([*(v[part].astype("<u4").tobytes() for v in values), pack(keys[part])]))
    return pa.RecordBatch.from_arrays(
        [pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["shard", "n", "run"]
    )


_RUN = "shard int, n long, run binary"
#: What count_pairs counts for words, by number; the number after them marks a shard's statistics.
_KINDS = ["n1", "n2", "n3", "kinds"]


def _read(pdf: pd.DataFrame, values: int) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    keys, found = [], []
    for n, run in zip(pdf["n"], pdf["run"]):
        found.append([np.frombuffer(run, "<u4", n, 4 * n * i).astype(np.int64) for i in range(values)])
        keys.append(unpack(run[4 * n * values :], n))
    return keys, found


def count_words(train: DataFrame, folder: str, shards: int, most: int = 400_000) -> Model:
    """Writes hash-s and count-s, the vocabulary's sorted hashes and counts, and returns where its shards begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(counted: Counter) -> pa.RecordBatch:
            keys = np.fromiter(map(hash_of, counted), np.uint64, len(counted))
            counts = np.fromiter(counted.values(), np.int64, len(counted))
            order = np.argsort(keys)
            bounds = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)
            return _rows(np.searchsorted(bounds, keys[order], side="right"), keys[order], counts[order])

        counted: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counted.update(words_of(text.as_py()))
                counted[END] += 1
                if len(counted) > most:
                    yield rows(counted)
                    counted = Counter()
        if counted:
            yield rows(counted)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        keys, found = _read(pdf, 1)
        k, c = merged(keys, [f[0] for f in found])
        save(folder, f"hash-{shard}", k)
        save(folder, f"count-{shard}", c)
        return pd.DataFrame({"shard": [shard], "n": [len(k)], "tokens": [int(c.sum())]})

    found = train.select("text").mapInArrow(run, _RUN).groupBy("shard").applyInPandas(merge, "shard int, n long, tokens long")
    sizes = {r["shard"]: r for r in found.collect()}  # a row a shard
    offsets = [0]
    for s in range(shards):
        offsets.append(offsets[-1] + (sizes[s]["n"] if s in sizes else 0))
    if offsets[-1] + 2 >= 1 << 32:
        raise ValueError("words are numbered in 32 bits")
    return Model(folder, tuple(offsets), tokens=sum(r["tokens"] for r in sizes.values()))


def count_pairs(train: DataFrame, model: Model, block: int) -> tuple[Model, DataFrame]:
    """Writes pair-s and pair_count-s, then n1-s, n2-s, n3-s and kinds-s for the words of each vocabulary shard:
    how many pairs that a word begins occur once, twice, more often, and how many different words it follows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches, block):
            tokens, before, _ = numbered(texts, model)
            pairs, counts = np.unique(before << np.uint64(32) | tokens, return_counts=True)
            yield _rows((mixed(pairs) % np.uint64(model.shards)).astype(np.int64), pairs, counts)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        pdf = pdf[pdf["n"] > 0]
        if pdf.empty:
            save(model.folder, f"pair-{shard}", np.zeros(0, np.uint64))
            return pd.DataFrame({"shard": [], "n": [], "run": [], "kind": []})
        keys, found = _read(pdf, 1)
        pairs, counts = merged(keys, [f[0] for f in found])
        save(model.folder, f"pair-{shard}", pairs)
        kept = counts.astype(np.uint8) if counts.max() < 256 else counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64)
        save(model.folder, f"pair_count-{shard}", kept)
        first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
        out = []
        for kind, (words, weights) in enumerate([
            *((first, counts == i if i < 3 else counts >= 3) for i in (1, 2, 3)),
            (second, np.ones(len(pairs), bool)),
        ]):
            words, n = np.unique(words[weights], return_counts=True)
            if len(words):
                batch = _rows(np.searchsorted(model.offsets, words, side="right") - 1, words, n)
                out.append(batch.to_pandas().assign(kind=kind))
        seen = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
        stats = np.array([*seen, len(pairs)], "<i8").tobytes()
        out.append(pd.DataFrame({"shard": [-1], "n": [5], "run": [stats], "kind": [len(_KINDS)]}))
        return pd.concat(out)

    # one empty run for each shard, so that shards without a pair are written too
    every = train.sparkSession.range(model.shards, numPartitions=1).select(
        F.col("id").cast("int").alias("shard"), F.lit(0).cast("long").alias("n"), F.lit(b"").alias("run")
    )
    runs = train.select("text").mapInArrow(run, _RUN).union(every)
    return runs.groupBy("shard").applyInPandas(merge, _RUN + ", kind int")


def sum_words(parts: DataFrame, model: Model) -> tuple[list[int], list[int], tuple]:
    """Adds up count_pairs' runs by vocabulary shard. Returns how many pairs occur 1, 2, 3, 4 times and in all, how
    many words follow 1, 2, 3, 4 and three or more others and how many in all they follow, and the starts."""
    names = _KINDS

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iat[0])
        if shard < 0:
            total = sum(np.frombuffer(r, "<i8") for r in pdf["run"])
            return pd.DataFrame({"shard": [-1], "seen": [total.tolist()]})
        parts = len(model.offsets) - 1
        first = model.offsets[shard]
        size = model.offsets[shard + 1] - first if shard < parts else 2
        sums = {}
        for kind, name in enumerate(names):
            sums[name] = np.zeros(size, np.int64)
            keys, found = _read(pdf[pdf["kind"] == kind], 1)
            for k, f in zip(keys, found):
                sums[name][k.astype(np.int64) - first] += f[0]
            if shard < parts:
                save(model.folder, f"{name}-{shard}", sums[name].astype(np.uint32 if sums[name].max(initial=0) < 1 << 32 else np.int64))
        kinds = sums["kinds"]
        seen = [int((kinds == i).sum()) for i in (1, 2, 3, 4)] + [int((kinds >= 3).sum()), int(kinds.sum())]
        if shard == parts:  # what begins a document
            seen = [int(sums[n][0]) for n in names[:3]]
        return pd.DataFrame({"shard": [shard], "seen": [seen]})

    rows = parts.groupBy("shard").applyInPandas(merge, "shard int, seen array<long>").collect()  # a row a shard
    last = len(model.offsets) - 1
    pairs = next((r["seen"] for r in rows if r["shard"] == -1), [0] * 5)
    starts = next((r["seen"] for r in rows if r["shard"] == last), [0] * 3)
    words = [sum(x) for x in zip(*[r["seen"] for r in rows if 0 <= r["shard"] < last], [0] * 6)]
    return pairs, words, tuple(starts)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's for counts 1, 2 and 3 or more, from how many things occur 1, 2, 3 and 4 times; kept within
    (0, count), at 0.5, 1 and 1.5 where the numbers are too few to tell."""
    out = []
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
    for i, common in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else common
        out.append(d if 0 < d < i else common)
    return tuple(out)


def shards_for(size: int) -> int:
    """Shards of the vocabulary for a corpus of `size` bytes: it grows like a vocabulary (Heaps' law, exponent 0.6), so
    that what a shard gets from all tasks stays some megabytes, and few runs are shorter than their heads."""
    return max(64, int(64 * (size / 2**29) ** 0.6))


def discard(model: Model) -> None:
    """Deletes the model's arrays. Scores that have not been written yet can no longer be worked out."""
    shutil.rmtree(model.folder, ignore_errors=True)


def fit(train: DataFrame, shard_tokens: int = 2_000_000, block: int = 1_000_000, word_shards: int | None = None) -> Model:
    """Counts the texts of train; every task's memory is bounded by a block of words or a shard of keys.

    Null and empty texts are ends alone; repeated rows count as often as they occur; no rows: a model that knows nothing.
    """
    spark = train.sparkSession
    if word_shards is None:
        word_shards = shards_for(train.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    root = checkpoint_folder(spark)
    scheme, _, path = root.rpartition(":") if ":" in root else ("file", "", root)
    if scheme != "file":
        raise ValueError(f"{root}: the model's arrays are memory-mapped, so spark.checkpoint.dir has to be a mounted folder")
    folder = f"/{path.lstrip('/')}/lm-{uuid.uuid4().hex}"
    os.makedirs(folder)
    model = count_words(train, folder, word_shards)
    shards = max(64, -(-model.tokens // shard_tokens))
    model = Model(folder, model.offsets, shards, model.tokens)
    pairs, words, starts = sum_words(count_pairs(train, model, block), model)
    docs = train.count()
    return Model(
        folder, model.offsets, shards, model.tokens, (docs, *starts), discounts(pairs), discounts(words), pairs[4],
        (words[0], words[1], words[4]),
    )


def log10_probabilities(model: Model, pairs: np.ndarray) -> np.ndarray:
    """log10 P(second | first) for distinct sorted pairs."""
    a = arrays(model)
    first, second = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    d = np.array([0.0, *model.word_discounts])
    heads, at = np.unique(second, return_inverse=True)
    kinds = a.of_words("kinds", heads)
    spread = sum(x * n for x, n in zip(model.word_discounts, model.word_types))
    total = max(1, model.pair_types)
    rest = spread / total if model.pair_types else 1.0
    unigram = (np.maximum(kinds - d[np.minimum(kinds, 3)], 0) / total + rest / (model.words + 1))[at]
    heads, at = np.unique(first, return_inverse=True)
    history = a.of_words("count", heads)
    begins = heads == model.words
    history[begins] = model.starts[0]
    back = np.zeros(len(heads))
    for i, name in enumerate(("n1", "n2", "n3")):
        n = a.of_words(name, heads)
        n[begins] = model.starts[i + 1]
        back += model.pair_discounts[i] * n
    known = history > 0
    back = np.where(known, back / np.maximum(history, 1), 1.0)
    d = np.array([0.0, *model.pair_discounts])
    counts = a.of_pairs(pairs)
    own = np.maximum(counts - d[np.minimum(counts, 3)], 0) / np.maximum(history, 1)[at]
    return np.log10(own + back[at] * unigram)


def score(docs: DataFrame, model: Model, block: int = 1_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity, 10 ** (-score / n_tokens).

    docs: doc_id, held_out, text. Null or empty text: the end alone. Null doc_id and repeated rows: a row each. Words
    unknown to the model share the part kept for them. Nothing learnt: every word has the probability 1. Texts are
    scored whole, however long. Ties do not arise. Empty input: no rows. Other columns of docs do not matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = arrays(model)
        for rows, texts in blocks(batches, block):
            tokens, before, sizes = numbered(texts, model)
            begin = np.cumsum(sizes) - sizes
            distinct, at = np.unique(tokens, return_inverse=True)
            counts = a.of_words("count", distinct)
            base = np.log10((counts + 1) / (model.tokens + model.words + 1))[at]
            known = (counts > 0)[at]
            pairs, at = np.unique(before << np.uint64(32) | tokens, return_inverse=True)
            own = log10_probabilities(model, pairs)[at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], kinds[0]),
                    pa.array([r[1] for r in rows], pa.bool_()),
                    pa.array(sizes),
                    pa.array(np.add.reduceat(known.astype(np.int64), begin)),
                    pa.array(np.full(len(rows), model.tokens, np.int64)),
                    pa.array(np.add.reduceat(base, begin)),
                    pa.array(total := np.add.reduceat(own, begin)),
                    pa.array(10 ** (-total / sizes)),
                ],
                names,
            )

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema["doc_id"].dataType)]
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return docs.select("doc_id", "held_out", F.col("text").cast("string")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each row of documents, as `score` defines it; nulls, long texts and empty tables likewise."""
    docs = documents(spark, sf_dir).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(docs, fit(docs.filter(~F.col("held_out"))))
