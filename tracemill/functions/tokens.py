"""Token counts by a real vocabulary: texts are cut into pieces, and each distinct piece is tokenized once.

Byte-level vocabularies encode the pieces of their pattern one by one, so a text's tokens are its pieces' together. Pieces
are counted by row first, their distinct ones go through the tokenizer, and the numbers are joined back; pieces that
very many rows hold are few and are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.operators.common import settled, spread


@lru_cache(4)
def encoder(path: str, pattern: str):
    """The vocabulary of ranks at path; read once a worker."""
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    return tiktoken.Encoding("of-a-file", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


def pieces(text: Column, pattern: str) -> Column:
    """The matches of a vocabulary's pattern, which its merges do not cross; null text has none."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(texts: pd.Series) -> pd.Series:
        cut = regex.compile(pattern)
        return texts.map(lambda t: [] if t is None else [m[0] for m in cut.finditer(t)])

    return run(text)


def counted_pieces(found: DataFrame, piece: str, path: str, pattern: str) -> DataFrame:
    """found (one row a piece) with `tokens`, the number of the piece's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            n = [len(own.encode_ordinary(p)) for p in batch.column(piece).to_pylist()]
            yield batch.append_column("tokens", pa.array(n, pa.int64()))

    return found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("tokens", T.LongType())]))


def token_counts(df: DataFrame, key: list[str], text: str, path: str, pattern: str, most: int = 10_000) -> DataFrame:
    """(key, tokens): the tokens of all texts of each key, 0 for null and empty ones. Null keys are a key."""
    rows = spread(df.select(*key, text)).select(*key, F.explode_outer(pieces(F.col(text), pattern)).alias("piece"))
    held = settled(rows.groupBy(*key, "piece").agg(F.count(F.lit(1)).alias("times")))
    kinds = held.filter("piece IS NOT NULL").groupBy("piece").agg(F.count(F.lit(1)).alias("rows"))
    book = settled(counted_pieces(kinds, "piece", path, pattern).withColumnRenamed("piece", "p"))
    hot = F.col("rows") > max(256, (book.agg(F.sum("rows")).first()[0] or 0) // most)
    few = F.broadcast(book.filter(hot).select("p", "tokens"))
    often = held.join(few, F.col("piece") == F.col("p"))
    seldom = held.join(few.select("p"), F.col("piece") == F.col("p"), "left_anti").join(book.filter(~hot).select("p", "tokens"), F.col("piece") == F.col("p"), "left")
    both = often.unionByName(seldom).groupBy(*key).agg(F.sum(F.col("times") * F.coalesce("tokens", F.lit(0))).alias("tokens"))
    return both


def resolved(words: DataFrame, word: str, path: str, pattern: str) -> DataFrame:
    """words with `token_id`, the token that stands for the word alone, null where the word takes several: those are not
    tracked and need a warning. Null words have none."""

    @F.pandas_udf(T.LongType())
    def run(texts: pd.Series) -> pd.Series:
        own = encoder(path, pattern)
        ids = [[] if t is None else own.encode_ordinary(t) for t in texts]
        return pd.Series([i[0] if len(i) == 1 else None for i in ids], dtype="Int64")

    return words.withColumn("token_id", run(word))
