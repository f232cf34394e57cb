"""The corpus pipeline: each stage calls one corpus operator on all that its predecessor kept.

Stages are written as Parquet and read again, so that a lost executor costs no more than its own tasks. Nulls, empty
texts, repeated rows and empty tables have the result that the operator of each stage defines.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, mixing, pii, quality, similar
from tracemill.llm.common import checkpoint_folder, documents, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled cutoffs keep; nulls, long texts and repeated rows as
    quality.judge has them. The counts are settled without the texts, which would double the disk that all stages hold."""
    narrow = settle(quality.features(docs, ["doc_id", "lang"]))
    cutoffs = quality.fit(narrow, quality.labels_of(spark, sf_dir))
    # a row number is not deterministic, so the filter stays above the counts and they are worked out once a row
    featured = quality.features(docs, COLUMNS).withColumn("__row", F.monotonically_increasing_id())
    return quality.judge(featured, cutoffs).filter(F.col("kept") & (F.col("__row") >= 0)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, Jaccard 0.8 or at most four differing bits.
    Null ids and texts, ties and repeated rows as similar.keep_one has them."""
    return similar.keep_one(docs.select(*COLUMNS), shingle=5, limit=4, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced; n_chars follows the text. Null texts stay null, n_chars too."""
    docs = docs.select(*COLUMNS)
    return pii.redact(docs, pii.fit(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass that the mix takes, in training order. Passes are taken whole or left; only a document of over 2 %
    of its source's target is cut there, to its first words. Documents without words have no pass."""
    mixed = mixing.mix(docs.select(*COLUMNS), tolerance=0.02)
    return mixing.taken_texts(mixing.curriculum(mixed)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with their digests; null texts are empty."""
    import public_tokenizers

    path = public_tokenizers.path(bpe.TOKENIZER)
    return bpe.encode_documents(docs, path, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]
#: None of the stages can be stated in SQL; tests hold the pipeline against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; the last one's rows."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
