"""All corpus operators and pipeline stages on nulls, empty and very long texts, repeated rows, clashing columns and
empty tables: nothing crashes, no row is lost, columns that are not the operator's own stay as they are."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import ann, bpe, html, lm, mixing, pii, quality, secrets, sharding, similar, simhash

LONG = {
    "words": "word other " * 30_000,
    "digits": "4111 1111 1111 1111, " * 12_000,
    "mails": "a@b.cd 1.2.3.4 +49 30 123 456 78\n" * 8_000,
    "one": "x" * 300_000,
    "keys": "Zk3vQ9pL0sXw7TgB2nHy " * 8_000,
}
OWN = {"__spans": "a", "__text": "b", "__words": "c", "__size": "d", "__h": "e", "__row": "f", "__bucket": "g", "__f": "h", "__r": "i", "__part": "j", "__fp": "k", "label": "l", "value": "m", "key": "n", "node": "o"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in OWN)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    rows = [(1, None, None, None, None), (None, "no id", "en", "s", 5), (2, "", "en", None, 0), (3, " \n\t ", "de", "s", 4)]
    rows += [(4, "twice the same text", "en", "s", 19)] * 2 + [(10 + i, t, "en", "t", len(t)) for i, t in enumerate(LONG.values())]
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(*r, *OWN.values()) for r in rows], SCHEMA).repartition(6).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1), (4, None), (None, 0)], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(f"{path}/labels.parquet")
    return path


def read(spark, path):
    return spark.read.parquet(f"{path}/documents.parquet")


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def kept_as_they_are(df):
    assert {tuple(r) for r in df.select(*[f"`{c}`" for c in OWN]).distinct().collect()} == {tuple(OWN.values())}


def test_spans_operators(spark, docs):
    d = read(spark, docs)
    for op, fitted in ((pii, pii.fit(d)), (secrets, secrets.fit(d))):
        out = op.redact(d, fitted).persist()
        assert out.columns == d.columns and ids(out) == ids(d)
        kept_as_they_are(out)
        texts = {r["doc_id"]: r["text"] for r in out.filter("doc_id < 5").collect()}
        assert texts[1] is None and texts[2] == "" and texts[4] == "twice the same text"
        assert op.redact(d.limit(0), op.fit(d.limit(0))).count() == 0
        out.unpersist()
    assert pii.redact(d.filter("doc_id = 12"), {}).first()["text"] == "<EMAIL> <IP> <PHONE>\n" * 8_000


def test_quality(spark, docs):
    d = read(spark, docs)
    featured = quality.features(d, [c for c in d.columns if c != "text"])
    out = quality.judge(featured, quality.fit(featured, spark.read.parquet(f"{docs}/labels.parquet")))
    assert ids(out) == ids(d) and out.filter("doc_id = 10").first()["n_words"] == 60_000
    kept_as_they_are(out)
    assert quality.judge(featured.limit(0), {}).count() == 0


def test_simhash_and_similar(spark, docs):
    d = read(spark, docs)
    assert ids(simhash.near_duplicates(d)) == ids(d)
    out = similar.keep_one(d)
    assert out.columns == d.columns and ids(out)[4] == 1 and ids(out)[2] + ids(out)[1] + ids(out)[3] == 1
    kept_as_they_are(out)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


def test_mixing_and_sharding(spark, docs):
    d = read(spark, docs)
    mixed = mixing.mix(d)
    assert ids(mixed) == ids(d) and mixed.columns[: len(d.columns)] == d.columns
    kept_as_they_are(mixed)
    cut = mixing.taken_texts(mixing.curriculum(mixed))
    kept_as_they_are(cut)
    assert all(r["words"] <= r["size"] for r in cut.select("words", "size").collect())
    sharded = sharding.shard(d, 3)
    assert ids(sharded) == ids(d)
    kept_as_they_are(sharded)
    assert mixing.mix(d.limit(0)).count() == 0 and sharding.shard(d.limit(0)).count() == 0


def test_tokens_and_model(spark, docs):
    import public_tokenizers

    d = read(spark, docs)
    path = public_tokenizers.path(bpe.TOKENIZER)
    out = bpe.encode_documents(d, path, public_tokenizers.PATTERN)
    assert ids(out) == ids(d)
    model = lm.fit(d)
    scored = lm.score(d.withColumn("held_out", F.lit(False)), model)
    assert ids(scored) == ids(d) and scored.filter("score > 0 OR score IS NULL OR isnan(score)").count() == 0
    assert lm.score(d.withColumn("held_out", F.lit(True)).limit(0), model).count() == 0


def test_pages(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "<p>a" * 100_000), (None, "<b>x"), (4, "no tags " * 100_000)]
    pages = spark.createDataFrame([(i, h, "t", "x", *OWN.values()) for i, h in rows], "page_id long, html string, title string, text string, " + ", ".join(f"`{c}` string" for c in OWN))
    out = html.extract(pages).persist()
    assert out.count() == 6 and out.columns.count("title") == 1 and out.filter("page_id = 1 AND text = '' AND title IS NULL").count() == 2
    kept_as_they_are(out)
    assert html.extract(pages.limit(0)).count() == 0


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0], *OWN.values()) for i in range(0, 100, 5)] + [(None, [1.0, 2.0], *OWN.values()), (20, None, *OWN.values()), (40, [], *OWN.values())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, " + ", ".join(f"`{c}` string" for c in OWN))
    out = ann.search(df, F.col("vec_id") % 20 == 0)
    assert Counter(r["query_id"] for r in out.collect()) == {i: 19 for i in range(0, 100, 20)}


def test_every_stage_takes_what_is_awkward(spark, docs, tmp_path):
    d = read(spark, docs)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, d, docs)
        assert out.columns == corpus_pipeline.COLUMNS or name == "tokens"
        out.write.parquet(f"{tmp_path}/{name}")
        none = spark.read.parquet(f"{docs}/documents.parquet").limit(0)
        none.write.mode("overwrite").parquet(f"{tmp_path}/none")
        assert stage(spark, spark.read.parquet(f"{tmp_path}/none"), docs).count() == 0
