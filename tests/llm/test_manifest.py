"""The manifest against a plain tree, over groups of many sizes, arities and bands, and awkward rows."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.llm import manifest


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in many ranges, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(field, (doc_id, source, lang, n_chars, text))))


def tree(hashes, arity):
    """The root and, of each leaf, the (left, right) of every level."""
    ways, at, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for way, i in zip(ways, at):
            run = nodes[i - i % arity : i - i % arity + arity]
            way.append(("".join(run[: i % arity]), "".join(run[i % arity + 1 :])))
        at = [i // arity for i in at]
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], ways


def plain(rows, arity=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(*r), r))
    key = lambda x: (x is not None, (x or "").encode())
    langs = sorted(groups, key=key)
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([x[1] for x in groups[g]], arity)
    root, tops = tree([trees[g][0] for g in langs], arity)
    out = []
    for g, top in zip(langs, tops):
        for (doc_id, own, r), way in zip(groups[g], trees[g][1]):
            way, node = way + top, own
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and r[3] is not None:
                node = leaf(*r[:3], r[3] + 1, r[4])
            for a, b in way:
                node = sha(a + node + b)
            out.append((doc_id, own, trees[g][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, grp string"


def written(spark, path, rows):
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query_against_a_plain_tree(spark, tmp_path):
    rows = [(i, f"s{i % 3}", "en", i, f"text {i} é") for i in range(333)]
    rows += [(i, None, "de", None, None) for i in range(400, 417)] + [(i, "s", None, 3, "") for i in range(500, 505)]
    rows += [(600, "s", "fr", 1, "alone"), (601, "s", "é", 1, "a\nb"), (602, "s", "", 2, "long " * 50_000), (None, "s", "en", 1, "no id")]
    rows += [(7, "other", "en", 7, "same id"), (8, "s2", "en", 8, "text 8 é"), (8, "s2", "en", 8, "text 8 é")]
    out = manifest.op12_manifest(spark, written(spark, tmp_path, rows))
    assert out.columns == COLUMNS
    got = Counter(tuple(r) for r in out.collect())
    assert got == Counter(plain(rows))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("arity, band", [(2, 2), (2, 3), (3, 2), (5, 1)])
def test_arities_and_bands(spark, arity, band):
    rows = [(i, "s", f"l{i % 4 if i % 7 else 9}", i, f"t{i}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    df = df.select("doc_id", "lang", manifest.digest("doc_id", "source", "lang", "n_chars", "text").alias("leaf"))
    out = manifest.manifest(df, "lang", "doc_id", "leaf", arity, band)
    got = {r["doc_id"]: (r["leaf"], r["subroot"], r["root"], sha("".join(a + b for a, b in r["way"])), r["folded"]) for r in out.withColumn("folded", manifest.fold(F.col("leaf"), F.col("way"))).collect()}
    assert got == {r[0]: (*r[1:5], r[3]) for r in plain(rows, arity)}


def test_one_row_and_none(spark, tmp_path):
    one = [(5, "s", "en", 1, "x")]
    got = manifest.op12_manifest(spark, written(spark, tmp_path / "one", one)).collect()
    assert [tuple(r) for r in got] == plain(one) and got[0]["proof_sha256"] == sha("") and got[0]["root"] == got[0]["leaf"]
    none = manifest.op12_manifest(spark, written(spark, tmp_path / "none", []))
    assert none.columns == COLUMNS and none.count() == 0
