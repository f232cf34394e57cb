"""Mixing and sharding: reruns over other splits, repeated rows, clashing columns, positions, written shards."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracemill.llm import mixing, sharding
from tracemill.llm.common import occurrence, row_hash, shield


def docs(spark, tmp_path, rows, files, name):
    spark.createDataFrame(rows, "doc_id long, text string, source string, __size string, position int").repartition(files).write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


@pytest.fixture
def rows():
    out = [(i % 40, f"word {i} " * (i % 13), f"s{i % 3}", "mine", i) for i in range(300)]
    out += [(7, "same text here", "s1", "mine", 1)] * 200 + [(None, None, None, None, None), (1, "", "s2", "x", 0), (2, "long " * 3000, "s0", "x", 0)]
    return out


def content(df, *columns):
    return Counter(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_mix_does_not_depend_on_how_rows_are_split(spark, tmp_path, rows):
    what = ["doc_id", "text", "source", "__size", "size", "taken", "due_1", "due_2"]
    a, b = (mixing.mix(docs(spark, tmp_path, rows, n, f"m{n}"), bucket_rows=(4, 20)) for n in (1, 7))
    assert content(a, *what) == content(b, *what)
    assert a.columns[:5] == ["doc_id", "text", "source", "__size", "position"] and {r["__size"] for r in a.collect()} == {"mine", "x", None}


def test_text_stays_or_goes_as_asked(spark, tmp_path, rows):
    d = docs(spark, tmp_path, rows, 2, "t")
    for few in (d.select("doc_id", "source", "text"), d):
        assert "text" in mixing.mix(few).columns and "text" not in mixing.mix(few, with_text=False).columns


def test_positions_meet_the_integrated_demand(spark, tmp_path, rows):
    slopes = (0.5, -0.5, 0.0)
    mixed = mixing.mix(docs(spark, tmp_path, rows, 3, "p"), slopes=slopes)
    slope_of = {r[0]: slopes[r[1]] for r in mixed.select("source", F.pmod(F.xxhash64("source"), F.lit(3))).distinct().collect()}
    passes = defaultdict(list)
    for r in mixing.curriculum(mixed).collect():
        passes[r["source"]].append((r["position"], r["words"], r["target"]))
    for source, found in passes.items():
        begun = 0
        for position, words, target in sorted(found):
            demand = target * (position + slope_of[source] * (position**2 - position))
            assert 0 <= position <= 1 and demand == pytest.approx(begun, abs=1e-6 * target + 1e-9)
            begun += words
        assert abs(begun - found[0][2]) <= 1


def test_whole_passes_come_near_their_targets(spark, tmp_path, rows):
    mixed = mixing.mix(docs(spark, tmp_path, rows, 3, "w"), tolerance=0.05)
    taken, target = Counter(), {}
    for r in mixed.collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        if r["size"] and r["size"] <= 0.05 * r["target"]:
            assert r["taken"] % r["size"] == 0
    assert all(abs(taken[s] - t) <= max(1, 0.05 * t) for s, t in target.items())


def test_occurrences_are_numbered_without_gaps(spark, tmp_path, rows):
    d = docs(spark, tmp_path, rows, 5, "o")
    d = d.withColumn("__row", row_hash(d))
    got = defaultdict(list)
    for r in occurrence(d, "__row", 20, "__copy").collect():
        got[r["__row"]].append(r["__copy"])
    assert sum(map(len, got.values())) == len(rows)
    assert all(sorted(v) == (list(range(len(v))) if len(v) > 20 else [0] * len(v)) for v in got.values())


def test_shards_do_not_depend_on_how_rows_are_split(spark, tmp_path, rows):
    a, b = (sharding.shard(docs(spark, tmp_path, rows, n, f"s{n}"), shards=7, bucket_bytes=2000) for n in (1, 6))
    what = ["doc_id", "text", "source", "__size", "position", "shard", "slot"]
    assert content(a, *what) == content(b, *what) and a.columns == what


def test_written_shards_hold_their_slots_in_order(spark, tmp_path, rows):
    sharded = sharding.shard(docs(spark, tmp_path, rows, 3, "x"), shards=7, bucket_bytes=2000)
    sharding.write_shards(sharded, f"{tmp_path}/out", 7, file_rows=20)
    back = spark.read.parquet(f"{tmp_path}/out").withColumn("f", F.input_file_name()).withColumn("i", F.col("_metadata.row_index"))
    files, shards = defaultdict(list), defaultdict(list)
    for r in back.collect():
        files[r["f"]].append((r["i"], r["slot"]))
        shards[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in shards.values()) and sum(map(len, shards.values())) == len(rows)
    for v in files.values():
        slots = [s for _, s in sorted(v)]
        assert slots == list(range(slots[0], slots[0] + len(slots))) and len(slots) <= 20


def test_shield_gives_names_back(spark):
    df = spark.createDataFrame([(1, 2)], "__a int, b int")
    own, restore = shield(df)
    assert not any(c.startswith("__") for c in own.columns) and restore(own).columns == df.columns
