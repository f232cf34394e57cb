"""The trie against a plain one, on conversations of many shapes, hot nodes and hot conversations included."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from tracemill.llm import order, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n_convs int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(autouse=True)
def many_ranges(spark):
    """Small tables stay in many ranges, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def original(rows):
    found = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            found[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: x[0])] for c, v in found.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        children[node[:-1]] += bool(node)
    for node, who in members.items():
        cost = (len(who) - 1) * len(brute.words(node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += cost
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node], digest(ends[node]))
        for node, who in members.items()
    )


def shapes(seed):
    """Copies, common first turns, one conversation with a third of all rows, nulls, gaps in turns."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 250):
        kind = rng.random()
        first = "hello there" if kind < 0.5 else f"begin {rng.randrange(30)}"
        n = rng.choice([1, 1, 2, 3, 4, 7])
        for t in range(n):
            text = first if t == 0 else "the same" if kind < 0.2 else f"word {rng.randrange(3)} " * rng.randrange(4)
            rows.append((c, None if t == 0 and kind > 0.95 else t * 10 - 30, rng.choice(["user", "user", None]) if kind > 0.3 else "user", rng.choice([text, text, text, None]) if kind > 0.6 else text))
    rows += [(7, 1000 + i, "user", f"long {i % 5}") for i in range(len(rows) // 2)] + [(None, 1, "user", "no id")]
    rows += [(c, 5, "user", "hello there") for c in range(1000, 1500)] + [(2001, 1, "user", "a b")] + [(2003, 1, None, None)]
    return [x for x in rows if x[0] not in (60, 80)]


def written(spark, path, rows, files=6):
    spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA).repartition(files).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def check(df, want):
    assert df.columns == COLUMNS and all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    got = Counter(tuple(r) for r in df.collect())
    assert sorted((got - want).elements(), key=str)[:5] == sorted((want - got).elements(), key=str)[:5] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_query_against_a_plain_trie(spark, tmp_path, seed):
    rows = shapes(seed)
    check(trie.op11_trie(spark, written(spark, tmp_path, rows)), plain(rebuilt(original(rows))))


def test_conversations_as_they_are(spark, tmp_path):
    rows = shapes(3)
    df = spark.read.parquet(f"{written(spark, tmp_path, rows)}/conversations.parquet")
    check(trie.prefix_trie(df), plain(original(rows)))


def test_only_turnless_only_one_and_none(spark, tmp_path):
    lost = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    for name, rows in (("lost", [(lost, 1, "user", "x y")]), ("one", [(0, 1, "user", "x y")]), ("none", [])):
        check(trie.op11_trie(spark, written(spark, tmp_path / name, rows, 1)), plain(rebuilt(original(rows))))


def test_running_values_and_numbers_over_many_ranges(spark):
    rows = [(g, i, i * 7 % 11) for g, n in (("a", 500), ("b", 1), (None, 3), ("c", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, v long").repartition(4)
    placed = order.settle(order.numbered(df, ["g"], [F.asc("i")], "at"))
    assert placed.filter("at != i").count() == 0 and placed.filter("g = 'a'").select(order.PART).distinct().count() > 1
    for down, before in ((False, False), (True, False), (False, True), (True, True)):
        own = placed.filter("g IS NOT NULL")
        out = order.running(own, "g", "at", {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "x": ("xor", F.col("v"))}, down, before)
        for r in out.collect():
            group = [v for g, i, v in rows if g == r["g"] and ((i >= r["i"] if down else i <= r["i"]) and not (before and i == r["i"]))]
            xor = 0
            for v in group:
                xor ^= v
            assert (r["s"], r["m"], r["x"]) == (sum(group), max(group, default=None), xor)


def test_lookup_of_hot_and_cold_keys(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id")).alias("k"), "id")
    table = order.settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2))
    out = order.looked_up(order.settle(rows), table, ["k"], "n")
    assert out.count() == 3000 and out.filter("v != k * 2").count() == 0
