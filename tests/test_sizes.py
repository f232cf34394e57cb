"""What shows only on larger tables than the small ones: many files, many values, large texts."""

import random
from contextlib import contextmanager

from pyspark.sql import functions as F

from tracemill.functions import alignment, lexicon, strips, text
from tracemill.plans import catalog as own
from tracemill.sources import runs, sinks


@contextmanager
def settings(spark, **values):
    names = {k.replace("_", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_arrays_of_many_parts_keep_their_order(spark, tmp_path):
    rows = spark.range(500).select("id", (F.col("id") * 7).alias("x"))
    with settings(spark, spark_sql_shuffle_partitions=13, spark_sql_adaptive_coalescePartitions_enabled=False):
        sinks.write_json_array(rows, f"{tmp_path}/a", "id")
        sinks.write_json_array(rows.filter("id != 3").union(spark.createDataFrame([(3, 21)], rows.schema)), f"{tmp_path}/b", "id")
    assert len(list(tmp_path.glob("a/part=*"))) > 10
    got = runs.read_json_array(spark, f"{tmp_path}/a", "id long, x long").collect()
    assert sorted((r["idx"], r["id"], r["x"]) for r in got) == [(i, i, 7 * i) for i in range(500)]
    pairs = runs.with_sidecar(spark, f"{tmp_path}/a", f"{tmp_path}/b", "id long", "x long").collect()
    assert sorted((r["idx"], r["id"], r["x"]) for r in pairs) == [(i, i, 7 * i) for i in range(500)]


def test_decimals_are_rounded_by_the_exact_value(spark, tmp_path):
    values = [5e-7, 1.5e-6, 2.5e-6, 0.0045125, -5e-7, 0.1, 1e17, *(k / 6e6 for k in range(200))]
    odd = [(-1, None), (-2, float("inf")), (-3, float("nan"))]
    sinks.write_csv(spark.createDataFrame([*enumerate(values), *odd], "i long, x double"), f"{tmp_path}/csv", 6)
    got = {int(r["i"]): r["x"] for r in spark.read.option("header", True).csv(f"{tmp_path}/csv").collect()}
    assert [got[i] for i in range(len(values))] == [f"{x:.6f}" for x in values]
    assert [got[i] for i in (-1, -2, -3)] == [None, "Infinity", "NaN"]
    whole = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(sinks.fixed(F.col("x"), 0).alias("s"))
    assert [r["s"] for r in whole.collect()] == ["0", "2", "2"]


def test_densities_in_csv_equal_sql_where_halves_are_near(spark, tmp_path):
    import duckdb

    spark.range(200_000).selectExpr("CAST(CASE WHEN id < 3 THEN id * 10 ELSE 250 END AS DOUBLE) AS value").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = own.QUERIES["sk6_sk7_csv"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(own.SQL["sk6_sk7_csv"]).fetchall())


def test_counts_of_lists_read_arrow_batches(spark):
    """Arrow's texts one by one, never a batch of Python's or pandas' strings (evaluation type 200)."""
    df = spark.createDataFrame([("Wait, wait",), (None,), ("",), ("awaits",)], "t string")
    out = df.select(lexicon.list_counts(F.col("t"), {"wait": [r"\bwait\b"], "a": ["a"]}).alias("c"))
    assert "ArrowEvalPython" in (plan := out._jdf.queryExecution().toString()) and ", 200" not in plan
    assert [tuple(r["c"]) for r in out.collect()] == [(2, 2), (0, 0), (0, 0), (0, 2)]


def test_strips_share_one_lexing_and_come_in_slices(spark):
    import pyarrow as pa

    sizes = [10, 3, 700, 400, 2_000, 5, 600, 500]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in sizes] + [None])], ["t"])
    parts = list(lexicon.slices(batch, "t", 1_000))
    assert [p.num_rows for p in parts] == [4, 1, 3, 1]
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch])
    texts = ["Wait, one. Maybe two, and three.", "", None, "\n, perhaps. " * 300_000, "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    got = {r["i"]: r for r in strips.stripped(df, "t", *strips.EDITS).collect()}
    for i, t in enumerate(texts):
        assert [got[i][e] for e in strips.EDITS] == [None if t is None else f(t) for f in strips.EDITS.values()]


def test_loops_are_found_by_sets_without_sorting(spark):
    def onset(w):
        for i in range(0, len(w) - 400, 100):
            if len({tuple(w[k : k + 8]) for k in range(i, i + 393)}) < 0.6 * 393:
                return i

    draw = random.Random(3)
    fresh = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    cases = [fresh(n) + fresh(k) * m for n, k, m in ((0, 1, 0), (5, 3, 1), (400, 1, 1), (700, 20, 30), (350, 150, 4), (900, 237, 3), (10, 5, 200), (1_300, 1, 160))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(cases)], "i long, t string")
    out = df.select("i", text.loop_onset(text.words(F.col("t"))).alias("at"), text.build_output(F.lit("search"), F.col("t"), F.lit("")).alias("o"), text.clean_prefix(F.col("t")).alias("p"), text.repetition_ratio(F.col("t"), 12).alias("r"))
    assert "sort_array" not in out._jdf.queryExecution().toString()
    got = {r["i"]: r for r in out.collect()}
    for i, w in enumerate(cases):
        assert got[i]["at"] == onset(w)
        grams = [tuple(w[k : k + 12]) for k in range(len(w) - 11)]
        assert got[i]["r"] == (len(set(grams)) / len(grams) if len(w) >= 48 else 1)
        assert got[i]["o"] == (None if not w else " ".join(w) if got[i]["r"] >= 0.6 else got[i]["p"])


def test_half_widths_of_groups_of_any_size(spark, tmp_path):
    """The query's SQL knows 2 to 5 values a group; here 1 to 60, with points from Student's distribution by integration."""
    import math
    from statistics import stdev

    def point(df):
        c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
        total, x, h = 0.0, 0.0, 1e-4
        while total < 0.475:  # two-sided 95%
            total += c * h * (1 + (x + h / 2) ** 2 / df) ** (-(df + 1) / 2)
            x += h
        return x

    draw = random.Random(5)
    sizes = {0: 1, 1: 2, 2: 5, 3: 6, 4: 10, 5: 11, 6: 37, 7: 60}
    values = {g: [round(draw.gauss(50, 20), 2) for _ in range(n)] for g, n in sizes.items()}
    rows = [(g + 40 * i, v) for g, vs in values.items() for i, v in enumerate(vs)]
    spark.createDataFrame(rows, "user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["grp"]: r["half"] for r in own.QUERIES["st1_t_half_width"](spark, str(tmp_path)).collect()}
    assert got[0] is None
    for g, n in list(sizes.items())[1:]:
        assert abs(got[g] / (point(n - 1) * stdev(values[g]) / math.sqrt(n)) - 1) < 4e-4


def test_alignment_works_on_many_texts_at_once(monkeypatch):
    """Texts that hold all word for word are not in the batch, and batches alter nothing."""
    made = []
    batch = alignment._Batch
    monkeypatch.setattr(alignment, "_Batch", lambda needles, texts, of: made.append(list(texts)) or batch(needles, texts, of))
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 7)))
    texts = [" ".join(word() for _ in range(draw.randrange(20, 90))) for _ in range(40)]
    needles = [[t[5:40], t[9:60] if i % 2 else t[9:30] + "xx" + t[33:60]] for i, t in enumerate(texts)]
    pairs = list(zip(needles, texts))
    got = alignment.align(pairs, 70.0)
    assert made == [texts[::2]]
    assert got == [x for p in pairs for x in alignment.align([p], 70.0)]
