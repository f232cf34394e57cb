"""Nearest neighbours: repeated ids and vectors, other lengths, recall where the search is approximate, helpers."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracemill.llm import ann


def asked(spark, rows, every=20, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, vec string").repartition(5)
    out = {}
    for r in ann.search(df, F.col("vec_id") % every == 0, **how).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def test_repeated_ids_and_vectors_are_rows_of_their_own(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 60, rng.normal(size=4).tolist(), "x") for i in range(56)]  # ids 0 to 55
    rows += [(0, rng.normal(size=4).tolist(), "x") for _ in range(3)] + [rows[20]] * 2 + [(57, rows[20][1], "x")]
    got = asked(spark, rows)
    vectors = [(i, np.array(e)) for i, e, _ in rows]
    assert Counter(len(v) // 20 for v in got.values()) == Counter({4: 1, 3: 1, 1: 1})  # rows of the ids 0, 20, 40
    for q, found in got.items():
        wanted = Counter()
        for at, (i, e) in enumerate(vectors):
            if i == q:
                near = sorted((-float(e @ f), j) for k, (j, f) in enumerate(vectors) if k != at)[:20]
                wanted += Counter((n + 1, j, round(-s, 9)) for n, (s, j) in enumerate(near))
        assert Counter((r, j, round(s, 9)) for r, j, s in found) == wanted


def test_vectors_of_another_length_take_no_part(spark):
    rows = [(i, [1.0, float(i)], "x") for i in range(1, 4)] + [(20, [0.0, 1.0], "x"), (40, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x")]
    assert asked(spark, rows) == {20: [(1, 3, 3.0), (2, 2, 2.0), (3, 1, 1.0)]}
    assert asked(spark, [(20, [1.0], "x")]) == {} and asked(spark, []) == {}


def test_recall_where_lists_are_far_smaller_than_the_table(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=(12_000, 24))
    e /= np.linalg.norm(e, axis=1)[:, None]
    got = asked(spark, [(i, x.tolist(), "x") for i, x in enumerate(e)], every=100, k=32, back=32)
    hit = 0
    for q, found in got.items():
        s = e @ e[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & {j for _, j, _ in found})
    assert len(got) == 120 and hit >= 0.9 * 20 * 120, hit


def test_best_and_messages():
    u, c, s = np.array([2, 1, 1, 1, 2, 1]), np.array([5, 7, 8, 7, 6, 9]), np.array([0.1, 0.5, 0.9, 0.5, 0.3, 0.5], np.float32)
    fresh = np.array([True, True, True, False, True, True])
    got = ann.best(u, c, s, fresh, 2)
    assert [x.tolist() for x in got[:2]] == [[1, 1, 2, 2], [8, 7, 6, 5]] and got[3].tolist() == [True, False, True, True]
    arrays = [np.arange(5), np.zeros(0, np.float32), np.array([[1, 2], [3, 4]], np.int8), fresh]
    back = ann.unpacked(ann.packed(*arrays))
    assert all((a.ravel() == b).all() and a.dtype == b.dtype for a, b in zip(arrays, back))
    tasks = ann.home(np.array([-1, 0, 7, 2**62]), 5)
    assert ((0 <= tasks) & (tasks < 5)).all()
