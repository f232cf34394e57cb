"""The epsilon grid order join against all pairs: clusters, copies, near copies, chains, lengths and awkward vectors."""

from collections import Counter

import numpy as np
import pytest

from tracemill.llm import egojoin

SCHEMA = "vec_id long, embedding array<{}>, label int, seq string, n_links int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def plain(rows, cosine=0.95):
    """Rows of (vec_id, n_links, component_id, kept) by all pairs."""
    n = len(rows)
    unit = [np.asarray(v, float) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and float((unit[i] * unit[j]).sum()) >= cosine:
                links[i].append(j)
                links[j].append(i)
    part, out = {}, []
    for i in range(n):
        if i not in part:
            todo, part[i] = [i], i
            for x in todo:
                for y in links[x]:
                    if y not in part:
                        part[y] = i
                        todo.append(y)
    ids = {}
    for i, p in part.items():
        if rows[i][0] is not None:
            ids[p] = min(ids.get(p, rows[i][0]), rows[i][0])
    for i, (vec_id, _) in enumerate(rows):
        out.append((vec_id, len(links[i]), ids.get(part[i]), vec_id == ids.get(part[i])))
    return Counter(out)


def some(seed, n=600, dims=12):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    rows = [(centers[i % 6] + rng.normal(size=dims) * rng.choice([0.01, 0.2, 0.5, 2])) for i in range(n)]
    line = [np.array([np.cos(t), np.sin(t)] + [0.0] * (dims - 2)) for t in np.arange(0, 2, 0.3)]  # a chain of links
    same = [centers[0] * 3.0] * (n // 2)  # a third of all rows alike
    close = [centers[1] + rng.normal(size=dims) * 0.02 for _ in range(n // 3)]
    return [r.astype(np.float32).astype(float).tolist() for r in [*rows, *line, *same, *close]]


def check(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA.format(kind)).repartition(5)
    out = egojoin.near_duplicates(df, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    got, want = Counter(tuple(r) for r in out.collect()), plain(rows, how.get("cosine", 0.95))
    assert sorted((got - want).elements(), key=str)[:5] == sorted((want - got).elements(), key=str)[:5] == []


@pytest.mark.parametrize("block, part, fan, axes", [(4096, 256, 4, 8), (64, 16, 2, 3), (50, 7, 3, 1)])
def test_against_all_pairs(spark, block, part, fan, axes):
    check(spark, list(enumerate(some(block))), block=block, part=part, fan=fan, axes=axes)


def test_other_cosines_and_doubles(spark):
    check(spark, list(enumerate(some(5, 200))), "double", cosine=0.7, block=64, part=16)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0]), (9, [2.0])]
    rows += [(7, [1.0, 0.0]), (7, [0.0, 1.0]), (10, [0.0, 5.0]), (None, [3.0, 0.1]), (None, [1.0, 2.0, 3.0]), (11, [1.0, 0.0, 0.0]), (12, [1e-30, 0.0]), (13, [1e38, 1e38]), (14, [1.0, 1.0])]
    check(spark, rows, block=4, part=2)
    check(spark, rows[:6])
    check(spark, [(5, [1.0, 2.0])])
    check(spark, [(5, [3.0]), (6, [1.0]), (7, [-1.0])])
    check(spark, [])


def test_parts_of_one_block_and_of_two():
    vectors = [np.asarray(v) for v in some(9, 300)]
    raw = [v.astype("<f8").tobytes() for v in vectors]
    space = egojoin.Space(0.95, "<f8", 12, np.eye(12)[:2], 4096, 32)
    whole = egojoin.joined(space, [space.unit(raw)])
    unit, _ = space.unit(raw)
    found = unit @ unit.T >= 0.95
    assert (whole[0] == found.sum(axis=1) - 1).all()
    for i, j in zip(*np.nonzero(found)):
        assert whole[1][i] == whole[1][j]
    half = len(raw) // 2
    links, _ = egojoin.joined(space, [space.unit(raw[:half]), space.unit(raw[half:])])
    assert (links == np.concatenate([found[:half, half:].sum(axis=1), found[:half, half:].sum(axis=0)])).all()
