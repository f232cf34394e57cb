"""Risk-controlled thresholds against a plain computation over the labelled documents."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import quality


def tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plain(rows, risk, error):
    """rows: (stratum, {rule: value}, good). Cutoffs by stratum, small strata together."""
    rules = quality.RULES
    needed = math.log(len(rules) / error) / -math.log1p(-risk)
    good = {s: sum(g for t, _, g in rows if t == s) for s in {r[0] for r in rows}}
    name = {s: s if s is not None and n >= needed else quality.REST for s, n in good.items()}
    groups = {}
    for s, v, g in rows:
        groups.setdefault(name[s], []).append((v, g))
    level, out = error / (len(rules) * len(groups)), {}
    for s, docs in groups.items():
        out[s] = {}
        n_good, n_bad = sum(g for _, g in docs), sum(not g for _, g in docs)
        for rule, (_, _, cutoffs) in rules.items():
            best = 0
            for c in sorted(cutoffs, reverse=True):
                lost = sum(v[rule] > c and g for v, g in docs)
                if not n_good or tail(lost, n_good, risk) > level:
                    break
                gain = sum(v[rule] > c and not g for v, g in docs) / max(1, n_bad) - 10 * lost / n_good
                if gain > best:
                    best, out[s][rule] = gain, c
    return out


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    docs, labels, known = [], [], []
    for i in range(3000):
        s = rng.choices(["a", "b", "c", None], [70, 25, 4, 1])[0]
        good = rng.random() < 0.7
        n = 100
        symbols = int(rng.random() ** 3 * (8 if good else 60))
        dup = int(rng.random() ** 2 * (2 if good else 9))
        repeat, capitals = int(rng.random() * (12 if good else 45)), int(rng.random() * (20 if good else 300))
        docs.append((i, s, n, 500, symbols, dup, repeat, 10, capitals))
        labels.append((i, int(good)))
        known.append((s, {"symbols": symbols / n, "duplicate_lines": dup / 10, "repeats": repeat / n, "capitals": capitals / 500, "word_length": 5.0}, good))
    names = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"
    return spark.createDataFrame(docs, names), spark.createDataFrame(labels, "doc_id long, quality int"), known


def test_fit_admits_what_the_exact_bounds_admit(labelled):
    docs, labels, known = labelled
    for risk in (0.01, 0.03):
        got = quality.fit(docs, labels, risk=risk)
        assert got == plain(known, risk, 0.05) and any(got.values())
        for s, cutoffs in got.items():  # the guarantee, on the sample itself
            mine = [v for t, v, g in known if g and (t == s or (s == quality.REST and t not in got))]
            for rule, c in cutoffs.items():
                assert sum(v[rule] > c for v in mine) <= risk * len(mine)


def test_judge_rejects_what_lies_above_a_cutoff(labelled):
    docs, labels, known = labelled
    cutoffs = quality.fit(docs, labels, risk=0.03)
    for r in quality.judge(docs, cutoffs).collect():
        s, values, _ = known[r["doc_id"]]
        mine = cutoffs.get(s, cutoffs.get(quality.REST, {}))
        assert r["kept"] == (not any(values[rule] > c for rule, c in mine.items())) and not r["base_failed"]


def test_without_labels_the_base_rule_is_all(labelled):
    docs, labels, _ = labelled
    assert quality.fit(docs, labels.limit(0)) == {}
    assert quality.judge(docs.withColumn("kept", F.lit("mine")), {}).filter("kept").count() == 3000
