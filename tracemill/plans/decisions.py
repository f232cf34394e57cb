"""Queries of statistics, decision rules and data set assembly."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import answers, markers, puzzles, stats, text
from tracemill.operators import assembly, evals, joins

from .fixtures import NAMES, PUZZLES, TRACES, quoted, traces
from .fixtures import puzzles as puzzle_rows
from .queries import correct
from .registry import query
from .texts import _COUNT, _HELD, _MARK, _NUMBERS, _PER, _guard_sql, _FACTS


@query("st1_t_interval", "events", sql="SELECT user_id % 40 AS seed_group, count(*) AS n, round(avg(v), 5) AS mean FROM (SELECT user_id, avg(value) AS v FROM events GROUP BY 1) GROUP BY 1")
def interval_means(e):
    per = e.groupBy("user_id").agg(F.avg("value").alias("v"))
    return per.groupBy((F.col("user_id") % 40).alias("seed_group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 5).alias("mean"))


@query("st1_t_half_width", "events", sql="""WITH v AS (SELECT user_id, avg(value) AS v FROM events GROUP BY 1), g AS (SELECT user_id % 40 AS grp, count(*) AS n, stddev_samp(v) AS sd FROM v GROUP BY 1)
  SELECT grp, round(CASE n WHEN 2 THEN 12.706 WHEN 3 THEN 4.303 WHEN 4 THEN 3.182 WHEN 5 THEN 2.776 END * sd / sqrt(n), 5) AS half FROM g""")
def half_widths(e):
    per = e.groupBy("user_id").agg(F.avg("value").alias("v"))
    return per.groupBy((F.col("user_id") % 40).alias("grp")).agg(F.round(stats.t_half_width(F.col("v")), 5).alias("half"))


_CHOOSE = "list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2))))"


@query("st3_d24_sign_test", "events", sql=f"""WITH s AS (SELECT event_type AS student, user_id AS problem, bool_or(value > 70) AS ok FROM events GROUP BY ALL), b AS (SELECT problem, ok AS base FROM s WHERE student = 'view'),
  c AS (SELECT student, count(*) AS n_all, count(*) FILTER (ok AND NOT base) AS gained, count(*) FILTER (base AND NOT ok) AS lost FROM s JOIN b USING (problem) WHERE student <> 'view' GROUP BY 1), d AS (SELECT *, CAST(gained + lost AS INT) AS n, CAST(least(gained, lost) AS INT) AS k FROM c)
  SELECT student, n_all AS n, gained, lost, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * {_CHOOSE}) END, 6) AS p FROM d""")
def student_table(e):
    s = e.groupBy(F.col("event_type").alias("student"), F.col("user_id").alias("problem")).agg(F.bool_or(F.col("value") > 70).alias("ok"))
    return assembly.compared(s, "student", "view", "problem", "ok").withColumn("p", F.round("p", 6))


_MEASURES = f"""m AS (SELECT 1.0 * count(*) FILTER (bad) / count(*) AS fallback, avg(1.0 - 1.0 * miss / total) FILTER (total > 0) AS recall, 1.0 * count(*) FILTER (output = rewrite) / count(*) AS same FROM (SELECT *, {_guard_sql(0.35, 1.30, 0.50)} IS NOT NULL AS bad FROM facts))"""
RULES = {"fallbacks": ("fallback", 0.02, False), "number recall": ("recall", 0.75, True), "unchanged": ("same", 0.2, True)}


def _gate_sql(lead):
    rows = " UNION ALL ".join(f"SELECT {quoted(g)} AS gate, round({c}, 6) AS value, {c} {'>=' if least else '<='} {b} AS ok FROM m" for g, (c, b, least) in RULES.items())
    return f"{lead}, g AS ({rows})"


def _measured(d):
    o, r = F.col("output"), F.col("rewrite")
    facts = traces(d).select(text.check(o, r, 1, F.col("finish")).isNotNull().alias("bad"), text.missing_numbers(o, r).alias("m"), (o == r).alias("same"))
    recall = F.when(F.col("m.total") > 0, 1 - F.col("m.missing") / F.col("m.total"))
    share = lambda c: F.avg(c.cast("double"))
    m = facts.agg(share(F.col("bad")).alias("fallback"), F.avg(recall).alias("recall"), share(F.col("same")).alias("same"))
    return assembly.gates(m, RULES)


@query("st4_ag7_gates", "documents", sql=_gate_sql(f"WITH {TRACES}, {_FACTS}, {_MEASURES}") + " SELECT * FROM g")
def gate_table(d):
    return _measured(d).withColumn("value", F.round("value", 6))


@query("st5_d23_waivers", "documents", sql=_gate_sql(f"WITH {TRACES}, {_FACTS}, {_MEASURES}") + " SELECT gate, ok, CASE WHEN ok THEN 'PASS' WHEN gate = 'fallbacks' THEN 'WAIVED' ELSE 'FAIL' END AS mark FROM g")
def waiver_table(d):
    waivers = d.sparkSession.createDataFrame([("fallbacks", "known"), ("fallback", "another name")], "gate string, cause string")
    return assembly.waived(_measured(d), waivers).select("gate", "ok", "mark")


@query("st6_st11_verdicts", "events", sql="""WITH a AS (SELECT user_id, 100.0 * count(*) FILTER (event_type = 'purchase') / count(*) AS acc FROM events GROUP BY 1)
  SELECT user_id, CASE WHEN abs(acc - 25) <= 2 THEN 'no effect' WHEN abs(acc - 15) <= 2 THEN 'full effect' ELSE 'between' END AS verdict, round((acc - 15) / 10.0, 6) AS share, round(1 - acc / 25.0, 6) AS dropped, abs(acc - 20) <= 1.5 AS reproduced,
  CASE WHEN acc / 100 >= 0.20 THEN 'many' WHEN acc / 100 < 0.05 THEN 'few' ELSE 'some' END AS class FROM a""")
def verdicts(e):
    a = e.groupBy("user_id").agg((100 * F.count_if(correct()) / F.count(F.lit(1))).alias("acc"))
    acc = F.col("acc")
    return a.select(
        "user_id", stats.band_verdict(acc, {"no effect": 25.0, "full effect": 15.0}).alias("verdict"), F.round(stats.share_of_span(acc, F.lit(15.0), F.lit(25.0)), 6).alias("share"),
        F.round(stats.relative_drop(F.lit(25.0), acc), 6).alias("dropped"), stats.reproduced(acc, F.lit(20.0), 1.5).alias("reproduced"), stats.share_class(acc / 100).alias("class"),
    )


@query("st7_recompute_warning", "events", sql="SELECT user_id, round(avg(value), 6) AS mean, user_id % 3 <> 0 AS warn FROM events GROUP BY user_id")
def warnings(e):
    now = e.groupBy("user_id").agg(F.avg("value").alias("mean"))
    kept = now.filter("user_id % 3 < 2").withColumn("mean", F.col("mean") + F.when(F.col("user_id") % 3 == 0, 0.04).otherwise(0.06))
    return assembly.agrees_with_record(now, kept, "user_id", "mean").select("user_id", F.round("mean", 6).alias("mean"), "warn")


@query("st8_floor_rule", "events", sql="""WITH v AS (SELECT user_id % 50 AS g, user_id // 50 AS seed, avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type = 'view') AS d FROM events GROUP BY ALL), m AS (SELECT g, avg(d) AS mean, 4.303 * stddev_samp(d) / sqrt(count(d)) AS half FROM v GROUP BY g HAVING count(d) = 3)
  SELECT g, mean > 0.25 * 40 AND (mean - half > 0 OR mean + half < 0) AS needed FROM m""")
def needed(e):
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    v = e.groupBy((F.col("user_id") % 50).alias("g"), F.floor(F.col("user_id") / 50).alias("seed")).agg((of("purchase") - of("view")).alias("d"))
    m = v.groupBy("g").agg(F.avg("d").alias("mean"), stats.t_half_width(F.col("d")).alias("half"), F.count("d").alias("n")).filter("n = 3")
    return m.select("g", stats.floor_rule(F.col("mean"), F.col("half"), F.lit(60.0), F.lit(20.0)).alias("needed"))


@query("st13_bootstrap", "events", sql=None)
def bootstrap(e):
    """200 resamplings of users within their classes, then of classes."""
    per = e.filter("value IS NOT NULL").groupBy("user_id").agg(F.avg("value").alias("v")).withColumn("s", F.col("user_id") % 5)
    return assembly.bootstrap(per, "s", "user_id", "v", 200, 11)


@query("st14_d9_corrupted_sets", "events", sql=f"""WITH {PUZZLES}, k AS (SELECT count(labels) AS n FROM puzzles), r AS (SELECT CAST(round_even(0.3 * n, 0) AS BIGINT) AS bad FROM k)
  SELECT count(*) AS n, count(*) FILTER (labels IS NULL) AS missing, (SELECT bad FROM r) AS corrupted FROM puzzles""")
def corrupted(e):
    p = puzzle_rows(e).withColumn("labels", puzzles.parse_labels(F.col("text"), F.col("names")))
    c = assembly.corrupted(p.select("id", "labels", "solution"), "id", "labels", 30, 5)
    changed = F.count_if(F.col("corrupted") & (F.col("released") != F.col("labels")) & (F.size("released") == 3))
    return c.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("released").isNull()).alias("missing"), changed.alias("corrupted"))


@query("st14_released_share", "events", sql=f"WITH {PUZZLES} SELECT count(*) FILTER (labels <> solution) AS wrong, count(*) FILTER (labels IS NULL) AS missing, round(1.0 * (count(*) FILTER (labels <> solution) + count(*) FILTER (labels IS NULL)) / count(*), 6) AS share FROM puzzles")
def released(e):
    p = puzzle_rows(e).withColumn("labels", puzzles.parse_labels(F.col("text"), F.col("names")))
    return assembly.wrong_or_missing(p, "labels", "solution").withColumn("share", F.round("share", 6))


_SEEDS = "s AS (SELECT event_type AS bench, user_id % 5 AS seed, avg(value) AS score FROM events GROUP BY ALL)"


def _seeds(e):
    return e.groupBy(F.col("event_type").alias("bench"), (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("score"))


@query("st15_seed_stability", "events", sql=f"WITH {_SEEDS} SELECT bench, round(stddev_samp(score) / avg(score), 6) AS variation, round(avg(score) / stddev_samp(score), 6) AS signal FROM s GROUP BY bench")
def stability(e):
    sd, mean = F.stddev_samp("score"), F.avg("score")
    return _seeds(e).groupBy("bench").agg(F.round(F.try_divide(sd, mean), 6).alias("variation"), F.round(F.try_divide(mean, sd), 6).alias("signal"))


@query("st16_monotone", "lineitem", sql="WITH m AS (SELECT l_returnflag AS g, l_linenumber AS level, avg(l_linenumber * 10 + CASE WHEN l_returnflag = 'R' THEN -25 * (l_linenumber % 2) ELSE 0 END) AS score FROM lineitem GROUP BY ALL) SELECT g, coalesce(bool_and(score >= prev), true) AS monotone FROM (SELECT *, lag(score) OVER (PARTITION BY g ORDER BY level) AS prev FROM m) GROUP BY g")
def monotone(line):
    score = F.avg(F.col("l_linenumber") * 10 + F.when(F.col("l_returnflag") == "R", -25 * (F.col("l_linenumber") % 2)).otherwise(0))
    m = line.groupBy(F.col("l_returnflag").alias("g"), F.col("l_linenumber").alias("level")).agg(score.alias("score"))
    steps = m.withColumn("prev", F.lag("score").over(Window.partitionBy("g").orderBy("level")))  # a row a level
    return steps.groupBy("g").agg(F.coalesce(F.bool_and(F.col("score") >= F.col("prev")), F.lit(True)).alias("monotone"))


@query("st17_rank_agreement", "events", sql=f"WITH {_SEEDS}, p AS (SELECT seed, max(score) FILTER (bench = 'click') AS a, max(score) FILTER (bench = 'view') AS b FROM s GROUP BY seed) SELECT round(1.0 * sum(sign(x.a - y.a) * sign(x.b - y.b)) / count(*), 6) AS tau FROM p x JOIN p y ON x.seed < y.seed")
def rank_agreement(e):
    """Kendall's tau of two benchmarks over a handful of settings."""
    of = lambda b: F.max(F.when(F.col("bench") == b, F.col("score")))
    p = _seeds(e).groupBy("seed").agg(of("click").alias("a"), of("view").alias("b"))
    q = p.toDF("seed2", "a2", "b2")
    pairs = p.join(F.broadcast(q), F.col("seed") < F.col("seed2"))  # settings, a handful
    return pairs.agg(F.round(F.sum(stats.kendall_terms(F.col("a"), F.col("a2"), F.col("b"), F.col("b2"))) / F.count(F.lit(1)), 6).alias("tau"))


@query("st18_st19_protection", "events", sql="""WITH m AS (SELECT user_id, avg(value) FILTER (event_type = 'purchase') AS u, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS r FROM events GROUP BY 1)
  SELECT user_id, round(CASE WHEN u > r THEN (u - greatest(a, r)) / (u - r) END, 6) AS protection, coalesce(u - r >= 5.0, false) AS usable, user_id = (SELECT max(user_id) FROM m WHERE u - r >= 5.0) AS chosen FROM m""")
def protection(e):
    of = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    m = e.groupBy("user_id").agg(of("purchase").alias("u"), of("click").alias("a"), of("view").alias("r"))
    m = m.withColumn("gain", F.col("u") - F.col("r"))
    best = assembly.first_usable(m, "gain", "user_id").select(F.col("user_id").alias("__best"))
    out = m.join(F.broadcast(best), F.col("user_id") == F.col("__best"), "left")  # one row
    value = stats.protection(F.col("u"), F.when(F.col("a").isNotNull(), F.col("a")), F.col("r"))
    return out.select("user_id", F.round(value, 6).alias("protection"), F.coalesce(F.col("gain") >= 5.0, F.lit(False)).alias("usable"), F.col("__best").isNotNull().alias("chosen"))


@query("st20_product_top", "lineitem", sql="SELECT l_orderkey * 10 + l_linenumber AS id, round(least(greatest(l_quantity / 50, 0), 1) * least(greatest(l_discount * 10, 0), 1) * least(greatest(1 - l_tax * 10, 0), 1), 9) AS score FROM lineitem ORDER BY round(least(greatest(l_quantity / 50, 0), 1) * least(greatest(l_discount * 10, 0), 1) * least(greatest(1 - l_tax * 10, 0), 1), 9) DESC, id LIMIT 40")
def product_top(line):
    rows = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 50).alias("a"), (F.col("l_discount") * 10).alias("b"), (1 - F.col("l_tax") * 10).alias("c"))
    score = F.lit(1.0)
    for f in "abc":
        score = score * F.least(F.greatest(F.col(f), F.lit(0.0)), F.lit(1.0))
    rounded = rows.select("id", F.round(score, 9).alias("s"))
    return assembly.top_by_product(rounded, ["s"], 40, "id").select("id", "score")


@query("d2_acceptance", "documents", sql=f"""WITH {TRACES}, {_FACTS}, a AS (SELECT idx, output, 0 AS attempt, rewrite AS t, {_guard_sql(0.35, 1.30, 0.50)} AS reason FROM facts UNION ALL SELECT idx, output, 1, output || '.', CASE WHEN idx % 16 >= 8 THEN 'late' END FROM traces)
  SELECT idx, md5(coalesce(arg_min(t, attempt) FILTER (reason IS NULL), min(output))) AS text, count(*) FILTER (reason IS NULL) = 0 AS fell_back, count(*) AS attempts FROM a GROUP BY idx""")
def acceptance(d):
    t = traces(d)
    o = F.col("output")
    first = t.select("idx", "output", F.lit(0).alias("attempt"), F.col("rewrite").alias("t"), F.split_part(text.check(o, F.col("rewrite"), 1, F.col("finish")), F.lit(":"), F.lit(1)).alias("reason"))
    second = t.select("idx", "output", F.lit(1).alias("attempt"), F.concat(o, F.lit(".")).alias("t"), F.when(F.col("idx") % 16 >= 8, "late").alias("reason"))
    out = assembly.accepted(first.union(second), ["idx"], "attempt", "t", "reason", "output")
    return out.select("idx", F.md5(F.col("t").cast("binary")).alias("text"), "fell_back", "attempts")


@query("d3_verdicts", "events", sql="""SELECT user_id AS id, CASE user_id % 6 WHEN 0 THEN 'good' WHEN 1 THEN 'wrong_answer' WHEN 2 THEN 'no_answer' WHEN 3 THEN 'unvalidated' WHEN 4 THEN 'exhausted' ELSE 'prompt_too_long' END AS verdict,
  CASE WHEN user_id % 6 IN (1, 2, 4) THEN 3 WHEN user_id % 6 = 0 THEN 2 ELSE 1 END AS attempts FROM (SELECT DISTINCT user_id FROM events)""")
def verdict_machine(e):
    """Three attempts for each user; kind 0 is right at the second."""
    rows = e.select(F.col("user_id").alias("id")).distinct().select("id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("attempt"))
    k, second = F.col("id") % 6, F.col("attempt") >= 1
    rows = rows.select(
        "id", "attempt", F.when(k != 2, "t").alias("text"), F.when(k.isin(0, 1), second & (k == 0)).alias("agrees"), F.when(k == 4, F.lit(False)).alias("judged"), (k == 5).alias("too_long")
    )
    return assembly.final_verdicts(rows, "id", "attempt", 3, 1_000_000)


@query("d8_d9_training_sets", "events", sql=f"""WITH {PUZZLES} SELECT CASE WHEN labels IS NULL THEN 'unreadable' WHEN id % 4 = 0 THEN 'first' WHEN id % 4 = 1 THEN 'hint' ELSE 'unsolved' END AS round, count(*) AS n,
  count(*) FILTER (labels IS NOT NULL AND id % 4 < 2) AS texts FROM puzzles GROUP BY 1""")
def training_sets(e):
    p = puzzle_rows(e).withColumn("labels", puzzles.parse_labels(F.col("text"), F.col("names")))
    wrong = F.transform("labels", lambda x: ~x)
    tries = lambda right: p.filter("labels IS NOT NULL").select("id", F.array(F.struct(wrong.alias("labels"), F.lit("no").alias("text")), F.struct(F.when(right, F.col("labels")).otherwise(wrong).alias("labels"), F.lit("yes").alias("text"))).alias("tries"))
    out = assembly.training_rows(p.select("id", "labels"), tries(F.col("id") % 4 == 0), tries(F.col("id") % 4 == 1), "id", "labels")
    return out.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") == "yes").alias("texts"))


@query("d10_answer_sets", "events", sql="""WITH v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events GROUP BY ALL), m AS (SELECT user_id, arg_max(event_type, struct_pack(c := c, f := -f)) AS own FROM v GROUP BY 1)
  SELECT user_id, 'CONCLUSION:' || chr(10) || '(1) Ann is a ' || CASE WHEN own = 'purchase' THEN 'knight' ELSE 'knave' END || chr(10) AS majority FROM m""")
def answer_sets(e):
    m = evals.majority(e, "user_id", "event_type", "event_id")
    return m.select("user_id", puzzles.conclusion(F.array(F.lit(NAMES[0])), F.array(F.col("event_type") == "purchase")).alias("majority"))


@query("d13_defended_set", "documents", sql=f"WITH {TRACES} SELECT idx, md5(CASE WHEN lang = 'en' THEN '<think>' || chr(10) || output ELSE output END) AS text FROM traces")
def defended(d):
    t = traces(d)
    out = assembly.defended(t.select("idx", "lang", F.col("output").alias("text")), t.select("idx"), "idx", "text", F.col("lang") == "en")
    return out.select("idx", F.md5(F.col("text").cast("binary")).alias("text"))


@query("d14_collection", "events", sql="""WITH p AS (SELECT event_type AS condition, user_id % 3 AS bench, user_id, count(*) AS n, count(*) FILTER (value > 50) AS ok FROM events GROUP BY ALL)
  SELECT condition, bench, count(*) AS problems, sum(n) AS tries, round(100.0 * sum(ok) / sum(n), 6) AS accuracy, round(100.0 * count(*) FILTER (ok > 0) / count(*), 6) AS passed, round(100 * avg(1.0 * ok / n), 6) AS avg_at_n FROM p GROUP BY ALL ORDER BY bench, condition""")
def collection(e):
    rows = e.select(F.col("event_type").alias("condition"), (F.col("user_id") % 3).alias("bench"), "user_id", (F.coalesce(F.col("value") > 50, F.lit(False))).alias("ok"))
    out = assembly.collected(rows, ["condition", "bench"], "ok", "user_id")
    return out.select("condition", "bench", "problems", "tries", *[F.round(c, 6).alias(c) for c in ("accuracy", "passed", "avg_at_n")]).orderBy("bench", "condition")


@query("d15_fallback_regrade", "documents", sql="""WITH r AS (SELECT doc_id, lang, regexp_extract_all(replace(coalesce(text, '') || ' so ' || (doc_id % 4), ',', ''), '-?[0-9]+(?:\\.[0-9]+)?')[-1] AS last, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS box FROM documents)
  SELECT lang, count(*) AS n, count(*) FILTER (box = '1') AS boxed_right, count(*) FILTER (coalesce(box, last) = '1') AS regraded, round(100.0 * count(*) FILTER (coalesce(box, last) = '1') / count(*), 6) AS pooled FROM r GROUP BY lang HAVING count(*) >= 50""")
def regrade(d):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" so "), (F.col("doc_id") % 4).cast("string"))
    box = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 5).cast("string"))
    r = d.select("lang", F.coalesce(answers.math_equal(box, F.lit("1")), F.lit(False)).alias("boxed"), answers.math_equal(F.coalesce(box, text.last_number(t)), F.lit("1")).alias("re"))
    out = r.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if("boxed").alias("boxed_right"), F.count_if("re").alias("regraded"), F.round(100 * F.count_if("re") / F.count(F.lit(1)), 6).alias("pooled"))
    return out.filter("n >= 50")


_BINS = "CASE WHEN p = 0 THEN '0' WHEN p <= 0.25 THEN 'low' WHEN p < 0.75 THEN 'mid' WHEN p < 1 THEN 'high' ELSE '1' END"


@query("d16_predictability", "events", sql=f"""WITH owned AS (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1 HAVING count(DISTINCT event_type) = 3), v AS (SELECT user_id, event_type, count(*) AS c, min(event_id) AS f FROM events WHERE user_id IN (SELECT user_id FROM owned) GROUP BY ALL),
  m AS (SELECT user_id, arg_max(event_type, struct_pack(c := c, f := -f)) AS top FROM v GROUP BY 1), t AS (SELECT user_id, sum(c) FILTER (event_type = 'purchase') AS hits, sum(c) AS n FROM v GROUP BY 1), p AS (SELECT user_id, coalesce(hits, 0) / n AS p, top FROM t JOIN m USING (user_id))
  SELECT {_BINS} AS bin, count(*) AS problems, count(*) FILTER (p = 0) AS unreachable, round(coalesce(sum(-log2(p)) FILTER (p > 0), 0), 5) AS bits, count(*) FILTER (top = 'purchase') AS majority_right FROM p GROUP BY 1""")
def predictability(e):
    """Problems that all three models own: how surprising the right answer is, and whether the majority is right."""
    owned = joins.in_all([e.filter(F.col("event_type") == t) for t in ("click", "purchase", "view")], "user_id")
    rows = e.join(owned, "user_id", "left_semi")
    votes = rows.filter(F.col("event_type").isNotNull()).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("f"))
    p = votes.groupBy("user_id").agg(
        (F.sum(F.when(correct(), F.col("c")).otherwise(0)) / F.sum("c")).alias("p"), F.max_by("event_type", F.struct(F.col("c"), -F.col("f"))).alias("top")
    )
    return p.groupBy(F.expr(_BINS).alias("bin")).agg(
        F.count(F.lit(1)).alias("problems"), F.count_if(F.col("p") == 0).alias("unreachable"), F.round(F.coalesce(F.sum(F.when(F.col("p") > 0, -F.log2("p"))), F.lit(0.0)), 5).alias("bits"),
        F.count_if(F.col("top") == "purchase").alias("majority_right"),
    )


@query("d18_strip_verdict", "documents", sql=f"""WITH {TRACES}, m AS (SELECT lang, avg({_PER(_COUNT('output', _MARK), 'output').replace('round(', '(').replace(', 6)', ')')}) AS marked, avg({_PER(_COUNT('output', _HELD), 'output').replace('round(', '(').replace(', 6)', ')')}) AS held, 100.0 * count(*) FILTER (idx % 3 = 0) / count(*) AS pooled FROM traces GROUP BY lang)
  SELECT lang, round(marked, 5) AS marked, round(held, 5) AS held, CASE WHEN abs(pooled - 33) <= 2 THEN 'kept' WHEN abs(pooled - 20) <= 2 THEN 'gone' ELSE 'between' END AS verdict FROM m""")
def strip_verdict(d):
    o = F.col("output")
    m = traces(d).groupBy("lang").agg(F.avg(markers.marker_density(o)).alias("m"), F.avg(markers.held_out_density(o)).alias("h"), (100 * F.count_if(F.col("idx") % 3 == 0) / F.count(F.lit(1))).alias("p"))
    return m.select("lang", F.round("m", 5).alias("marked"), F.round("h", 5).alias("held"), stats.band_verdict(F.col("p"), {"kept": 33.0, "gone": 20.0}).alias("verdict"))


@query("d21_prompt_arms", "documents", sql=f"""WITH {TRACES}, s AS (SELECT idx % 3 AS arm, idx % 400 AS problem, idx % 5 = 0 AS ok, length(output) AS tokens, finish = 'length' AS capped FROM traces)
  SELECT arm, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 6) AS correct, count(DISTINCT problem) FILTER (ok) AS solved, round(avg(tokens), 4) AS mean_tokens, round(avg(CASE WHEN capped THEN 1.0 ELSE 0 END), 6) AS capped FROM s GROUP BY arm""")
def arms(d):
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    i = F.col("idx")
    s = traces(d).select((i % 3).alias("arm"), (i % 400).alias("problem"), (i % 5 == 0).alias("ok"), F.length("output").alias("tokens"), (F.col("finish") == "length").alias("capped"))
    return s.groupBy("arm").agg(share(F.col("ok")).alias("correct"), F.count_distinct(F.when(F.col("ok"), F.col("problem"))).alias("solved"), F.round(F.avg("tokens"), 4).alias("mean_tokens"), share(F.col("capped")).alias("capped"))


@query("d22_dataset_table", "documents", sql=f"""WITH {TRACES}, u AS (SELECT 'source' AS name, output AS t, instruction FROM traces UNION ALL SELECT 'rewrite', rewrite, instruction FROM traces),
  n AS (SELECT name, t, {_COUNT('t', '[^ ' + chr(9) + '-' + chr(13) + ']+')} AS o, {_COUNT('instruction', '[^ ' + chr(9) + '-' + chr(13) + ']+')} AS p FROM u), k AS (SELECT *, CASE WHEN p + o + 1 <= 600 THEN o + 1 ELSE greatest(0, 600 - p) END AS kept, p + o + 1 > 600 AS cut FROM n)
  SELECT name, count(*) AS n, round(avg(o), 4) AS tokens, round(avg({_PER(_COUNT('t', _MARK), 't').replace('round(', '(').replace(', 6)', ')')}), 5) AS markers, round(avg(CASE WHEN cut THEN 1.0 ELSE 0 END), 6) AS truncated, round(1.0 * coalesce(sum(kept) FILTER (cut), 0) / greatest(sum(kept), 1), 6) AS no_stop FROM k GROUP BY name""")
def dataset_table(d):
    """Two data sets side by side: lengths, markers, and what a cutoff of 600 tokens, the prompt's included, leaves."""
    t = traces(d)
    u = t.select(F.lit("source").alias("name"), F.col("output").alias("t"), "instruction").unionByName(t.select(F.lit("rewrite").alias("name"), F.col("rewrite").alias("t"), "instruction"))
    o, p = F.col("o"), F.col("p")
    n = u.select("name", "t", text.token_count(F.col("t")).alias("o"), text.token_count(F.col("instruction")).alias("p"))
    k = n.withColumn("cut", p + o + 1 > 600).withColumn("kept", F.when(p + o + 1 <= 600, o + 1).otherwise(F.greatest(F.lit(0), 600 - p)))
    return k.groupBy("name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o"), 4).alias("tokens"), F.round(F.avg(markers.marker_density(F.col("t"))), 5).alias("markers"),
        F.round(F.avg(F.col("cut").cast("double")), 6).alias("truncated"),
        F.round(F.coalesce(F.sum(F.when(F.col("cut"), F.col("kept"))), F.lit(0)) / F.greatest(F.sum("kept"), F.lit(1)), 6).alias("no_stop"),
    )
