"""The engine's queries over the standard tables, each with SQL of the same result.

Users of `events` are problems, their events by event_id the tries, event_type is a try's answer, purchase the right one.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import markers, stats, text
from tracemill.operators import evals
from tracemill.streaming import events as streaming

from .registry import query

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+'))"


TRIES = """WITH t AS (SELECT *, event_type = 'purchase' AS correct,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events) """


def correct():
    return F.col("event_type") == "purchase"


def share(condition):
    return F.avg(condition.cast("double"))


@query("ag1_accuracy", "events", sql="SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS ok, round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 6) AS accuracy FROM events GROUP BY user_id")
def accuracy(e):
    ok = F.count_if(correct())
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), ok.alias("ok"), F.round(100 * ok / F.count(F.lit(1)), 6).alias("accuracy"))


@query("ag3_pass_at_4", "events", sql=TRIES + "SELECT user_id, bool_or(correct) AS passed, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS avg_at_k FROM t WHERE pos < 4 GROUP BY user_id")
def pass_at_4(e):
    t = evals.first_tries(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", 4)
    return t.groupBy("user_id").agg(F.bool_or(correct()).alias("passed"), F.round(share(correct()), 6).alias("avg_at_k"))


@query("ag5_pooled_accuracy", "events", sql="SELECT count(*) AS n, round(100.0 * count(*) FILTER (event_type = 'purchase') / count(*), 6) AS pooled, round(100.0 * (SELECT avg(a) FROM (SELECT avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS a FROM events GROUP BY user_id)), 6) AS macro FROM events")
def pooled(e):
    per = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(correct()).alias("ok"))
    return per.agg(F.sum("n").alias("n"), F.round(100 * F.sum("ok") / F.sum("n"), 6).alias("pooled"), F.round(100 * F.avg(F.col("ok") / F.col("n")), 6).alias("macro"))


@query("ag6_having", "events", sql="SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY user_id HAVING count(*) >= 50")
def having(e):
    return e.filter(F.col("event_type") != "error").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 50")


@query("ag7_ratios", "orders", "lineitem", sql="WITH p AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(1.0 * sum(r) / sum(n), 6) AS ratio_of_sums, round(avg(1.0 * r / n), 6) AS mean_of_ratios FROM p")
def ratios(_, line):
    p = line.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count(F.lit(1)).alias("n"))
    return p.agg(F.round(F.sum("r") / F.sum("n"), 6).alias("ratio_of_sums"), F.round(F.avg(F.col("r") / F.col("n")), 6).alias("mean_of_ratios"))


@query("ag9_rollup", "events", sql="SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ROLLUP (event_type)")
def rollup(e):
    return e.rollup("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("ag10_frequency", "events", sql="SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def frequency(e):
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type")


@query("ag12_majority", "events", sql="SELECT user_id, event_type, votes FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) AS r FROM (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS f FROM events WHERE event_type IS NOT NULL GROUP BY ALL)) WHERE r = 1")
def majority(e):
    return evals.majority(e, "user_id", "event_type", "event_id")


@query("ag16_histogram", "events", sql="WITH h AS (SELECT CASE WHEN value BETWEEN 0 AND 200 THEN CAST(least(floor(value / 10.0), 19) AS INT) END AS b, count(*) AS c FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT CAST(i AS INT) AS bin, coalesce(c, 0) AS count, round(coalesce(c / ((SELECT sum(c) FROM h) * 10.0), 0), 9) AS density FROM range(20) r(i) LEFT JOIN h ON b = i")
def histogram(e):
    return evals.histogram(e, "value", 0.0, 200.0, 20).withColumn("density", F.round("density", 9))


_BINNED = "CASE WHEN p = 0 THEN '0' WHEN p <= 0.25 THEN 'low' WHEN p < 0.75 THEN 'mid' WHEN p < 1 THEN 'high' ELSE '1' END"


@query("ag17_ag25_predictability", "events", sql=TRIES + f", p AS (SELECT user_id, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS p FROM t WHERE pos < 4 GROUP BY user_id) SELECT {_BINNED} AS bin, count(*) AS problems, count(*) FILTER (p = 0) AS unreachable, round(avg(CASE WHEN p > 0 THEN -log2(p) END), 6) AS mean_bits FROM p GROUP BY 1")
def predictability(e):
    t = evals.first_tries(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", 4)
    p = t.groupBy("user_id").agg(share(correct()).alias("p"))
    return p.groupBy(F.expr(_BINNED).alias("bin")).agg(
        F.count(F.lit(1)).alias("problems"), F.count_if(F.col("p") == 0).alias("unreachable"),
        F.round(F.avg(F.when(F.col("p") > 0, -F.log2("p"))), 6).alias("mean_bits"),
    )


@query("ag18_dense_histogram", "events", sql=TRIES + ", c AS (SELECT user_id, count(*) FILTER (correct) AS k FROM t WHERE pos < 4 GROUP BY 1), g AS (SELECT k, count(*) AS n FROM c GROUP BY k) SELECT i AS solved, coalesce(n, 0) AS problems FROM range(5) r(i) LEFT JOIN g ON k = i")
def dense(e):
    t = evals.first_tries(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", 4)
    c = t.groupBy("user_id").agg(F.count_if(correct()).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    every = e.sparkSession.range(5).withColumnRenamed("id", "solved")
    return every.join(c, F.col("k") == F.col("solved"), "left").select("solved", F.coalesce("n", F.lit(0)).alias("problems"))


@query("ag19_ag21_moments", "events", sql="SELECT event_type, round(stddev_pop(value), 6) AS sd_pop, round(stddev_samp(value), 6) AS sd_samp, min(value) AS low, max(value) AS high, CAST(floor(avg(value)) AS BIGINT) AS mean_int FROM events GROUP BY event_type")
def moments(e):
    return e.groupBy("event_type").agg(
        F.round(F.stddev_pop("value"), 6).alias("sd_pop"), F.round(F.stddev_samp("value"), 6).alias("sd_samp"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.floor(F.avg("value")).cast("long").alias("mean_int"),
    )


@query("ag26_token_budget", "documents", sql=f"SELECT lang, sum(n) AS words, sum(CASE WHEN n > 200 THEN 200 ELSE n + 1 END) AS kept, count(*) FILTER (n > 200) AS cut FROM (SELECT lang, {WORDS} AS n FROM documents) GROUP BY lang")
def budget(d):
    n = d.select("lang", F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long").alias("n"))
    return n.groupBy("lang").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("n") > 200, 200).otherwise(F.col("n") + 1)).alias("kept"), F.count_if(F.col("n") > 200).alias("cut"))


@query("ag27_density", "documents", sql=f"WITH d AS (SELECT lang, len(regexp_extract_all(text, '(?i){markers.MARKER[4:]}')) AS m, {WORDS} AS n FROM documents WHERE text IS NOT NULL) SELECT lang, round(1000.0 * sum(m) / sum(n), 6) AS micro, round(avg(1000.0 * m / greatest(n, 1)), 6) AS macro FROM d GROUP BY lang")
def densities(d):
    d = d.filter(F.col("text").isNotNull())
    m, n = F.regexp_count("text", F.lit(markers.MARKER)), text.word_count(F.col("text"))
    d = d.select("lang", m.cast("long").alias("m"), n.cast("long").alias("n"))
    macro = 1000 * F.col("m") / F.greatest(F.col("n"), F.lit(1))
    return d.groupBy("lang").agg(F.round(1000 * F.sum("m") / F.sum("n"), 6).alias("micro"), F.round(F.avg(macro), 6).alias("macro"))


@query("ag29_distinct", "documents", sql="SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts FROM documents")
def distinct(d):
    return d.select("doc_id", F.sha2("text", 256).alias("t")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_distinct("t").alias("texts"))


@query("ag36_all_present", "events", sql="SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def all_present(e):
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("k")).filter("k = 5").drop("k")


@query("ag35_step_window", "events", sql="SELECT user_id, round(coalesce(avg(value) FILTER (pos BETWEEN 40 AND 59), 0), 6) AS reward FROM (" + TRIES + "SELECT * FROM t) GROUP BY user_id")
def step_window(e):
    t = evals.numbered(e.select("user_id", "event_id", "value"), "user_id", "event_id")
    return t.groupBy("user_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("pos").between(40, 59), F.col("value"))), F.lit(0.0)), 6).alias("reward"))


@query("pf8_strided_shard", "orders", sql="SELECT o_orderkey % 7 AS shard, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1")
def strided(o):
    return o.groupBy((F.col("o_orderkey") % 7).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))


@query("pf19_top_per_group", "orders", sql="SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_per_group(o):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.withColumn("r", rank).filter("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("j8_priority", "events", sql="SELECT user_id, event_id, origin FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS r FROM (SELECT user_id, min(event_id) AS event_id, 'own' AS origin, 0 AS p FROM events WHERE event_type = 'purchase' AND value > 100 GROUP BY 1 UNION ALL SELECT user_id, min(event_id), 'hint', 1 FROM events WHERE event_type = 'click' AND value > 50 GROUP BY 1 UNION ALL SELECT user_id, min(event_id), 'salvage', 2 FROM events GROUP BY 1)) WHERE r = 1")
def priority(e):
    first = lambda c: e.filter(c).groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return evals.staged(first("event_type = 'purchase' AND value > 100"), first("event_type = 'click' AND value > 50"), first("true"), "user_id", "event_id")


_NORMAL = r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))"


@query("j12_question_overlap", "documents", "benchmark", sql=f"WITH q AS (SELECT {_NORMAL} AS k FROM benchmark), s AS (SELECT k FROM q UNION SELECT left(k, 60) FROM q), d AS (SELECT doc_id, {_NORMAL} AS k FROM documents) SELECT doc_id FROM d WHERE k <> '' AND (k IN (SELECT k FROM s WHERE k <> '') OR left(k, 60) IN (SELECT k FROM s WHERE k <> ''))")
def question_overlap(d, b):
    """Documents whose normalized text, or its 60-character prefix, equals a held-out question or its prefix."""
    q = b.select(text.normalized(F.col("text")).alias("k"))
    keys = q.union(q.select(F.left("k", F.lit(60)))).filter("k <> ''").distinct().select(F.col("k").alias("__k"))
    own = d.select("doc_id", text.normalized(F.col("text")).alias("k")).filter("k <> ''")
    own = own.withColumn("__row", F.monotonically_increasing_id())
    own = own.select("doc_id", "__row", F.explode(F.array_distinct(F.array("k", F.left("k", F.lit(60))))).alias("k"))
    return own.join(keys, F.col("k") == F.col("__k"), "left_semi").dropDuplicates(["__row"]).select("doc_id")


_AS_ASKED = f"SELECT CASE WHEN item_id % 3 = 0 THEN upper(replace(text, ' ', '  ')) WHEN item_id % 3 = 1 THEN left({_NORMAL}, 60) || ' and more' ELSE 'so: ' || text END AS text, item_id FROM benchmark"


@query("j12_overlap_of_candidates", "benchmark", sql=f"WITH q AS (SELECT {_NORMAL} AS k FROM benchmark), s AS (SELECT k FROM q UNION SELECT left(k, 60) FROM q), d AS (SELECT item_id, {_NORMAL} AS k FROM ({_AS_ASKED})) SELECT item_id FROM d WHERE k <> '' AND (k IN (SELECT k FROM s WHERE k <> '') OR left(k, 60) IN (SELECT k FROM s WHERE k <> ''))")
def overlap_of_candidates(b):
    """Each held-out question in other case and spacing, with another end, or behind other words."""
    k = F.col("item_id") % 3
    other = F.when(k == 0, F.upper(F.replace("text", F.lit(" "), F.lit("  ")))).when(k == 1, F.concat(F.left(text.normalized(F.col("text")), F.lit(60)), F.lit(" and more")))
    asked = b.select(F.col("item_id").alias("doc_id"), other.otherwise(F.concat(F.lit("so: "), "text")).alias("text"))
    return question_overlap(asked, b).withColumnRenamed("doc_id", "item_id")


@query("j13_paired", "events", sql=TRIES + ", p AS (SELECT user_id, bool_or(correct) FILTER (pos < 4) AS a, bool_or(correct) FILTER (pos BETWEEN 4 AND 7) AS b FROM t GROUP BY user_id) SELECT count(*) FILTER (a AND NOT b) AS lost, count(*) FILTER (b AND NOT a) AS gained FROM p")
def paired(e):
    t = evals.first_tries(e.select("user_id", "event_id", "event_type"), "user_id", "event_id", 8)
    p = t.groupBy("user_id").agg(F.bool_or(F.when(F.col("pos") < 4, correct())).alias("a"), F.bool_or(F.when(F.col("pos") >= 4, correct())).alias("b"))
    return p.agg(F.count_if(F.expr("a AND NOT b")).alias("lost"), F.count_if(F.expr("b AND NOT a")).alias("gained"))


@query("w1_w2_first_row", "documents", sql="SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1")
def first_row(d):
    return evals.first_by(d.select("doc_id", "source", "n_chars", F.sha2("text", 256).alias("__t")), ["__t"], [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "source")


@query("w4_best_checkpoint", "events", sql="SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r = 1")
def best(e):
    top = F.max_by(F.struct("event_id", "value"), F.struct(F.col("value"), -F.col("event_id")))
    return e.groupBy("user_id").agg(top.alias("b")).select("user_id", "b.*")


@query("w14_t21_repetition", "documents", sql=r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t-\r]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(CASE WHEN len(w) < 16 THEN 1.0 ELSE len(list_distinct(list_transform(range(len(w) - 3), lambda i: array_to_string(w[i + 1:i + 4], ' ')))) / (len(w) - 3) END, 6) AS ratio FROM w")
def repetition(d):
    return d.filter(F.col("text").isNotNull()).select("doc_id", F.round(text.repetition_ratio(F.col("text")), 6).alias("ratio"))


@query("t35_last_number", "documents", sql=r"SELECT doc_id, list_extract(regexp_extract_all(replace(text, ',', ''), '-?[0-9]+(?:\.[0-9]+)?'), -1) AS number FROM documents")
def last_number(d):
    return d.select("doc_id", text.last_number(F.col("text")).alias("number"))


@query("t49_segment_key", "documents", sql="SELECT doc_id, concat_ws(':', doc_id, n_chars, left(sha1(text), 12)) AS key FROM documents WHERE text IS NOT NULL")
def keys(d):
    return d.filter(F.col("text").isNotNull()).select("doc_id", text.segment_key(F.col("doc_id"), F.col("n_chars"), F.col("text")).alias("key"))


@query("so1_so5_sets", "customer", "supplier", sql="SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'only', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)")
def sets(c, s):
    counted = lambda op, d: d.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    a, b = c.select("c_nationkey"), s.select("s_nationkey")
    out = counted("union", a.union(b)).union(counted("both", a.intersect(b)))
    return out.union(counted("only", c.select("c_custkey").subtract(s.select("s_suppkey"))))


@query("st2_wilson", "events", sql="WITH g AS (SELECT user_id, count(*) AS n, 1.0 * count(*) FILTER (event_type = 'purchase') / count(*) AS p FROM events GROUP BY 1) SELECT user_id, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 4) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 4) AS high FROM g")
def wilson(e):
    g = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(correct()).alias("ok"))
    w = g.select("user_id", stats.wilson(F.col("ok"), F.col("n")).alias("w"))
    return w.select("user_id", F.round("w.low", 4).alias("low"), F.round("w.high", 4).alias("high"))


@query("st12_correlation", "lineitem", sql="SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def correlation(line):
    return line.agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query("x_windowed_counts", "events", sql="SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed(e):
    return streaming.windowed_counts(e)
