"""Queries of aggregations and of ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import ordered, packing, rises
from tracemill.operators.common import ranked

from .fixtures import PUZZLES, TRACES, puzzles, quoted, traces
from .queries import TRIES, correct, share
from .registry import query


@query("ag8_by_size", "events", sql="""SELECT user_id % 5 AS n_people, count(*) AS tries, count(*) FILTER (event_type = 'purchase') AS solved, count(*) FILTER (value >= 50) AS finished, round(avg(value), 6) AS mean_tokens,
  round(avg(value) FILTER (event_type = 'purchase' AND user_id % 5 > 0), 6) AS mean_tokens_correct, count(DISTINCT user_id) AS puzzles, count(DISTINCT user_id) FILTER (event_type = 'purchase') AS solved_once FROM events GROUP BY 1""")
def by_size(e):
    """Two levels: by puzzle first, so that distinct counts need no second shuffle of all rows."""
    size = F.col("user_id") % 5
    won = correct() & (size > 0)
    per = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(correct()).alias("ok"), F.count_if(F.col("value") >= 50).alias("fin"), F.sum("value").alias("s"),
        F.count("value").alias("v"), F.sum(F.when(won, F.col("value"))).alias("sc"), F.count(F.when(won, F.col("value"))).alias("vc"),
    )
    return per.groupBy(size.alias("n_people")).agg(
        F.sum("n").alias("tries"), F.sum("ok").alias("solved"), F.sum("fin").alias("finished"), F.round(F.try_divide(F.sum("s"), F.sum("v")), 6).alias("mean_tokens"),
        F.round(F.try_divide(F.sum("sc"), F.sum("vc")), 6).alias("mean_tokens_correct"), F.count(F.lit(1)).alias("puzzles"), F.count_if(F.col("ok") > 0).alias("solved_once"),
    )


@query("ag9_d19_puzzle_rollup", "events", sql=f"WITH {PUZZLES} SELECT id % 3 AS n_people, count(*) AS n, count(labels) AS readable, count(*) FILTER (labels = solution) AS right FROM puzzles GROUP BY ROLLUP (id % 3)")
def puzzle_rollup(e):
    from tracemill.functions.puzzles import parse_labels

    p = puzzles(e).select((F.col("id") % 3).alias("n_people"), parse_labels(F.col("text"), F.col("names")).alias("labels"), "solution")
    return p.rollup("n_people").agg(F.count(F.lit(1)).alias("n"), F.count("labels").alias("readable"), F.count_if(F.col("labels") == F.col("solution")).alias("right"))


_QUANTILES = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) "


@query("ag13_ag14_quantiles", "events", sql=_QUANTILES + "SELECT event_type, max(value) FILTER (i = n // 2) AS upper_median, max(value) FILTER (i = least(n - 1, floor(0.25 * n))) AS p25, max(value) FILTER (i = least(n - 1, floor(0.95 * n))) AS p95 FROM r GROUP BY event_type")
def quantiles(e):
    from tracemill.operators import evals

    places = {"upper_median": evals.upper_median(), "p25": evals.floor_quantile(0.25), "p95": evals.floor_quantile(0.95)}
    return ordered.quantile_rows(e, "event_type", "value", places)


@query("ag15_percentile", "events", sql="SELECT event_type, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def percentile(e):
    out = ordered.percentiles(e, "event_type", "value", {"p25": 0.25, "p50": 0.5, "p99": 0.99})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p99")])


@query("ag22_s1_token_stats", "lineitem", sql="SELECT l_partkey AS token_id, count(*) AS n, round(avg(l_discount), 6) AS logprob, round(avg(l_tax), 6) AS entropy FROM lineitem GROUP BY 1 ORDER BY n DESC, token_id")
def token_stats(line):
    out = line.groupBy(F.col("l_partkey").alias("token_id")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_discount"), 6).alias("logprob"), F.round(F.avg("l_tax"), 6).alias("entropy"))
    return out.orderBy(F.desc("n"), "token_id")


@query("ag23_occurrences", "lineitem", sql="SELECT l_partkey AS token_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS occurrence FROM lineitem WHERE l_partkey IN (1, 2, 3, 500)")
def occurrences(line):
    tracked = line.filter(F.col("l_partkey").isin(1, 2, 3, 500)).select(F.col("l_partkey").alias("token_id"), "l_orderkey", "l_linenumber")
    place = Window.partitionBy("token_id").orderBy("l_orderkey", "l_linenumber")
    return tracked.withColumn("occurrence", F.row_number().over(place) - 1)


@query("ag24_sequence_logprob", "orders", "lineitem", sql="SELECT o_orderkey, round(coalesce(sum(l_discount), 0), 6) AS logprob, round(coalesce(sum(l_discount), 0) / greatest(count(l_orderkey), 1), 6) AS mean FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey")
def logprob(o, line):
    own = line.filter("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.sum("l_discount").alias("s"), F.count(F.lit(1)).alias("n"))
    s, n = F.coalesce("s", F.lit(0.0)), F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    return o.join(own, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.round(s, 6).alias("logprob"), F.round(s / n, 6).alias("mean"))


@query("ag28_failing_ids", "events", sql="SELECT event_type, array_to_string((list(event_id ORDER BY event_id) FILTER (value > 90))[1:8], ',') AS ids FROM events GROUP BY event_type")
def failing(e):
    """The first eight ids of each group: each task keeps eight at the most before the groups meet."""
    from tracemill.operators.joins import top_window

    bad = top_window(e.filter("value > 90").select("event_type", "event_id"), ["event_type"], [F.col("event_id")], 8)
    ids = bad.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list("event_id")).cast("array<string>"), ",").alias("ids"))
    return e.select("event_type").distinct().withColumnRenamed("event_type", "__t").join(ids, F.col("__t").eqNullSafe(F.col("event_type")), "left").select(F.col("__t").alias("event_type"), "ids")


@query("ag31_d6_sk12_agreement", "documents", sql="""WITH v AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'wrong_answer' ELSE 'good' END AS verdict, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS agrees, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS recorded FROM documents)
  SELECT verdict, count(*) FILTER (agrees) AS agree, count(*) FILTER (agrees = false) AS differ, count(*) FILTER (agrees IS NULL) AS unjudged, count(*) FILTER (agrees IS DISTINCT FROM recorded) AS changed FROM v GROUP BY verdict""")
def agreement(d):
    """Verdicts against agreement, and how many recorded values a new pass would change (the dry run of an update)."""
    tri = lambda m: F.when(F.col("doc_id") % m == 0, F.lit(None).cast("boolean")).otherwise(F.col("doc_id") % m != 1)
    v = d.select(F.when(F.col("doc_id") % 5 == 0, "wrong_answer").otherwise("good").alias("verdict"), tri(4).alias("agrees"), tri(6).alias("recorded"))
    a = F.col("agrees")
    return v.groupBy("verdict").agg(
        F.count_if(a).alias("agree"), F.count_if(a.eqNullSafe(F.lit(False))).alias("differ"), F.count_if(a.isNull()).alias("unjudged"),
        F.count_if(~a.eqNullSafe(F.col("recorded"))).alias("changed"),
    )


@query("ag32_own_conclusion", "events", sql="""WITH c AS (SELECT CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_id % 3 END AS own, event_id % 2 AS teacher, event_id % 5 AS truth FROM events)
  SELECT count(own) AS wrote, count(*) FILTER (own = teacher) AS agrees, count(*) FILTER (own IS NOT NULL AND teacher <> truth) AS teacher_wrong, count(*) FILTER (own = teacher AND teacher <> truth) AS agrees_teacher_wrong, count(*) FILTER (own = truth AND teacher <> truth) AS true_teacher_wrong FROM c""")
def own_conclusion(e):
    i = F.col("event_id")
    c = e.select(F.when(i % 4 != 0, i % 3).alias("own"), (i % 2).alias("teacher"), (i % 5).alias("truth"))
    own, wrong = F.col("own"), F.col("teacher") != F.col("truth")
    return c.agg(
        F.count("own").alias("wrote"), F.count_if(own == F.col("teacher")).alias("agrees"), F.count_if(own.isNotNull() & wrong).alias("teacher_wrong"),
        F.count_if((own == F.col("teacher")) & wrong).alias("agrees_teacher_wrong"), F.count_if((own == F.col("truth")) & wrong).alias("true_teacher_wrong"),
    )


@query("ag33_ag34_rewrite_rates", "documents", sql=f"WITH {TRACES} SELECT lang, round(avg(1.0 * length(rewrite) / greatest(length(output), 1)), 6) AS ratio, round(avg(CASE WHEN finish = 'length' THEN 1.0 ELSE 0 END), 6) AS capped, round(avg(CASE WHEN finish = 'stop' THEN 1.0 ELSE 0 END), 6) AS finished, round(avg(CASE WHEN idx % 3 > 0 THEN 1.0 ELSE 0 END), 6) AS retried FROM traces GROUP BY lang")
def rewrite_rates(d):
    t = traces(d)
    return t.groupBy("lang").agg(
        F.round(F.avg(F.length("rewrite") / F.greatest(F.length("output"), F.lit(1))), 6).alias("ratio"), F.round(share(F.col("finish") == "length"), 6).alias("capped"),
        F.round(share(F.col("finish") == "stop"), 6).alias("finished"), F.round(share(F.col("idx") % 3 > 0), 6).alias("retried"),
    )


@query("ag37_per_file", "events", sql=TRIES + "SELECT user_id % 7 AS file, count(*) AS problems, round(100.0 * count(*) FILTER (ok > 0) / count(*), 6) AS passed, round(100.0 * avg(m), 6) AS avg_at_n FROM (SELECT user_id, count(*) FILTER (correct) AS ok, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS m FROM t GROUP BY user_id) GROUP BY 1")
def per_file(e):
    per = e.groupBy("user_id").agg(F.count_if(correct()).alias("ok"), share(correct()).alias("m"))
    return per.groupBy((F.col("user_id") % 7).alias("file")).agg(F.count(F.lit(1)).alias("problems"), F.round(100 * share(F.col("ok") > 0), 6).alias("passed"), F.round(100 * F.avg("m"), 6).alias("avg_at_n"))


@query("ag38_identity", "documents", sql=f"""WITH {TRACES}, p AS (SELECT CASE WHEN idx % 8 IN (0, 7) THEN length(output) WHEN idx % 8 IN (3, 6) THEN length(output) WHEN idx % 8 = 1 THEN 0 WHEN idx % 8 = 2 THEN length(output) // 4 END AS prefix, output, rewrite, idx FROM traces)
  SELECT count(*) AS n, count(*) FILTER (output = rewrite) AS identical, count(*) FILTER (idx % 3 = idx % 5) AS agree, count(*) FILTER (idx % 3 = 0 AND idx % 5 <> 0) AS gained, round(avg(1.0 * prefix / greatest(length(output), 1)) FILTER (prefix IS NOT NULL), 6) AS shared, count(*) FILTER (prefix < 0.01 * length(output)) AS early FROM p""")
def identity(d):
    """Verdicts, identical texts and shared beginnings; kinds 4 and 5 of rewrites change characters and are left out of the last two."""
    t = traces(d)
    p = F.when(~(F.col("idx") % 8).isin(4, 5), text.common_prefix(F.col("output"), F.col("rewrite")))
    t = t.withColumn("p", p).withColumn("n", F.length("output"))
    return t.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("output") == F.col("rewrite")).alias("identical"), F.count_if(F.col("idx") % 3 == F.col("idx") % 5).alias("agree"),
        F.count_if((F.col("idx") % 3 == 0) & (F.col("idx") % 5 != 0)).alias("gained"), F.round(F.avg(F.col("p") / F.greatest("n", F.lit(1))), 6).alias("shared"),
        F.count_if(F.col("p") < 0.01 * F.col("n")).alias("early"),
    )


@query("ag39_sc8_shard_union", "orders", sql="SELECT o_orderkey AS index, CASE WHEN o_orderkey % 3 = 0 THEN 'good' ELSE 'exhausted' END AS verdict, o_orderkey % 4 AS shard FROM orders ORDER BY index")
def shard_union(o):
    """Records of four shards and the descriptions beside them, joined by place and put in the order of the latter."""
    records = o.select((F.col("o_orderkey") % 4).alias("shard"), F.floor(F.col("o_orderkey") / 4).alias("place"))
    meta = o.select((F.col("o_orderkey") % 4).alias("shard"), F.floor(F.col("o_orderkey") / 4).alias("place"), F.col("o_orderkey").alias("index"), F.when(F.col("o_orderkey") % 3 == 0, "good").otherwise("exhausted").alias("verdict"))
    return records.join(meta, ["shard", "place"]).select("index", "verdict", "shard").orderBy("index")


@query("ag40_partial_pool", "events", sql="SELECT user_id, count(*) AS n, round(100.0 * count(*) FILTER (value > 50) / greatest(count(*), 1), 6) AS pooled FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def partial(e):
    some = e.filter(F.col("event_type").isin("click", "error")).groupBy("user_id")
    n = F.count(F.lit(1))
    return some.agg(n.alias("n"), F.round(100 * F.count_if(F.col("value") > 50) / F.greatest(n, F.lit(1)), 6).alias("pooled"))


@query("ag41_variant_choice", "events", sql="WITH m AS (SELECT user_id, event_type AS variant, round(avg(value)) AS m FROM events GROUP BY ALL) SELECT user_id, coalesce(arg_max(variant, struct_pack(m := m, v := variant)) FILTER (m >= 50), 'none') AS choice FROM m GROUP BY user_id")
def variant(e):
    """The variant of the best mean of at least 50, of equals the last; none if there is no such."""
    m = e.groupBy("user_id", F.col("event_type").alias("variant")).agg(F.round(F.avg("value")).alias("m"))
    best = F.max_by(F.when(F.col("m") >= 50, F.col("variant")), F.when(F.col("m") >= 50, F.struct("m", "variant")))
    return m.groupBy("user_id").agg(F.coalesce(best, F.lit("none")).alias("choice"))


_VERDICT = "CASE l_linenumber WHEN 1 THEN 'good' WHEN 2 THEN 'exhausted' WHEN 3 THEN 'unvalidated' WHEN 4 THEN 'odd' ELSE 'prompt_too_long' END"


@query("w1_d4_merge", "lineitem", sql=f"""WITH r AS (SELECT l_partkey % 500 AS idx, {_VERDICT} AS verdict, CAST(l_tax * 100 AS INT) % 3 AS retries, CAST(l_quantity AS INT) AS chars, l_orderkey * 10 + l_linenumber AS shard FROM lineitem),
  k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY CASE verdict WHEN 'good' THEN 0 WHEN 'exhausted' THEN 1 WHEN 'prompt_too_long' THEN 2 WHEN 'unvalidated' THEN 3 ELSE 9 END, retries, chars DESC, shard) AS n FROM r)
  SELECT idx, verdict, retries, chars, shard FROM k WHERE n = 1""")
def merge(line):
    """Rows of all shards, of each index the best; the query fails if an index is missing."""
    from tracemill.operators.common import asserted

    n = F.col("l_linenumber")
    verdict = F.when(n == 1, "good").when(n == 2, "exhausted").when(n == 3, "unvalidated").when(n == 4, "odd").otherwise("prompt_too_long")
    rows = line.select((F.col("l_partkey") % 500).alias("idx"), verdict.alias("verdict"), ((F.col("l_tax") * 100).cast("decimal(9,0)").cast("int") % 3).alias("retries"), F.col("l_quantity").cast("int").alias("chars"), (F.col("l_orderkey") * 10 + n).alias("shard"))
    best = ordered.priority_dedupe(rows, "idx", "verdict", "retries", "chars", "shard")
    every = line.sparkSession.range(500).select(F.col("id").alias("__i"))
    both = every.join(best, F.col("__i") == F.col("idx"), "left")
    return asserted(both, F.col("idx").isNotNull(), "an index is missing").drop("__i")


@query("w3_distinct_in_order", "events", sql="SELECT user_id, array_to_string(list(event_type ORDER BY f), ',') AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_in_order(e):
    lists = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("f")).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("f", "event_type"))).alias("l"))
    return lists.select("user_id", F.array_join(F.array_distinct(F.transform("l", lambda x: x["event_type"])), ",").alias("types"))


@query("w5_strongest", "events", sql="WITH s AS (SELECT user_id % 10 AS setting, count(*) FILTER (event_type = 'purchase') AS ok FROM events GROUP BY 1) SELECT coalesce(max(setting) FILTER (ok >= (SELECT ok - 5 FROM s WHERE setting = 0)), min(setting)) AS setting, count(*) FILTER (ok >= (SELECT ok - 5 FROM s WHERE setting = 0)) AS admissible FROM s")
def strongest(e):
    s = e.groupBy((F.col("user_id") % 10).alias("setting")).agg(F.count_if(correct()).alias("ok"))
    base = s.filter("setting = 0").select(F.col("ok").alias("base"))
    return ordered.strongest_admissible(s.crossJoin(F.broadcast(base)), "setting", "ok", F.col("base"))  # base is one row


@query("w6_pilot_even_half", "orders", sql="""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE i IN (SELECT CAST(floor((q + 0.5) * (SELECT count(*) FROM orders) / 10) AS BIGINT) FROM range(10) t(q))""")
def pilot_even(o):
    return ordered.pilot(o.select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice", 20).filter("part = 'even'").select("o_orderkey")


@query("w7_w8_nested_levels", "customer", sql="SELECT 12 AS level, CAST(round_even(0.12 * count(*), 0) AS BIGINT) AS n, CAST(round_even(0.12 * count(*), 0) AS BIGINT) AS within_next FROM customer UNION ALL SELECT 30, CAST(round_even(0.30 * count(*), 0) AS BIGINT), CAST(round_even(0.30 * count(*), 0) AS BIGINT) FROM customer UNION ALL SELECT 50, CAST(round_even(0.5 * count(*), 0) AS BIGINT), CAST(round_even(0.5 * count(*), 0) AS BIGINT) FROM customer")
def nested(c):
    """How many rows each level of one random order holds, and how many of them the next level holds as well."""
    r = ordered.nested_levels(c.select("c_custkey"), "c_custkey", [12, 30, 50], 7)
    nxt = {12: F.col("in_30"), 30: F.col("in_50"), 50: F.lit(True)}
    sums = r.agg(*[F.struct(F.lit(p).alias("level"), F.count_if(F.col(f"in_{p}")).alias("n"), F.count_if(F.col(f"in_{p}") & nxt[p]).alias("within_next")).alias(f"l{p}") for p in (12, 30, 50)])
    return sums.select(F.explode(F.array("l12", "l30", "l50")).alias("x")).select("x.*")


@query("w9_sk10_distribution", "lineitem", sql="SELECT DISTINCT l_quantity, round(cume_dist() OVER (ORDER BY l_quantity), 9) AS share FROM lineitem")
def cdf(line):
    return ordered.distribution(line, "l_quantity").select("l_quantity", F.round("share", 9).alias("share"))


@query("w11_t52_d1_segments", "documents", sql=rf"""WITH RECURSIVE {TRACES}, g AS (SELECT idx, regexp_split_to_array(regexp_replace(output, '(\n[ \t]*\n\s*)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS p FROM traces),
  t AS (SELECT idx, list_transform(range(len(p) // 2 + 1), lambda k: p[2 * k + 1] || coalesce(p[2 * k + 2], '')) AS pg, list_transform(range(len(p) // 2 + 1), lambda k: coalesce(p[2 * k + 2], '')) AS gaps FROM g),
  n AS (SELECT idx, pg, gaps, list_transform(pg, lambda b: len(regexp_extract_all(b, '[^ \t-\r]+'))) AS n FROM t),
  r AS (SELECT idx, 1 AS i, 1 AS seg, n[1] AS used FROM n UNION ALL SELECT r.idx, i + 1, CASE WHEN used + n[i + 1] > 60 THEN seg + 1 ELSE seg END, CASE WHEN used + n[i + 1] > 60 THEN n[i + 1] ELSE used + n[i + 1] END FROM r JOIN n ON n.idx = r.idx WHERE i < len(n)),
  e AS (SELECT idx, max(seg) AS last, max_by(used, i) AS used FROM r GROUP BY idx),
  s AS (SELECT r.idx, CASE WHEN seg = last AND last > 1 AND e.used < 15 THEN seg - 1 ELSE seg END AS seg, string_agg(pg[i], '' ORDER BY i) AS pg, max_by(gaps[i], i) AS gap, sum(n[i]) AS n FROM r JOIN n ON n.idx = r.idx JOIN e ON e.idx = r.idx GROUP BY 1, 2),
  k AS (SELECT *, left(pg, length(pg) - length(gap)) AS text FROM s)
  SELECT idx, count(*) AS segments, max(n) AS longest, count(DISTINCT idx || ':' || (seg - 1) || ':' || left(sha1(text), 12)) AS keys, md5(string_agg(text || gap, '' ORDER BY seg)) AS digest,
  md5(string_agg(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || gap, '' ORDER BY seg)) AS stripped FROM k GROUP BY idx""")
def segmented(d):
    """Segments of at most 60 words of each output, with their keys; put together again they are the text."""
    rows = packing.packed(traces(d).select("idx", "output"), "output", 60).withColumnRenamed("position", "j")
    keyed = rows.withColumn("key", text.segment_key(F.col("idx"), F.col("j"), F.col("text")))
    whole = keyed.groupBy("idx").agg(
        F.count(F.lit(1)).alias("segments"), F.max("tokens").alias("longest"), F.count_distinct("key").alias("keys"),
        F.array_sort(F.collect_list(F.struct(F.col("j").alias("position"), "text", "gap"))).alias("parts"),
    )
    joined = F.array_join(F.transform("parts", lambda p: F.concat(p["text"], p["gap"])), "")
    md5 = lambda c: F.md5(c.cast("binary"))
    return whole.select("idx", "segments", "longest", "keys", md5(joined).alias("digest"), md5(text.reassembled(F.col("parts"))).alias("stripped"))


@query("w12_lis", "events", sql="""WITH l AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id),
  d AS (SELECT user_id, v, list_reduce(list_prepend(CAST([] AS BIGINT[]), list_transform(range(1, len(v) + 1), lambda k: [k])), lambda d, k: list_append(d, 1 + coalesce(list_max(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN v[i] < v[k[1]] THEN d[i] END)), 0))) AS d FROM l)
  SELECT user_id, len(v) - list_max(d) AS moved FROM d""")
def rise(e):
    """For each user how many events are out of order by value, in order of id: all less the longest rise."""
    out = rises.longest_rises(e, "user_id", ["event_id"], "value")
    return out.select("user_id", (F.col("n") - F.col("longest")).alias("moved"))


@query("w15_w16_s2_s4_orders", "part", sql="""WITH p AS (SELECT p_partkey, 'p_' || (p_partkey % 50) AS id, CASE WHEN p_partkey % 7 > 0 THEN p_size END AS len FROM part)
  SELECT * FROM (SELECT 'longest' AS how, p_partkey, row_number() OVER (ORDER BY coalesce(len, 99) DESC, p_partkey) AS place FROM p UNION ALL SELECT 'suffix', p_partkey, row_number() OVER (ORDER BY CAST(split_part(id, '_', 2) AS INT), p_partkey) FROM p) WHERE place <= 25""")
def orders(p):
    rows = p.select("p_partkey", F.concat(F.lit("p_"), (F.col("p_partkey") % 50).cast("string")).alias("id"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_size")).alias("len"))

    def first(how, *order):
        top = rows.orderBy(*order, "p_partkey").limit(25)
        return top.select(F.lit(how).alias("how"), "p_partkey", F.row_number().over(Window.orderBy(*order, "p_partkey")).alias("place"))  # 25 rows

    return first("longest", F.coalesce("len", F.lit(99)).desc()).union(first("suffix", ordered.numeric_suffix(F.col("id"))))


@query("s2_mixed_keys", "nation", sql="WITH k AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END AS key FROM nation) SELECT key, row_number() OVER (ORDER BY try_cast(key AS DOUBLE) IS NULL, try_cast(key AS DOUBLE), key) - 1 AS rank FROM k")
def mixed_keys(n):
    k = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).otherwise(F.col("n_nationkey").cast("string")).alias("key"))
    return ranked(k, ordered.mixed_order(F.col("key")))


@query("s3_top_counts", "lineitem", sql="SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 10")
def top_counts(line):
    return line.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(10)


@query("w17_representatives", "documents", sql=f"""WITH {TRACES}, c AS (SELECT idx, length(output) AS len, idx % 2 = 0 AS a, idx % 3 = 0 AS b, idx % 2 = 0 AND idx % 3 = 0 AS c FROM traces),
  x AS (SELECT 'even' AS case, idx FROM c WHERE a ORDER BY len, idx LIMIT 1), y AS (SELECT 'third' AS case, idx FROM c WHERE b AND idx NOT IN (SELECT idx FROM x) ORDER BY len, idx LIMIT 1),
  z AS (SELECT 'both' AS case, idx FROM c WHERE c AND idx NOT IN (SELECT idx FROM x UNION SELECT idx FROM y) ORDER BY len, idx LIMIT 1) SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z""")
def representatives(d):
    i = F.col("idx")
    rows = traces(d).select("idx", F.length("output").alias("len"))
    return ordered.representatives(rows, "idx", "len", {"even": i % 2 == 0, "third": i % 3 == 0, "both": (i % 2 == 0) & (i % 3 == 0)})


@query("so6_w18_distinct_first", "orders", sql="SELECT o_custkey, min(o_orderkey) AS first_order, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey")
def distinct_first(o):
    per = o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("f"))
    return per.groupBy("o_custkey").agg(F.min("f").alias("first_order"), F.count("o_orderpriority").alias("kinds"))


_TABLE = [("a", 1), ("hmm", 7), ("wait", 2)]
_VALUES = ", ".join(f"({quoted(s)}, {i})" for s, i in _TABLE)


@query("t55_token_resolution", "conversations", sql=f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM conversations), v AS (SELECT * FROM (VALUES {_VALUES}) t(token, id))
  SELECT count(*) AS tokens, count(id) AS single, count(*) - count(id) AS warned FROM w LEFT JOIN v USING (token)""")
def resolution(c):
    """Strings that a vocabulary knows as one token, and how many there is a warning for."""
    w = c.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).distinct()
    v = c.sparkSession.createDataFrame(_TABLE, "token string, id int")
    both = w.join(F.broadcast(v), "token", "left")  # the vocabulary's special tokens: some dozens
    return both.agg(F.count(F.lit(1)).alias("tokens"), F.count("id").alias("single"), (F.count(F.lit(1)) - F.count("id")).alias("warned"))
