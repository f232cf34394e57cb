"""Queries of projections, filters, slices and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import evals, joins, ordered

from .fixtures import TRACES, traces
from .registry import query

SYSTEM = "Please reason step by step, and put your final answer within \\boxed{}."


def aliased(df, registry: dict[str, str]):
    """The columns that a registry {new: old} names, renamed."""
    return df.select(*[F.col(old).alias(new) for new, old in registry.items()])


@query("pf1_pf2_projection", "documents", sql=f"WITH {TRACES} SELECT idx, instruction AS prompt, '' AS query, md5(output) AS response, '{SYSTEM}' AS system FROM traces")
def projection(d):
    t = traces(d).select("idx", "instruction", F.lit("").alias("input"), F.md5(F.col("output").cast("binary")).alias("output"), F.lit(SYSTEM).alias("system"))
    return aliased(t, {"idx": "idx", "prompt": "instruction", "query": "input", "response": "output", "system": "system"})


def chat_prompt(instruction, extra, system):
    """A system line if there is one, the instruction, and what is added to it unless blank."""
    user = F.when(F.trim(F.coalesce(extra, F.lit(""))) != "", F.concat(instruction, F.lit("\n"), extra)).otherwise(instruction)
    turn = lambda role, c: F.concat(F.lit(f"<|im_start|>{role}\n"), c, F.lit("<|im_end|>\n"))
    return F.concat(F.when(system.isNotNull(), turn("system", system)).otherwise(""), turn("user", user), F.lit("<|im_start|>assistant\n"))


@query("pf3_pf4_prompts", "conversations", sql="""SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN '<|im_start|>system' || chr(10) || 'be short<|im_end|>' || chr(10) ELSE '' END || '<|im_start|>user' || chr(10) || text || CASE WHEN turn % 3 = 1 THEN chr(10) || role ELSE '' END
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt FROM conversations WHERE text IS NOT NULL""")
def prompts(c):
    extra = F.when(F.col("turn") % 3 == 1, F.col("role")).when(F.col("turn") % 3 == 2, "  ")
    p = chat_prompt(F.col("text"), extra, F.when(F.col("turn") % 2 == 0, "be short"))
    return c.filter(F.col("text").isNotNull()).select("conv_id", "turn", F.md5(p.cast("binary")).alias("prompt"))


@query("pf5_pf12_pf17_filters", "events", sql="SELECT count(*) FILTER (value >= 80.0) AS difficult, count(props) AS readable, count(*) FILTER (event_type <> 'purchase' OR event_type IS NULL) AS not_good FROM events")
def filters(e):
    return e.agg(F.count_if(F.col("value") >= 80.0).alias("difficult"), F.count("props").alias("readable"), F.count_if(~F.coalesce(F.col("event_type") == "purchase", F.lit(False))).alias("not_good"))


@query("pf6_w10_d20_screening", "documents", "labels", sql="""WITH q AS (SELECT doc_id AS id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
  r AS (SELECT doc_id, CASE WHEN id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'poor' ELSE 'keep' END AS reason FROM documents LEFT JOIN q ON doc_id = id),
  k AS (SELECT *, count(*) FILTER (reason = 'keep') OVER (ORDER BY doc_id) AS kept FROM r)
  SELECT reason, count(*) AS n, max(doc_id) AS last FROM k WHERE kept < 100 OR (reason = 'keep' AND kept = 100) GROUP BY reason""")
def screening(d, labels):
    """Reasons in order, up to the document that is the hundredth to be kept."""
    q = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = d.select("doc_id").join(q, F.col("doc_id") == F.col("__id"), "left")
    tests = [("unlabelled", F.col("__id").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0)]
    rows = evals.screened(rows, tests).select("doc_id", "reason")
    seen = ordered.until_kept(rows, [F.col("doc_id")], F.col("reason") == "keep", 100)
    return seen.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))


@query("pf7_pf9_pf18_slices", "orders", sql="""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
  SELECT i // CAST(ceil(n / 7.0) AS BIGINT) AS shard, count(*) AS rows, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) FILTER (i < ceil(n / 2.0)) AS first_half, count(*) FILTER (i < 1000) AS prefix FROM r GROUP BY 1""")
def slices(o):
    n = o.count()
    r = ordered.ranked(o.select("o_orderkey"), [F.col("o_orderkey")])
    shard = F.floor(F.col("rank") / -(-n // 7)).alias("shard")
    return r.groupBy(shard).agg(
        F.count(F.lit(1)).alias("rows"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"),
        F.count_if(ordered.half(F.col("rank"), F.lit(n)) == 1).alias("first_half"), F.count_if(F.col("rank") < 1000).alias("prefix"),
    )


@query("pf10_selection", "part", sql="SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (1, 7, 50, 333, 1999, -4)")
def selection(p):
    return p.filter(F.col("p_partkey").isin(1, 7, 50, 333, 1999, -4)).select("p_partkey", "p_brand")


@query("pf13_d5_harvest", "documents", sql="""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'only thought' WHEN 2 THEN 'thought</think>  ' ELSE 'thought</think> answer ' || doc_id END AS t FROM documents)
  SELECT doc_id, CASE WHEN t IS NULL THEN 'empty' WHEN NOT contains(t, '</think>') THEN 'unclosed' WHEN trim(string_split(t, '</think>')[-1]) = '' THEN 'blank' ELSE 'harvested' END AS status,
  CASE WHEN contains(t, '</think>') AND trim(string_split(t, '</think>')[-1]) <> '' THEN trim(string_split(t, '</think>')[-1]) ELSE t END AS output FROM r""")
def harvest(d):
    """Rows without an answer keep their text, or go where drop is asked for; the status says which."""
    k = F.col("doc_id") % 4
    t = F.when(k == 1, "only thought").when(k == 2, "thought</think>  ").when(k == 3, F.concat(F.lit("thought</think> answer "), F.col("doc_id").cast("string")))
    return harvested(d.select("doc_id", t.alias("t")), "t").withColumnRenamed("t", "output")


def harvested(rows, column: str, drop: bool = False):
    """rows with the answer behind the scratchpad in `column`, and their status; drop leaves out those without one."""
    answer = text.after_last(F.col(column), "</think>")
    status = F.when(F.col(column).isNull(), "empty").when(answer.isNull(), "unclosed").when(answer == "", "blank").otherwise("harvested")
    out = rows.select("*", status.alias("status")).withColumn(column, F.when(F.col("status") == "harvested", answer).otherwise(F.col(column)))
    return out.filter("status = 'harvested'") if drop else out


@query("pf14_d11_own_final", "documents", sql="""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'own ' || doc_id ELSE 'forced' END AS final, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'own' ELSE 'forced' END AS origin, 'forced' AS original FROM documents""")
def own_final(d):
    """The own final line where the row finished and has one, else the forced; the original and where it comes from stay."""
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("own "), F.col("doc_id").cast("string")))
    rows = d.select("doc_id", F.lit("forced").alias("original"), own.alias("own"), (F.col("doc_id") % 2 == 0).alias("finished"))
    take = F.col("finished") & F.col("own").isNotNull()
    return rows.select("doc_id", F.when(take, F.col("own")).otherwise(F.col("original")).alias("final"), F.when(take, "own").otherwise("forced").alias("origin"), "original")


@query("pf16_tail_positions", "lineitem", sql="SELECT l_orderkey, count(*) AS tokens, round(sum(l_discount), 6) AS logprob FROM lineitem WHERE l_linenumber >= 3 GROUP BY l_orderkey")
def tail(line):
    """Only positions from the third on count."""
    return line.filter("l_linenumber >= 3").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("tokens"), F.round(F.sum("l_discount"), 6).alias("logprob"))


@query("pf20_retention", "lineitem", sql="SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS newest FROM lineitem GROUP BY 1) ON l_orderkey = k WHERE l_linenumber % 4 = 0 OR l_linenumber = newest")
def retention(line):
    return ordered.kept_steps(line.select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber", 4)


@query("j1_d7_w19_mixture", "documents", sql=f"WITH {TRACES} SELECT idx, CASE WHEN idx % 4 = 0 THEN 'a' ELSE 'b' END AS side, md5(CASE WHEN idx % 4 = 0 THEN output ELSE rewrite END) AS output, CASE WHEN idx % 4 = 0 THEN 1 ELSE 0 END AS doubts FROM traces")
def mixture(d):
    """Two sets of the same instructions zipped by place and checked; every fourth row is of the first."""
    t = traces(d)
    a, b = t.select("idx", "instruction", "output"), t.select("idx", "instruction", F.col("rewrite").alias("output"))
    both, stride = joins.positional(a, b, "idx", "instruction"), round(1 / 0.25)
    first = F.col("idx") % stride == 0
    mixed = both.select("idx", F.when(first, "a").otherwise("b").alias("side"), F.when(first, F.col("output")).otherwise(F.col("output_b")).alias("output"))
    return mixed.select("idx", "side", F.md5(F.col("output").cast("binary")).alias("output"), (F.col("side") == "a").cast("int").alias("doubts"))


@query("j2_keyed_fallback", "documents", sql="""WITH k AS (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN left(coalesce(text, ''), 80) ELSE CAST(doc_id % 500 AS VARCHAR) END AS key FROM documents),
  l AS (SELECT key, max(doc_id) AS doc_id FROM k GROUP BY key), r AS (SELECT key, max(doc_id) AS doc_id FROM k WHERE doc_id % 2 = 0 GROUP BY key) SELECT md5(key) AS key, l.doc_id, r.doc_id AS other FROM l JOIN r USING (key)""")
def keyed(d):
    key = joins.fallback_key(F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 500), F.coalesce("text", F.lit("")))
    k = d.select("doc_id", key.alias("key"))
    out = joins.keyed(k, k.filter("doc_id % 2 = 0"), "key", "doc_id")
    return out.select(F.md5(F.col("key").cast("binary")).alias("key"), "doc_id", F.col("doc_id_b").alias("other"))


@query("j3_validated_lookup", "lineitem", "orders", sql="SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def validated(line, o):
    """Every line has to find its order, with the same prompt; else the query fails."""
    prompt = lambda k: F.concat(F.lit(" order "), k.cast("string"))
    rows = line.select(F.col("l_orderkey").alias("id"), prompt(F.col("l_orderkey")).alias("prompt"), "l_quantity")
    table = o.select(F.col("o_orderkey").alias("id"), F.concat(prompt(F.col("o_orderkey")), F.lit("  ")).alias("prompt"), "o_orderstatus")
    out = joins.lookup(rows, table, "id", "prompt")
    return out.groupBy(F.col("o_orderstatus_b").alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j4_in_all", "events", sql=" INTERSECT ".join(f"SELECT user_id FROM events WHERE event_type = '{t}' AND value > 60" for t in ("click", "view", "purchase")))
def in_all(e):
    return joins.in_all([e.filter((F.col("event_type") == t) & (F.col("value") > 60)) for t in ("click", "view", "purchase")], "user_id")


@query("j5_pair_semi", "orders", sql="SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM orders p WHERE p.o_orderpriority = '1-URGENT' AND p.o_custkey = orders.o_custkey AND p.o_orderstatus = orders.o_orderstatus)")
def pair_semi(o):
    urgent = o.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c"), F.col("o_orderstatus").alias("s")).distinct()
    return o.join(urgent, (F.col("o_custkey") == F.col("c")) & (F.col("o_orderstatus") == F.col("s")), "left_semi").select("o_orderkey")


@query("j6_x2_pending", "orders", "lineitem", sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def pending(o, line):
    """Jobs less those that the cache has done."""
    done = line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return o.select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("j7_staged_pending", "events", sql="""WITH u AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id, bool_or(event_type = 'purchase' AND value > 90) AS own, bool_or(event_type = 'click' AND value > 90) AS hint FROM events GROUP BY user_id)
  SELECT 'all' AS stage, count(*) AS n FROM s UNION ALL SELECT 'hint', count(*) FILTER (NOT own) FROM s UNION ALL SELECT 'salvage', count(*) FILTER (NOT own AND NOT hint) FROM s""")
def staged(e):
    solved = lambda t: e.filter((F.col("event_type") == t) & (F.col("value") > 90)).select("user_id").distinct()
    left = joins.staged_pending(e.select("user_id").distinct(), [solved("purchase"), solved("click")], "user_id")
    counted = [d.agg(F.lit(name).alias("stage"), F.count(F.lit(1)).alias("n")) for name, d in zip(("all", "hint", "salvage"), left)]
    return counted[0].union(counted[1]).union(counted[2])


_LISTS = "WITH t AS (SELECT user_id, list(struct_pack(i := event_id, k := event_type, v := value) ORDER BY event_id) AS tries FROM events GROUP BY user_id)"


@query("j9_first_match", "events", sql=_LISTS + " SELECT user_id, list_filter(tries, lambda x: x.k = 'purchase' AND x.v > 50)[1].i AS event_id FROM t")
def first_match(e):
    t = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type", "value"))).alias("tries"))
    fits = lambda x: (x["event_type"] == "purchase") & (x["value"] > 50)
    return t.select("user_id", joins.first_match(F.col("tries"), fits)["event_id"].alias("event_id"))


@query("j10_conditional_source", "customer", "orders", sql="""WITH m AS (SELECT o_custkey, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY 1)
  SELECT c_custkey, c_acctbal < 0 AS marked, CASE WHEN c_acctbal < 0 THEN lo ELSE hi END AS price FROM customer LEFT JOIN m ON c_custkey = o_custkey""")
def conditional(c, o):
    by = lambda f: o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(f("o_totalprice").alias("price"))
    return joins.conditional_source(c.select("c_custkey"), c.filter("c_acctbal < 0"), by(F.min), by(F.max), "c_custkey", "price")


@query("j11_j18_so5_coverage", "events", sql="""WITH d AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase')), g AS (SELECT user_id, count(*) AS present FROM d GROUP BY 1),
  p AS (SELECT 'places' AS check, count(*) AS n FROM range(200) r(i) WHERE i NOT IN (SELECT user_id FROM events))
  SELECT 'keys' AS check, count(*) AS n FROM g WHERE present < 3 UNION ALL SELECT * FROM p""")
def coverage(e):
    parts = [e.filter(F.col("event_type") == t) for t in ("click", "view", "purchase")]
    count = lambda d, name: d.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n"))
    return count(joins.uncovered(parts, "user_id"), "keys").union(count(joins.missing_places(e, "user_id", 200), "places"))


@query("j14_d12_fan_out", "conversations", sql="SELECT conv_id, turn, min(conv_id * 1000 + turn) OVER (PARTITION BY text) AS answer FROM conversations")
def fan_out(c):
    """Equal texts are answered once, by the first; every turn gets the answer of its text."""
    rows = c.select("conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    answered = lambda once: once.select("text", F.col("place").alias("answer"))
    return joins.fan_out(rows, ["text"], "place", answered).select("conv_id", "turn", "answer")


@query("j15_d17_st1_gaps", "lineitem", sql="""WITH p AS (SELECT l_shipmode_ AS ds, seed, avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag = 'N') AS gap FROM (SELECT *, l_linestatus AS l_shipmode_, l_suppkey % 5 AS seed FROM lineitem) GROUP BY 1, 2)
  SELECT ds, count(*) AS seeds, round(avg(gap), 5) AS mean, round(2.776 * stddev_samp(gap) / sqrt(count(*)), 5) AS half FROM p GROUP BY ds""")
def gaps(line):
    from tracemill.functions import stats

    rows = line.select(F.col("l_linestatus").alias("ds"), (F.col("l_suppkey") % 5).alias("seed"), F.col("l_returnflag").alias("arm"), "l_quantity")
    scores = rows.groupBy("ds", "seed", "arm").agg(F.avg("l_quantity").alias("score"))
    pairs = joins.paired_gap(scores, ["ds", "seed"], "arm", "score", "R", "N")
    return pairs.groupBy("ds").agg(F.count(F.lit(1)).alias("seeds"), F.round(F.avg("gap"), 5).alias("mean"), F.round(stats.t_half_width(F.col("gap")), 5).alias("half"))
