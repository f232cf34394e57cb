"""Queries that write files below the shared folder and read them again, and those of the extension points."""

from __future__ import annotations

import threading
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text
from tracemill.operators import extend
from tracemill.operators.common import scratch
from tracemill.sources import runs, sinks
from tracemill.streaming import leases, readiness, resume

from .fixtures import TRACES, traces
from .registry import query


@query("sc1_sk1_json_array", "customer", sql="SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS idx, c_custkey, c_name FROM customer")
def json_array(c):
    path = scratch(c.sparkSession)
    sinks.write_json_array(c.select("c_custkey", "c_name"), path, "c_custkey")
    return runs.read_json_array(c.sparkSession, path, "c_custkey long, c_name string")


@query("sc2_sc3_sk2_sk3_json_lines", "customer", sql="SELECT c_nationkey, count(*) AS good, max(c_acctbal) AS most, (SELECT count(*) + 1 FROM customer) AS lines, 1 AS torn FROM customer GROUP BY c_nationkey")
def json_lines(c):
    """Lines in two appends, a blank and a torn one among them."""
    spark, path, schema = c.sparkSession, scratch(c.sparkSession), "c_custkey long, c_nationkey int, c_acctbal double"
    rows = c.select("c_custkey", "c_nationkey", "c_acctbal")
    sinks.write_json_lines(rows.filter("c_custkey % 2 = 0"), path)
    sinks.append(rows.filter("c_custkey % 2 != 0"), path)
    spark.createDataFrame([("",), ('{"c_custkey": 1, "c_na',)], "value string").coalesce(1).write.mode("append").text(path)
    good = runs.read_json_lines(spark, path, schema).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("good"), F.max("c_acctbal").alias("most"))
    return good.join(F.broadcast(runs.torn_lines(spark, path, schema)), F.lit(True))  # one row


@query("sc3_last_wins", "events", sql="SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def last_wins(e):
    """Of each user's lines the last in the file."""
    path = scratch(e.sparkSession)
    sinks.write_json_lines(e.select("user_id", "event_id").repartitionByRange("user_id").sortWithinPartitions("user_id", "event_id"), path)
    rows = runs.with_place(e.sparkSession.read.schema("user_id long, event_id long").json(path))
    return runs.last_per_key(rows, "user_id", "place").select("user_id", "event_id")


@query("ag30_shard_ranges", "orders", sql="SELECT 'shard=' || (o_orderkey % 4) AS file, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def ranges(o):
    """Rows, least and greatest key of each of four shards."""
    path = scratch(o.sparkSession)
    o.select("o_orderkey", (F.col("o_orderkey") % 4).alias("shard")).write.partitionBy("shard").parquet(path)
    return runs.shard_ranges(o.sparkSession.read.parquet(path), "o_orderkey")


@query("sc12_settings", "part", sql="SELECT 'small' AS name, count(*) AS n FROM part WHERE p_size BETWEEN 1 AND 9 AND p_brand IN ('Brand#1', 'Brand#12') UNION ALL SELECT 'large', count(*) FROM part WHERE p_size BETWEEN 10 AND 50 AND p_brand IN ('Brand#2', 'Brand#23', 'Brand#3')")
def settings(p):
    """Counts that a settings file asks for: a list of maps with lists in them."""
    spark, path = p.sparkSession, scratch(p.sparkSession)
    text_ = "# what to count\ncounts:\n  - name: small\n    size: [1, 9]\n    brands:\n      - 'Brand#1'\n      - \"Brand#12\"\n  - name: large\n    size: [10, 50]\n    brands: ['Brand#2', 'Brand#23', 'Brand#3']\n"
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(path)
    wanted = runs.read_settings(spark.read.text(path, wholetext=True).first()["value"])["counts"]
    inside = lambda c: F.col("p_size").between(*c["size"]) & F.col("p_brand").isin(c["brands"])
    sums = p.agg(*[F.count_if(inside(c)).alias(c["name"]) for c in wanted])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c["name"]).alias("name"), F.col(c["name"]).alias("n")) for c in wanted])).alias("x")).select("x.*")


@query("sc4_resume", "customer", sql="SELECT c_custkey, c_custkey % 3 <> 1 AS done FROM customer")
def cache(c):
    spark, path = c.sparkSession, scratch(c.sparkSession)
    sinks.append(c.filter("c_custkey % 3 != 1").select("c_custkey"), path)
    spark.createDataFrame([('{"c_custkey": 4',)], "value string").write.mode("append").text(path)
    done, pending = runs.resumed(spark, path, c.select("c_custkey"), "c_custkey", "c_custkey long")
    return done.withColumn("done", F.lit(True)).union(pending.withColumn("done", F.lit(False)))


def _tree(e: DataFrame) -> str:
    """Events by type and class in folders condition/model/benchmark/run."""
    root = scratch(e.sparkSession)
    for run in ("t0.0_k1_s0_e9.jsonl", "t0.7_k4_s10_e99.jsonl"):
        greedy = run.startswith("t0.0")
        for kind in ("click", "view"):
            part = e.filter((F.col("event_type") == kind) & ((F.col("user_id") % 2 == 0) == F.lit(greedy)))
            part.select("event_id", "user_id", "value").write.json(f"{root}/{kind}/m1/b1/{run}")
    return root


def _scan(e: DataFrame) -> DataFrame:
    rows = e.sparkSession.read.schema("event_id long, user_id long, value double").option("recursiveFileLookup", True).json(_tree(e))
    return runs.with_path_columns(rows, ["condition", "model", "benchmark", "run"])


@query("sc5_sc6_pf11_path_columns", "events", sql="SELECT event_type AS condition, 'm1' AS model, 'b1' AS benchmark, CASE WHEN user_id % 2 = 0 THEN 0.0 ELSE 0.7 END AS temperature, CASE WHEN user_id % 2 = 0 THEN 1 ELSE 4 END AS k, CASE WHEN user_id % 2 = 0 THEN 9 ELSE 99 END AS end, user_id % 2 = 0 AS greedy, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL")
def path_columns(e):
    rows = _scan(e)
    named = rows.withColumns({**{n: c for n, c in runs.name_parameters(F.col("run")).items() if n != "start"}, "greedy": runs.is_greedy(F.col("run"))})
    return named.groupBy("condition", "model", "benchmark", "temperature", "k", "end", "greedy").agg(F.count(F.lit(1)).alias("n"))


@query("sc7_first_file", "events", sql="SELECT event_type AS condition, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 GROUP BY 1")
def first_file(e):
    return runs.first_file(_scan(e), ["condition"], "run").groupBy("condition").agg(F.count(F.lit(1)).alias("n"))


@query("sc8_tries_of_shards", "events", sql="SELECT user_id, array_to_string(list(event_id ORDER BY event_id % 3, event_id), ',') AS tries FROM events GROUP BY user_id")
def shards(e):
    """Three shards with a list of tries for each user, put together in order of shard."""
    spark, root = e.sparkSession, scratch(e.sparkSession)
    paths = [f"{root}/part{i}" for i in range(3)]
    for i, path in enumerate(paths):
        own = e.filter(F.col("event_id") % 3 == i).groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("tries"))
        own.write.json(path)
    out = runs.read_shards(spark, paths, "user_id long, tries array<long>", "user_id", "tries")
    return out.select("user_id", F.array_join(F.col("tries").cast("array<string>"), ",").alias("tries"))


@query("sc9_sidecar", "part", sql="SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS idx, p_name, p_size AS retries FROM part")
def sidecar(p):
    spark, root = p.sparkSession, scratch(p.sparkSession)
    sinks.write_json_array(p.select("p_partkey", "p_name"), f"{root}/x.json", "p_partkey")
    sinks.write_json_array(p.select("p_partkey", F.col("p_size").alias("retries")), f"{root}/x.meta.json", "p_partkey")
    return runs.with_sidecar(spark, f"{root}/x.json", f"{root}/x.meta.json", "p_name string", "retries int")


@query("sc10_document_rows", "nation", sql="SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_name FROM nation")
def document_rows(n):
    spark, path = n.sparkSession, scratch(n.sparkSession)
    sinks.write_documents(n.select("n_nationkey", "n_name"), path, "n_nationkey", most=10, summary="s")
    return runs.read_document_rows(spark, path, "n_nationkey long, n_name string").select("idx", "n_name")


@query("sc11_dataset", "supplier", sql="SELECT s_suppkey AS id, s_name AS question FROM supplier")
def dataset(s):
    path = scratch(s.sparkSession)
    sinks.checkpoint_batch(s.limit(1), path)
    sinks.checkpoint_batch(s, path)  # SK4: the whole in place of what was there
    return runs.read_dataset(s.sparkSession, path, {"id": "s_suppkey", "question": "s_name"})


@query("sk5_keep_original", "nation", sql="SELECT 'now' AS what, n_nationkey + 2 AS key FROM nation UNION ALL SELECT 'original', n_nationkey FROM nation")
def keep_original(n):
    spark, path = n.sparkSession, scratch(n.sparkSession)
    for i in range(3):
        sinks.replace_keeping_first(n.select((F.col("n_nationkey") + i).alias("key")), path)
    read = lambda what, p: spark.read.parquet(p).select(F.lit(what).alias("what"), "key")
    return read("now", path).union(read("original", f"{path}.original"))


@query("sk6_sk7_csv", "events", sql="WITH h AS (SELECT least(floor(value / 10.0), 19) AS b, count(*) AS c FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1) SELECT CAST(i AS VARCHAR) AS bin, CAST(coalesce(c, 0) AS VARCHAR) AS count, printf('%.6f', coalesce(c / ((SELECT count(value) FROM events) * 10.0), 0)) AS density FROM range(20) r(i) LEFT JOIN h ON b = i")
def csv(e):
    from tracemill.operators import evals

    path = scratch(e.sparkSession)
    sinks.write_csv(evals.histogram(e, "value", 0.0, 200.0, 20), path, 6)
    return e.sparkSession.read.option("header", True).csv(path)


@query("sk8_markdown", "events", sql="""WITH t AS (SELECT event_type, count(*) AS n, CASE WHEN event_type <> 'view' THEN round(avg(value), 1) END AS mean FROM events GROUP BY 1)
  SELECT 0 AS place, '| event_type | n | mean |' AS line UNION ALL SELECT 1, '| --- | --- | --- |' UNION ALL SELECT 1 + row_number() OVER (ORDER BY event_type), '| ' || event_type || ' | ' || n || ' | ' || coalesce(printf('%.1f', mean) || '%', '—') || ' |' FROM t""")
def markdown(e):
    t = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 1).alias("mean"))
    t = t.withColumn("mean", F.when(F.col("event_type") != "view", F.col("mean")))
    return sinks.markdown_lines(t, {"event_type": None, "n": None, "mean": "%.1f%%"}, [F.col("event_type")])


@query("sk9_example_sheet", "documents", sql=f"WITH {TRACES} SELECT idx, md5('## ' || idx || chr(10) || chr(10) || CASE WHEN length(output) > 1500 THEN left(output, 900) || ' [... ' || format('{{:,}}', length(output) - 1500) || ' characters ...] ' || right(output, 600) ELSE output END) AS sheet FROM traces")
def sheets(d):
    return sinks.example_sheet(traces(d), "idx", "output").select("idx", F.md5(F.col("sheet").cast("binary")).alias("sheet"))


@query("sk11_summary", "events", sql="""SELECT '{"rows":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS summary FROM events""")
def summary(e):
    return sinks.summary_line(e, {"rows": F.count(F.lit(1)), "users": F.count_distinct("user_id")})


@query("sk12_sidecar_changes", "part", sql="SELECT count(*) AS rows, count(*) FILTER (p_partkey % 4 = 0) AS p_size, count(*) FILTER (p_partkey % 5 = 0) AS p_brand FROM part")
def changes(p):
    new = p.withColumn("p_size", F.when(F.col("p_partkey") % 4 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")))
    new = new.withColumn("p_brand", F.when(F.col("p_partkey") % 5 == 0, "other").otherwise(F.col("p_brand")))
    return sinks.sidecar_changes(p, new, "p_partkey", ["p_size", "p_brand"])


@query("x1_x4_resumed_stream", "events", sql="SELECT event_id, value * 2 AS doubled FROM events WHERE value IS NOT NULL")
def resumed(e):
    """Half of the files, then the rest: the second run works on those alone, and nothing is done twice."""
    spark, root = e.sparkSession, scratch(e.sparkSession)
    rows = e.filter("value IS NOT NULL").select("event_id", "value")
    for half in (0, 1):
        rows.filter(F.col("event_id") % 2 == half).write.mode("append").json(f"{root}/in")
        work = lambda r: r.select("event_id", (F.col("value") * 2).alias("doubled"))
        resume.process_new_files(spark, f"{root}/in", "event_id long, value double", work, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("x3_round_cache", "nation", sql="SELECT n_nationkey, 1 AS made FROM nation")
def round_cache(n):
    """The second call finds a finished round and makes nothing."""
    spark, path = n.sparkSession, scratch(n.sparkSession)
    for i in (1, 2):
        out = resume.once(spark, path, lambda i=i: n.select("n_nationkey", F.lit(i).alias("made")))
    return out


@query("u1_u2_u4_defense", "documents", sql=f"WITH {TRACES} SELECT idx, instruction, md5(CASE WHEN idx % 2 = 0 THEN output || '.' ELSE output END) AS output FROM traces")
def defense(d):
    t = traces(d).select("idx", "instruction", "output")
    responses = t.select("idx", F.when(F.col("idx") % 2 == 0, F.concat("output", F.lit("."))).otherwise("").alias("response"), F.lit("stop").alias("finish"))
    out = extend.applied(extend.Rewrite(responses, ratio=text.STYLE_RATIO), t)
    return out.select("idx", "instruction", F.md5(F.col("output").cast("binary")).alias("output"))


def _lengths(texts: list[str]) -> list[int]:
    return [len(t.split()) for t in texts]


@query("u3_u6_u7_batched", "conversations", sql="SELECT conv_id, turn, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\s]+')) AS INT) AS tokens, CAST(turn % 3 AS DOUBLE) AS reward, turn + 1 AS next FROM conversations")
def batched(c):
    """A token counter, a reward and a row function that come from outside."""
    count = extend.counter(_lengths)
    out = c.select("conv_id", "turn", text.token_count(F.col("text"), count).alias("tokens"), extend.batched(lambda t: [float(x % 3) for x in t], "turn").alias("reward"))
    return extend.mapped(out, lambda r: r | {"next": r["turn"] + 1}, "conv_id long, turn long, tokens int, reward double, next long")


@query("u5_u9_measure", "events", sql="SELECT user_id, count(*) AS n, round(avg(CASE WHEN lower(event_type) = 'purchase' THEN 1.0 ELSE 0 END), 6) AS p, round(CASE WHEN avg(CASE WHEN lower(event_type) = 'purchase' THEN 1.0 ELSE 0 END) > 0 THEN -log2(avg(CASE WHEN lower(event_type) = 'purchase' THEN 1.0 ELSE 0 END)) END, 6) AS bits FROM events GROUP BY user_id")
def measure(e):
    """Surprisal by an equality of one's own."""
    from tracemill.functions import answers

    same = lambda a, b: F.lower(a) == F.lower(b)
    box = lambda c: F.concat(F.lit("\\boxed{"), c, F.lit("}"))
    hit = answers.answers_agree(F.lit("\\boxed{PURCHASE}"), box(F.col("event_type")), same)
    out = extend.measured(e, "user_id", hit)
    return out.select("user_id", "n", F.round("p", 6).alias("p"), F.round("bits", 6).alias("bits"))


@query("u8_generated_rows", "documents", sql=f"WITH {TRACES} SELECT idx, len(regexp_split_to_array(output, '\\n[ \\t]*\\n\\s*')) AS rows FROM traces")
def generated(d):
    """One row to many, and counted again."""
    rows = traces(d).select("idx", F.explode(text.paragraphs(F.col("output"))["parts"]).alias("p"))
    return rows.groupBy("idx").agg(F.count(F.lit(1)).alias("rows"))


@query("so1_union_of_files", "orders", sql="SELECT o_orderkey, o_orderstatus FROM orders")
def union_of_files(o):
    parts = [o.filter(F.col("o_orderkey") % 3 == i).select(*(["o_orderkey", "o_orderstatus"] if i else ["o_orderstatus", "o_orderkey"])) for i in range(3)]
    return reduce(DataFrame.unionByName, parts)


@query("x5_pool", "orders", sql="""SELECT CAST(o_orderpriority AS VARCHAR) AS job, count(*) AS orders, round(sum(o_totalprice), 2) AS total, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 2 ELSE 1 END AS attempt
  FROM orders WHERE o_orderpriority NOT LIKE '3%' GROUP BY o_orderpriority""")
def pool_of_jobs(o):
    """A job for each priority, by two streams at once: one job's first holder is dead, one fails at first, one always."""
    spark, root = o.sparkSession, scratch(o.sparkSession)
    o.select("o_orderpriority").distinct().write.json(f"{root}/jobs")
    dead = leases.Pool(spark, f"{root}/pool", clock=lambda: 0.0)
    dead.claim("1-URGENT", "dead")

    def work(job):
        if job.startswith("3") or (job.startswith("2") and pool.state(job)[1] == 1):
            raise ValueError(f"{job} fails")
        return o.filter(F.col("o_orderpriority") == job).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))

    pool = leases.Pool(spark, f"{root}/pool")
    jobs = spark.readStream.schema("o_orderpriority string").json(f"{root}/jobs")
    runs_ = [leases.serve(pool, jobs, "o_orderpriority", work, f"run {i}", f"{root}/state{i}", slots=2, poll_s=0.2) for i in (1, 2)]
    for r in runs_:
        r.awaitTermination()
    return pool.results("orders long, total double").select("job", "orders", "total", "attempt")


@query("x6_readiness", "nation", sql="SELECT 'late' AS gate, 'ready' AS status, count(*) AS nations FROM nation UNION ALL SELECT 'never', 'timed_out', NULL")
def gates(n):
    """A count that waits for a file that comes late, and one for a file that never comes."""
    spark, root = n.sparkSession, f"/{scratch(n.sparkSession).removeprefix('file:').lstrip('/')}"
    n.limit(0).write.parquet(f"{root}/there")
    late = threading.Timer(1, lambda: n.limit(0).write.json(f"{root}/late"))
    late.start()
    count = lambda: n.agg(F.count(F.lit(1)).alias("nations")).write.parquet(f"{root}/count")
    found = []
    for gate, url, action, seconds in (("late", f"file://{root}/late/_SUCCESS", count, 60), ("never", f"file://{root}/never", count, 1)):
        found.append((gate, readiness.when_ready(spark, url, action, f"{root}/state-{gate}", seconds, 0.2)[0]))
    counts = spark.read.parquet(f"{root}/count").withColumn("g", F.lit("late"))
    rows = spark.createDataFrame(found, "gate string, status string")
    return rows.join(counts, F.col("gate") == F.col("g"), "left").select("gate", "status", "nations")
