"""Leases and readiness: one winner for a job, dead and failing holders, late and missing answers."""

import threading
import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tracemill.streaming import leases, readiness


def test_one_of_many_claims_wins(spark, tmp_path):
    pools = [leases.Pool(spark, f"file://{tmp_path}/pool") for _ in range(8)]
    for round_ in range(6):
        gate = threading.Barrier(8)

        def claim(pool, job=f"job/{round_}"):
            gate.wait()
            return pool.claim(job, "any")

        with ThreadPoolExecutor(8) as threads:
            won = list(threads.map(claim, pools))
        assert Counter(won) == {1: 1, None: 7}
    assert pools[0].state("job/0") == ("leased", 1) and pools[0].state("never seen") == ("open", 0)


def test_attempts_leases_and_results(spark, tmp_path):
    now = [100.0]
    pool = leases.Pool(spark, f"file://{tmp_path}/pool", lease_s=10, attempts=3, clock=lambda: now[0])
    rows = lambda n: spark.range(n).select(F.col("id"))
    assert pool.claim("a", "x") == 1 and pool.claim("a", "y") is None
    now[0] += 8
    pool.renew("a", 1)
    now[0] += 8
    assert pool.claim("a", "y") is None  # renewed
    now[0] += 3
    assert pool.claim("a", "y") == 2  # expired
    assert pool.finish("a", 2, rows(2)) and not pool.finish("a", 1, rows(1))  # the late one does not count
    assert pool.state("a") == ("done", 2) and pool.claim("a", "z") is None
    for i in (1, 2, 3):
        assert pool.claim("b", "x") == i
        pool.fail("b", i, "no")
    assert pool.state("b") == ("exhausted", 3) and pool.claim("b", "x") is None
    assert sorted(map(tuple, pool.results("id long").select("job", "id", "attempt").collect())) == [("a", 0, 2), ("a", 1, 2)]


def test_two_runs_share_the_jobs(spark, tmp_path):
    pool = leases.Pool(spark, f"file://{tmp_path}/pool")
    jobs = [f"job {i}" for i in range(12)]
    spark.createDataFrame([(j,) for j in jobs], "name string").repartition(3).write.json(f"{tmp_path}/jobs")
    begun, lock = Counter(), threading.Lock()

    def work(owner):
        def run(job):
            with lock:
                begun[job] += 1
            if job == "job 5" and begun[job] == 1:
                raise RuntimeError("once")
            return spark.range(1).select(F.lit(owner).alias("owner"))

        return run

    source = spark.readStream.schema("name string").json(f"{tmp_path}/jobs")
    runs = [leases.serve(pool, source, "name", work(f"run {i}"), f"run {i}", f"{tmp_path}/state{i}", slots=2, poll_s=0.1) for i in range(2)]
    for r in runs:
        r.awaitTermination()
    got = {r["job"]: r["attempt"] for r in pool.results("owner string").collect()}
    assert got == {j: 2 if j == "job 5" else 1 for j in jobs}
    assert begun == Counter(jobs) + Counter(["job 5"])


def test_a_late_answer_and_none(spark, tmp_path):
    ran = []

    def comes_up():
        while not (tmp_path / "a/commits/0").exists():  # behind the first poll
            time.sleep(0.1)
        (tmp_path / "server").write_text("model: up")

    threading.Thread(target=comes_up, daemon=True).start()
    status, polls = readiness.when_ready(spark, f"file://{tmp_path}/server", lambda: ran.append(time.time()), f"{tmp_path}/a", 60, 0.3, contains="up")
    assert status == "ready" and polls > 1 and len(ran) == 1
    status, polls = readiness.when_ready(spark, f"file://{tmp_path}/server", lambda: ran.append(0), f"{tmp_path}/b", 1.5, 0.3, contains="down")
    assert status == "timed_out" and polls > 1 and len(ran) == 1
    with pytest.raises(Exception, match="refused to start"):
        readiness.when_ready(spark, f"file://{tmp_path}/server", lambda: (_ for _ in ()).throw(ValueError("refused to start")), f"{tmp_path}/c", 5, 0.3)
