"""A pool of jobs that several runs share: each job is done once, by whoever holds its lease.

The pool is a folder that all runs see. A claim is a folder that a run makes under a name of its own, with its lease in it,
and renames to `claims/<job>/<attempt>`; one rename of several wins, and whose it was the folder itself tells: it holds the
winner's file, while later ones end up inside of it or fail. Results are made the job's own in the same way,
by a rename to `done/<job>`, so what a run finishes after its lease has expired counts only if no other has finished. Nothing
is ever changed or deleted. It needs a file system that renames folders in one step, as HDFS and local disks do.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import quote, unquote
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


class Pool:
    """The claims and results below a folder. clock gives seconds, the same for all runs but for small differences."""

    def __init__(self, spark: SparkSession, folder: str, lease_s: float = 600, attempts: int = 3, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.lease_s, self.attempts, self.clock = spark, folder, lease_s, attempts, clock
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("claims", "done", "failed", "made"):
            self._fs.mkdirs(self._path(f"{folder}/{name}"))

    def _names(self, path: str) -> list[str]:
        where = self._path(f"{self.folder}/{path}")
        return [s.getPath().getName() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(f"{self.folder}/{path}"), False)
        out.write(bytearray(text.encode()))
        out.close()

    def _won(self, made: str, place: str, mark: str) -> bool:
        """Whether the folder `made`, which holds a file named mark, has become the folder `place`."""
        if self._fs.exists(self._path(f"{self.folder}/{place}")):
            return False
        self._fs.rename(self._path(f"{self.folder}/{made}"), self._path(f"{self.folder}/{place}"))
        return self._fs.exists(self._path(f"{self.folder}/{place}/{mark}"))

    def done(self) -> set[str]:
        return {unquote(x) for x in self._names("done")}

    def state(self, job: str) -> tuple[str, int]:
        """(done, leased, open or exhausted; the last attempt)."""
        key = quote(job, safe="")
        if self._fs.exists(self._path(f"{self.folder}/done/{key}")):
            return "done", self._last(key)
        last = self._last(key)
        if last and str(last) not in self._names(f"failed/{key}"):
            until = max((float(n[6:]) for n in self._names(f"claims/{key}/{last}") if n.startswith("until-")), default=0.0)
            if until > self.clock():
                return "leased", last
        return ("open" if last < self.attempts else "exhausted"), last

    def _last(self, key: str) -> int:
        return max((int(n) for n in self._names(f"claims/{key}")), default=0)

    def claim(self, job: str, owner: str) -> int | None:
        """The number of the attempt if this call has won the job's next one; None if there is none or another has it."""
        state, last = self.state(job)
        if state != "open":
            return None
        key, mine = quote(job, safe=""), uuid4().hex
        self._put(f"made/{mine}/owner-{mine}", json.dumps({"owner": owner, "at": self.clock()}))
        self._put(f"made/{mine}/until-{self.clock() + self.lease_s:.3f}", "")
        self._fs.mkdirs(self._path(f"{self.folder}/claims/{key}"))
        return last + 1 if self._won(f"made/{mine}", f"claims/{key}/{last + 1}", f"owner-{mine}") else None

    def renew(self, job: str, attempt: int) -> None:
        """Holds the lease for its whole time from now."""
        self._put(f"claims/{quote(job, safe='')}/{attempt}/until-{self.clock() + self.lease_s:.3f}", "")

    def fail(self, job: str, attempt: int, why: str) -> None:
        """Gives the attempt up at once."""
        self._put(f"failed/{quote(job, safe='')}/{attempt}", why)

    def finish(self, job: str, attempt: int, rows: DataFrame) -> bool:
        """Writes the rows and makes them the job's result, unless it has one; whether these are it."""
        mine = uuid4().hex
        rows.withColumn("attempt", F.lit(attempt)).write.parquet(f"{self.folder}/made/{mine}")
        self._put(f"made/{mine}/_owner-{mine}", str(attempt))
        return self._won(f"made/{mine}", f"done/{quote(job, safe='')}", f"_owner-{mine}")

    def run(self, job: str, attempt: int, work: Callable[[str], DataFrame]) -> bool:
        """Does a claimed job and renews its lease meanwhile; a failure is noted and leaves the job to the next attempt."""
        over = threading.Event()

        def beat() -> None:
            while not over.wait(self.lease_s / 3):
                self.renew(job, attempt)

        threading.Thread(target=beat, daemon=True).start()
        try:
            return self.finish(job, attempt, work(job))
        except Exception as e:  # whatever work raises is a failed attempt
            self.fail(job, attempt, f"{type(e).__name__}: {e}"[:2000])
            return False
        finally:
            over.set()

    def work_off(self, jobs: list[str], work: Callable[[str], DataFrame], owner: str, slots: int = 4, poll_s: float = 1.0) -> None:
        """Returns when each of the jobs is done or exhausted, by this run or another. Up to `slots` run at once."""
        with ThreadPoolExecutor(slots) as threads:
            while True:
                states = {j: self.state(j)[0] for j in jobs}
                jobs = [j for j in jobs if states[j] in ("open", "leased")]
                if not jobs:
                    return
                claimed = []
                for j in jobs:
                    if states[j] == "open" and len(claimed) < slots and (attempt := self.claim(j, owner)):
                        claimed.append((j, attempt))
                if claimed:
                    list(threads.map(lambda c: self.run(*c, work), claimed))
                else:
                    time.sleep(poll_s)

    def results(self, schema: str) -> DataFrame:
        """(job, attempt and the columns of schema): the rows of all finished jobs."""
        rows = self.spark.read.schema(f"{schema}, attempt int").parquet(f"{self.folder}/done/*")
        name = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return rows.withColumn("job", F.url_decode(F.url_decode(name)))  # the name's own escapes, within those of a path


def serve(pool: Pool, arriving: DataFrame, job: str, work: Callable[[str], DataFrame], owner: str, checkpoint: str, slots: int = 4, poll_s: float = 1.0) -> StreamingQuery:
    """A stream of jobs worked off batch by batch until none are left; several streams over one source share the jobs.

    A batch's jobs are few: names of work that is itself a Spark job. A batch that is run again after a crash finds what
    was finished, and waits for leases that have not expired.
    """

    def batch(rows: DataFrame, _: int) -> None:
        pool.work_off(sorted(r[0] for r in rows.select(F.col(job).cast("string")).distinct().collect()), work, owner, slots, poll_s)

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
