"""A table that is computed bucket by bucket, each of which is committed by itself.

A long computation over series is cut into buckets by a hash of their uid. A bucket's rows are written to a folder of
their own, and count once a small commit file stands beside them, which is written last and in one step. A run that is
killed loses the buckets under way, no more: the next one reads the commits, takes the series that none of them covers, and writes
their rows again from the start. Rows without a commit are never read, and are replaced by the next attempt.

Under ``root/name``: ``run_key=K/bucket=B/part=P`` has rows, ``ledger/K`` the commits and the uids that each of them covers (a series may
have no row at all). A bucket gets a further part when series come that weren't there before. One run at a time may write a key.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblecast.sources.store import Store

COMMIT = "bucket int, part int, series long, rows long, checksum long"


class Ledger:
    """The committed rows of one run; ``buckets`` is settled by the first run of a key."""

    def __init__(self, spark: SparkSession, root: str, name: str, key: str, buckets: int = 16):
        if buckets < 1:
            raise ValueError("a ledger has one bucket at least")
        self.spark, self.name, self.key = spark, name, key
        self.files = Store(spark, root)
        self.at = f"{name}/ledger/{key}"
        plan = f"{self.at}/plan.json"
        self.buckets = self.files.get_json(plan)["buckets"] if self.files.exists(plan) else buckets

    def commits(self) -> list[dict]:
        """One for each part of a bucket."""
        if not self.files.exists(f"{self.at}/commits"):
            return []
        rows = self.spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(self.files.uri(f"{self.at}/commits")).collect()
        return sorted((r.asDict() for r in rows), key=lambda r: (r["bucket"], r["part"]))

    def _rows(self, bucket: int, part: int) -> str:
        return self.files.uri(f"{self.name}/run_key={self.key}/bucket={bucket}/part={part}")

    def _covered(self, bucket: int, part: int) -> str:
        return self.files.uri(f"{self.at}/covered/bucket={bucket}/part={part}")

    def _all(self, path: Callable[[int, int], str]) -> DataFrame:
        return self.spark.read.parquet(*(path(c["bucket"], c["part"]) for c in self.commits()))

    def covered(self) -> DataFrame:
        """uid of all series that are done."""
        return self._all(self._covered) if self.commits() else self.spark.createDataFrame([], "uid string")

    def read(self) -> DataFrame:
        """The committed rows."""
        if not self.commits():
            raise LookupError(f"nothing is committed under {self.files.uri(self.at)}")
        return self._all(self._rows)

    def open(self, series: DataFrame) -> DataFrame:
        """The series that no commit covers, with their bucket."""
        left = series.join(self.covered(), "uid", "left_anti")
        return left.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(self.buckets)).cast("int"))

    def _commit(self, bucket: int, part: int) -> None:
        rows = self.spark.read.parquet(self._rows(bucket, part))
        counted = rows.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("checksum")).first()
        series = self.spark.read.parquet(self._covered(bucket, part)).count()
        self.files.put_json(f"{self.at}/commits/{bucket}-{part}.json", {"bucket": bucket, "part": part, "series": series, "rows": counted["rows"], "checksum": counted["checksum"]})

    def run(self, series: DataFrame, work: Callable[[DataFrame], DataFrame], at_once: int = 2) -> list[tuple[int, int]]:
        """Computes what is open and returns the (bucket, part) that were committed.

        ``work(series) -> rows`` gets the series of one bucket. A bucket is one job after another, so ``at_once`` of them run side by
        side: the tail of one doesn't leave a cluster idle. After a failure those under way are finished, no other is begun.
        """
        plan = f"{self.at}/plan.json"
        if not self.files.exists(plan):
            self.files.put_json(plan, {"buckets": self.buckets})
        latest = {c["bucket"]: c["part"] for c in self.commits()}
        left = self.open(series)
        counts = {r["bucket"]: r["count"] for r in left.groupBy("bucket").count().collect()}  # a row a bucket
        todo = [(b, latest.get(b, -1) + 1) for b in sorted(counts)]

        def one(bucket: int, part: int) -> tuple[int, int]:
            own = left.where(F.col("bucket") == bucket).drop("bucket")
            own.select("uid").write.mode("overwrite").parquet(self._covered(bucket, part))
            work(own).write.mode("overwrite").parquet(self._rows(bucket, part))
            self._commit(bucket, part)
            return bucket, part

        done: list[tuple[int, int]] = []
        with ThreadPoolExecutor(max(1, at_once)) as threads:
            under_way: set[Future] = set()
            while todo or under_way:
                while todo and len(under_way) < at_once:
                    under_way.add(threads.submit(inheritable_thread_target(self.spark)(one), *todo.pop(0)))
                finished, under_way = wait(under_way, return_when=FIRST_COMPLETED)
                failed = [f for f in finished if f.exception()]
                done += [f.result() for f in finished if not f.exception()]
                if failed:
                    wait(under_way)
                    raise failed[0].exception()
        return done

    def verify(self) -> list[tuple[int, int]]:
        """The parts whose rows no longer are what was committed."""
        broken = []
        for c in self.commits():
            rows = self.spark.read.parquet(self._rows(c["bucket"], c["part"]))
            found = rows.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0)).alias("checksum")).first()
            if (found["rows"], found["checksum"]) != (c["rows"], c["checksum"]):
                broken.append((c["bucket"], c["part"]))
        return broken
