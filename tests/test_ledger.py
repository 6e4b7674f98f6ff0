"""Long runs that are killed, and pools over many tasks."""

import os
import signal
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ensemblecast.plans import experiment
from ensemblecast.sources import series as sources
from ensemblecast.sources.ledger import Ledger

ROOT = str(Path(__file__).parents[1])


def made(spark, count=24, points=60):
    rng = np.random.default_rng(5)
    t = np.arange(points)
    rows = [(f"s{k:02}", i + 1, float(v)) for k in range(count) for i, v in enumerate((100 + t) * (1 + 0.15 * np.sin(t * np.pi / 6 + k)) * np.exp(rng.normal(0, 0.03, points)))]
    return sources.from_long(spark.createDataFrame(rows, "uid string, idx int, y double"), 12, 12)


def stage(own):
    return experiment.stage_a(own, 6, engine="snaive")


KILLED = """
import os, signal, sys
sys.path[:0] = [{root!r}, {tests!r}]
from ensemblecast.session import local_session
from ensemblecast.sources.ledger import Ledger
from test_ledger import made, stage

class Dies(Ledger):
    def _commit(self, bucket, part):
        if len(self.commits()) == 3:  # the rows of a fourth bucket are written, but not committed
            os.kill(os.getpid(), signal.SIGKILL)
        super()._commit(bucket, part)

spark = local_session(2)
Dies(spark, {where!r}, "artifacts", "k", 8).run(made(spark), stage, at_once=1)
"""


def rows(frame):
    return sorted((r["uid"], r["member"], tuple(r["y"]), tuple(r["fc"]), r["val_err"]) for r in frame.collect())


def test_a_killed_run_is_taken_up(spark, tmp_path):
    where = str(tmp_path / "runs")
    done = subprocess.run([sys.executable, "-c", KILLED.format(root=ROOT, tests=str(Path(__file__).parent), where=where)], capture_output=True, text=True, timeout=300)
    assert done.returncode == -signal.SIGKILL, done.stderr
    series = made(spark).cache()
    ledger = Ledger(spark, where, "artifacts", "k", 99)  # the first run has settled the number of buckets
    before = ledger.commits()
    assert ledger.buckets == 8 and len(before) == 3
    partial = {int(p.name.split("=")[1]) for p in (tmp_path / "runs" / "artifacts" / "run_key=k").iterdir()} - {c["bucket"] for c in before}
    assert len(partial) == 1  # its rows are there and don't count
    assert ledger.read().select("uid").distinct().count() == sum(c["series"] for c in before)
    fitted = []

    def watched(own):
        fitted.extend(r["uid"] for r in own.select("uid").collect())
        return stage(own)

    known = {r["uid"] for r in ledger.covered().collect()}
    ledger.run(series, watched)
    assert sorted(fitted) == sorted({r["uid"] for r in series.collect()} - known) and known
    assert ledger.commits()[:0] == [] and {c["bucket"]: c["checksum"] for c in before}.items() <= {c["bucket"]: c["checksum"] for c in ledger.commits()}.items()
    whole = Ledger(spark, str(tmp_path / "undisturbed"), "artifacts", "k", 3)
    whole.run(series, stage)
    assert rows(ledger.read()) == rows(whole.read()) and ledger.verify() == []
    assert ledger.run(series, watched) == [] and len(fitted) == 24 - len(known)


def test_later_series_make_a_further_part(spark, tmp_path):
    series = made(spark, 10).cache()
    ledger = Ledger(spark, str(tmp_path), "t", "k", 2)
    work = lambda own: own.where("uid <> 's00'").select("uid", F.size("y_train").alias("n"))
    first = ledger.run(series.where("uid < 's05'"), work)
    again = ledger.run(series, work)
    assert {p for _, p in first} == {0} and {p for _, p in again} <= {0, 1} and 1 in {p for _, p in again}
    assert sorted(r["uid"] for r in ledger.read().collect()) == [f"s{k:02}" for k in range(1, 10)]
    assert ledger.run(series, work) == []  # a series without a row isn't tried again


def test_a_failed_bucket_stays_open(spark, tmp_path):
    series = made(spark, 10).cache()
    ledger = Ledger(spark, str(tmp_path), "t", "k", 4)
    calls = []

    def fails(own):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return own.select("uid")

    with pytest.raises(RuntimeError):
        ledger.run(series, fails, at_once=1)
    assert len(ledger.commits()) == 1 and len(calls) == 2
    ledger.run(series, lambda own: own.select("uid"))
    assert ledger.read().count() == ledger.covered().count() == 10
    folder = next((tmp_path / "t" / "run_key=k").rglob("part-*.parquet"))
    other = next(p for p in (tmp_path / "t" / "run_key=k").rglob("part-*.parquet") if p.parent != folder.parent)
    os.replace(other, folder)
    for crc in (tmp_path / "t").rglob(".*.crc"):
        crc.unlink()
    assert ledger.verify()


def test_pool_over_many_tasks(spark):
    """1000 members of one series on 1, 4 and 16 tasks are equal, and each task builds its share."""
    series = made(spark, 1, 90).cache()
    found = []
    for tasks in (1, 4, 16):
        pool = experiment.pool(series, 1000, 7, parts=tasks, span=-(-1000 // tasks)).withColumn("task", F.spark_partition_id())
        got = pool.select("member", "task", "y", "n_clipped").collect()
        sizes = {}
        for r in got:
            sizes[r["task"]] = sizes.get(r["task"], 0) + 1
        assert len(sizes) == tasks and max(sizes.values()) == -(-1000 // tasks)
        found.append(sorted((r["member"], tuple(r["y"]), r["n_clipped"]) for r in got))
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == list(range(1000))
    a, b = (rows(experiment.stage_a(series, 40, engine="snaive", parts=p)) for p in (1, 5))
    assert a == b


def test_stage_a_shuffles_no_replicas(spark):
    """Members are built where they are forecast: series are dealt, replicas never shuffled."""
    series = made(spark, 3).cache()
    plan = experiment.forecasts(experiment.pool(series, 50, span=10), "snaive", dealt=True)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :].split("InMemoryRelation")[0]
    assert physical.count("Exchange") == 1 and physical.index("MapInPandas") < physical.rindex("MapInPandas") < physical.index("Exchange")
