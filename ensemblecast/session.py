"""Session helpers shared by every subpackage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Tables that cut lineage, by application.
_CUTS: dict[str, list[str]] = {}

#: Spark's own bound on the bytes of a batch for Python, and a lower one: batches of long texts are held several times.
_BATCH, _DEFAULT_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", "8m"


def local_session(cpus: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ensemblecast")
    defaults = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Get a session ready for Python workers.

    The package is sent to the executors once per application, so that workers import it from anywhere; Spark's
    default for the bytes of a batch is lowered (a value that was set otherwise stays).
    """
    if spark.conf.get(_BATCH).startswith(_DEFAULT_BYTES):
        spark.conf.set(_BATCH, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder that the session names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets one of its own; on a cluster that is an error, as executors share no
    local folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir isn't set, and a cluster ({sc.master}) needs a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ensemblecast-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` as a compressed table in the shared folder and read it again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    _CUTS.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete the tables that ``cut`` has written for this application so far, and tell how many there were.

    To be called once the results that need them are written; a DataFrame that still reads one of them fails afterwards.
    """
    paths = _CUTS.pop(spark.sparkContext.applicationId, [])
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
