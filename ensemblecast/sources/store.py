"""Stores of what is computed from series: run keys, manifests, artifact tables and files."""

from __future__ import annotations

import hashlib
import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_key(**params) -> str:
    """Ten hex digits that stand for the parameters of a run."""
    return hashlib.md5(json.dumps(params, sort_keys=True).encode()).hexdigest()[:10]


class Store:
    """Keys under a prefix of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def uri(self, key: str) -> str:
        return f"{self.root}/{key.lstrip('/')}"

    def _path(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.uri(key))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, key: str) -> bool:
        """Absent and forbidden look alike; other failures are raised."""
        from py4j.protocol import Py4JJavaError

        path, fs = self._path(key)
        try:
            return bool(fs.exists(path))
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() in ("AccessControlException", "AccessDeniedException"):
                return False
            raise

    def keys(self, prefix: str = "") -> list[str]:
        path, fs = self._path(prefix)
        if not fs.exists(path):
            return []
        found, each = [], fs.listFiles(path, True)
        base = fs.makeQualified(self._path("")[0]).toString().rstrip("/") + "/"
        while each.hasNext():
            found.append(each.next().getPath().toString().removeprefix(base))
        return sorted(found)

    def put_bytes(self, key: str, body: bytes) -> None:
        """All or nothing: written beside its place, then moved there in one step that replaces what was there."""
        path, fs = self._path(key)
        draft, _ = self._path(f"{key}.part")
        out = fs.create(draft, True)
        out.write(bytearray(body))
        out.close()
        jvm = self.spark._jvm
        replace = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        kinds[0] = replace
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, kinds)

    def get_bytes(self, key: str) -> bytes:
        rows = self.spark.read.format("binaryFile").load(self.uri(key)).select("content").collect()
        return bytes(rows[0][0])

    def put_file(self, key: str, local: str) -> None:
        path, fs = self._path(key)
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(local), path)

    def get_file(self, key: str, local: str) -> None:
        path, fs = self._path(key)
        fs.copyToLocalFile(False, path, self.spark._jvm.org.apache.hadoop.fs.Path(local), True)

    def put_json(self, key: str, value: dict) -> None:
        self.put_bytes(key, json.dumps(value, sort_keys=True).encode())

    def get_json(self, key: str) -> dict:
        return json.loads(self.get_bytes(key))

    def put_arrays(self, key: str, **arrays: np.ndarray) -> None:
        rows = [(name, list(map(int, np.shape(a))), [float(v) for v in np.ravel(a)]) for name, a in arrays.items()]
        self.spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.mode("overwrite").parquet(self.uri(key))

    def get_arrays(self, key: str) -> dict[str, np.ndarray]:
        return {r[0]: np.array(r[2]).reshape(r[1]) for r in self.spark.read.parquet(self.uri(key)).collect()}


_NARROW = ("y", "val_fc", "fc", "actual", "fitted")


def narrow(artifacts: DataFrame) -> DataFrame:
    """Arrays in single precision, as they are stored."""
    return artifacts.withColumns({c: F.col(c).cast("array<float>") for c in _NARROW if c in artifacts.columns})


def widen(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("array<double>") for c in _NARROW if c in rows.columns})


def write_artifacts(artifacts: DataFrame, path: str, key: str) -> None:
    """Append a run's rows under ``run_key=...``, arrays in single precision."""
    narrow(artifacts).withColumn("run_key", F.lit(key)).write.mode("append").partitionBy("run_key").parquet(path)


def read_artifacts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A run's rows, arrays widened again."""
    return widen(spark.read.parquet(path).where(F.col("run_key") == key).drop("run_key"))


def locate(store: Store, key: str | None = None, **params) -> str:
    """The run of that key, or of those parameters; an error lists the runs that there are."""
    wanted = key or run_key(**params)
    found = sorted({part.split("=", 1)[1] for name in store.keys("artifacts") for part in name.split("/") if part.startswith("run_key=")})
    if wanted not in found:
        raise LookupError(f"no run {wanted} under {store.uri('artifacts')}; there are {', '.join(found) or 'none'}; name one of them")
    return wanted


def missing(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Series of ``wanted`` that ``done`` doesn't hold."""
    return wanted.join(done.select("uid").distinct(), "uid", "left_anti")


def require(wanted: DataFrame, done: DataFrame) -> None:
    absent = [r[0] for r in missing(wanted, done).select("uid").orderBy("uid").limit(5).collect()]
    if absent:
        raise LookupError(f"no artifacts for {', '.join(absent)} (and maybe others); compute them first")


def every_nth(frame: DataFrame, n: int, key: str = "uid") -> DataFrame:
    """``n`` rows at even steps in order of ``key``."""
    total = frame.count()
    if n >= total:
        return frame
    from pyspark.sql import Window

    wanted = F.array(*[F.lit(int(i * total / n)) for i in range(n)])
    numbered = frame.select(key).distinct().withColumn("at", F.row_number().over(Window.partitionBy().orderBy(key)) - 1)
    return frame.join(numbered.where(F.array_contains(wanted, F.col("at"))).select(key), key, "left_semi")
