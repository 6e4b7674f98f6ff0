"""Tables of series: CSV exports, and monthly or daily series of the star-schema tables.

The long form is ``uid, idx (from 1, without gaps), y``; the packed form ``uid, m, n_train, h, y_train, y_test``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ensemblecast.functions import transforms

GROUPS = ("yearly", "quarterly", "monthly", "other")
VALUES = "unique_id string, idx int, split string, y double"
META = "unique_id string, group string, m int, n_train int, h int"


def load_group(spark: SparkSession, folder: str, group: str, uids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Packed series of one group from ``<group>.csv`` files and ``meta.csv`` under ``folder``."""
    if group not in GROUPS:
        raise ValueError(f"unknown group {group!r}; one of {GROUPS}")
    paths = [f"{folder}/m3_{group}.csv", f"{folder}/meta.csv"]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for p in paths:
        at = fs_path(p)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise FileNotFoundError(f"{p} is missing; export the series first (values: {VALUES}; meta: {META})")
    values = spark.read.schema(VALUES).csv(paths[0], header=True)
    meta = spark.read.schema(META).csv(paths[1], header=True).where(F.col("group") == group)
    if uids is not None:
        meta = meta.where(F.col("unique_id").isin(uids))
    if limit is not None:
        meta = meta.orderBy("unique_id").limit(limit)
    packed = values.join(meta, "unique_id").groupBy(F.col("unique_id").alias("uid"), "m", "n_train", "h").agg(transforms.pack().alias("y"))
    return split(packed)


def split(packed: DataFrame) -> DataFrame:
    """``y`` cut into ``y_train`` and ``y_test`` at ``n_train``."""
    return packed.withColumns({"y_train": transforms.head("y", F.col("n_train")), "y_test": transforms.tail("y", F.col("n_train"))}).drop("y")


def from_long(long: DataFrame, m: int, h: int) -> DataFrame:
    """Pack a long table, the last ``h`` points as the test part."""
    packed = long.groupBy("uid").agg(transforms.pack().alias("y"), F.count("*").cast("int").alias("n"))
    return split(packed.select("uid", F.lit(m).alias("m"), (F.col("n") - h).alias("n_train"), F.lit(h).alias("h"), "y"))


def month_index(date: str):
    return ((F.year(date) - 1995) * 12 + F.month(date)).cast("int")


#: Months from January 1995 on that are complete in all of the given tables.
FIRST, LAST = 2, 79


def monthly(spark: SparkSession, sf_dir: str, first: int = FIRST, last: int = LAST) -> DataFrame:
    """Order totals, and quantities by return flag, of the months from ``first`` to ``last``."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.lit("orders").alias("uid"), month_index("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("flag_"), "l_returnflag").alias("uid"), month_index("l_shipdate").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("y"))
    both = orders.unionByName(items).where(F.col("month").between(first, last))
    return both.select("uid", (F.col("month") - first + 1).cast("int").alias("idx"), "y")


MONTHLY_SQL = f"""
select uid, cast(month - {FIRST} + 1 as integer) as idx, y from (
  select 'orders' as uid, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as month, round(sum(o_totalprice), 2) as y from orders group by all
  union all
  select 'flag_' || l_returnflag as uid, (year(l_shipdate) - 1995) * 12 + month(l_shipdate) as month, round(sum(l_quantity), 2) as y from lineitem group by all
) where month between {FIRST} and {LAST}
"""


def nation_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a month by the customer's nation; months without an order count zero."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nations = read("nation")
    counted = (
        read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("n_nationkey"), month_index("o_orderdate").alias("idx")).agg(F.count("*").alias("c"))
    )
    spine = nations.select("n_nationkey", F.col("n_name").alias("uid"), F.explode(F.sequence(F.lit(1), F.lit(LAST))).alias("idx"))
    return spine.join(counted, ["n_nationkey", "idx"], "left").select("uid", "idx", F.coalesce("c", F.lit(0)).cast("double").alias("y"))


NATIONS_SQL = f"""
select n_name as uid, cast(i as integer) as idx, cast(coalesce(c, 0) as double) as y
from nation cross join (select unnest(range(1, {LAST} + 1)) as i) s
left join (select c_nationkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) as month, count(*) as c
           from orders join customer on o_custkey = c_custkey group by all) k on c_nationkey = n_nationkey and month = i
"""


def pick_diverse(meta: DataFrame, n: int) -> DataFrame:
    """``n`` series spread evenly over the lengths: places round(linspace(0, N - 1, n)), halves to even."""
    total = meta.count()
    if n >= total:
        return meta
    from pyspark.sql import Window

    ordered = meta.withColumn("at", F.row_number().over(Window.partitionBy().orderBy("n_train", "uid")) - 1)  # metadata: a row a series
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (total - 1) / (n - 1)).cast("int"))
    return ordered.where(F.array_contains(wanted, F.col("at"))).drop("at")


def synthetic(n: int = 120, phi: float = 0.6, seed: int = 20180748, burn: int = 0):
    """A trend, two waves and first-order autoregressive noise."""
    import numpy as np

    t, rng = np.arange(n), np.random.default_rng(seed)
    noise = np.zeros(n + burn)
    for k, e in enumerate(rng.normal(0, 5, n + burn)):
        noise[k] = (phi * noise[k - 1] if k else 0.0) + e
    return 200 + 1.5 * t + 25 * np.sin(2 * np.pi * t / 12) + 10 * np.cos(2 * np.pi * t / 6) + noise[burn:]
