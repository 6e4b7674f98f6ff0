"""Registered queries over the star-schema tables, with the equivalent DuckDB SQL.

Doubles are rounded where two engines may add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensemblecast.functions import aggregates, metrics, ranks, transforms
from ensemblecast.operators import bootstrap, boxcox, clustering, decompose
from ensemblecast.plans import experiment, reports
from ensemblecast.session import cut, ship
from ensemblecast.sources import series as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Months of a year, of the test part, and of blocks; members of the arithmetic bootstrap.
M, H, BLOCK, MEMBERS = 12, 18, 24, 25
#: Points of the monthly series, and of the monthly series by nation.
N, NATION_N = 78, 79


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def near(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


MONTHLY = f"with s as ({sources.MONTHLY_SQL})"
packed = lambda spark, d, h=H: sources.from_long(sources.monthly(spark, d), M, h)


@query(f"{MONTHLY} select uid, idx, y from s")
def monthly_series(spark, sf_dir):
    return sources.monthly(spark, sf_dir)


@query(f"{MONTHLY} select uid, idx, idx > {N - H} as in_test, round(sum(y) over (partition by uid, idx > {N - H}), 2) as part_total, round(lag(y) over (partition by uid, idx > {N - H} order by idx), 2) as previous from s")
def series_pack_split(spark, sf_dir):
    """Packs series into arrays, splits them, and lays the parts out again."""
    p = packed(spark, sf_dir)
    part = lambda test, y, at: F.struct(F.lit(test).alias("in_test"), F.col(y).alias("part"), at.alias("at"))
    parts = F.explode(F.array(part(False, "y_train", F.lit(0)), part(True, "y_test", F.col("n_train"))))
    rows = p.select("uid", parts.alias("p")).select("uid", "p.in_test", "p.at", "p.part", F.aggregate("p.part", F.lit(0.0), lambda a, v: a + v).alias("total"))
    return rows.select("uid", "in_test", "part", "total", "at", F.posexplode("part").alias("k", "v")).select(
        "uid", (F.col("at") + F.col("k") + 1).cast("int").alias("idx"), "in_test", F.round("total", 2).alias("part_total"),
        F.when(F.col("k") > 0, F.round(F.get("part", F.col("k") - 1), 2)).alias("previous"),
    )


@query(f"{MONTHLY}, l as (select unnest([0.0, 0.25, 0.5, 1.0]) as lam) select uid, idx, cast(lam as double) as lam, round(case when lam = 0 then ln(y) else (sign(y) * pow(abs(y), lam) - 1) / lam end, 4) as x from s cross join l")
def boxcox_fixed_lambda(spark, sf_dir):
    lam = F.explode(F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 1.0)])).alias("lam")
    rows = sources.monthly(spark, sf_dir).select("uid", "idx", "y", lam)
    return rows.select("uid", "idx", "lam", near(transforms.boxcox(F.col("y"), F.col("lam")), 4).alias("x"))


_CENTRED = "select uid, idx, y / (sum(y) over (partition by uid) / count(*) over (partition by uid)) * 4 - 6 as x from s"


@query(f"{MONTHLY}, c as ({_CENTRED}) select uid, idx, round(pow(greatest(0.5 * x + 1, 2.2250738585072014e-308), 2), 6) as y, 0.5 * x + 1 <= 0 as clipped from c")
def inv_boxcox_clip(spark, sf_dir):
    w = Window.partitionBy("uid")
    c = sources.monthly(spark, sf_dir).withColumn("x", F.col("y") / (F.sum("y").over(w) / F.count("*").over(w)) * 4 - 6)
    lam = F.lit(0.5)
    return c.select("uid", "idx", near(transforms.inv_boxcox(F.col("x"), lam)).alias("y"), transforms.is_clipped(F.col("x"), lam).alias("clipped"))


@query(f"""{MONTHLY}, b as (select uid, floor((idx - 1 - ({N} - {N // M} * {M})) / {M}) as block, avg(y) as mu, stddev_samp(y) as sd from s group by all),
g as (select i / 100.0 as lam from (select unnest(range(0, 101)) as i)),
o as (select uid, lam, stddev_samp(sd / pow(mu, 1 - lam)) / avg(sd / pow(mu, 1 - lam)) as cv from b cross join g where block >= 0 group by all)
select uid, cast(arg_min(lam, round(cv, 9)) as double) as lam, round(min(cv), 6) as cv from o group by uid""")
def guerrero_grid(spark, sf_dir):
    """The best exponent on a grid, by variation of block sd over a power of the block mean."""
    rows = sources.monthly(spark, sf_dir).withColumn("block", transforms.trailing_block(F.lit(N), F.lit(M))).where("block >= 0")
    blocks = rows.groupBy("uid", "block").agg(F.avg("y").alias("mu"), F.stddev_samp("y").alias("sd"))
    grid = blocks.withColumn("lam", F.explode(F.transform(F.sequence(F.lit(0), F.lit(100)), lambda i: i / 100.0)))
    ratio = F.col("sd") / F.pow("mu", 1 - F.col("lam"))
    cv = grid.groupBy("uid", "lam").agg((F.stddev_samp(ratio) / F.avg(ratio)).alias("cv"))
    return cv.groupBy("uid").agg(F.min_by("lam", F.struct(F.round("cv", 9), "lam")).alias("lam"), near(F.min("cv")).alias("cv"))


@query(f"""{MONTHLY}, d as (select uid, idx, y - avg(y) over (partition by uid order by idx rows between {M - 1} preceding and current row) as dev from s)
select uid, idx, round(avg(dev) over (partition by uid, (idx - 1) % {M}), 4) as seasonal from d""")
def cycle_means(spark, sf_dir):
    """Mean deviation from the trailing mean, by position in the cycle."""
    trailing = F.avg("y").over(Window.partitionBy("uid").orderBy("idx").rowsBetween(-(M - 1), 0))
    dev = sources.monthly(spark, sf_dir).withColumn("dev", F.col("y") - trailing)
    return dev.select("uid", "idx", near(transforms.cycle_mean("dev", F.lit(M)), 4).alias("seasonal"))


_TRAIN = N - H


def _replicas(spark, sf_dir) -> DataFrame:
    """Member rows of a block bootstrap whose random places are arithmetic, so that SQL has them too."""
    p = packed(spark, sf_dir).select("uid", "y_train", "y_test", F.explode(F.sequence(F.lit(0), F.lit(MEMBERS - 1))).alias("member"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(_TRAIN // BLOCK + 1)), lambda i: F.pmod(i * 7919 + F.col("member") * 104729, F.lit(_TRAIN - BLOCK + 1)).cast("int"))
    return p.withColumn("y", F.when(F.col("member") == 0, F.col("y_train")).otherwise(transforms.block_replica("y_train", starts, F.pmod(F.col("member") * 31, F.lit(BLOCK)).cast("int"), BLOCK)))


_REPLICAS = f"""{MONTHLY}, mem as (select unnest(range(0, {MEMBERS})) as member), pos as (select unnest(range(1, {_TRAIN + 1})) as k),
places as (select member, k, case when member = 0 then k else ((((k - 1 + member * 31 % {BLOCK}) // {BLOCK}) * 7919 + member * 104729) % {_TRAIN - BLOCK + 1}) + ((k - 1 + member * 31 % {BLOCK}) % {BLOCK}) + 1 end as src from mem cross join pos),
rep as (select uid, member, cast(k as integer) as idx, y from places join s on src = s.idx)"""


@query(f"{_REPLICAS} select uid, cast(member as integer) as member, idx, y from rep")
def block_replicas(spark, sf_dir):
    return _replicas(spark, sf_dir).select("uid", "member", F.posexplode("y").alias("k", "y")).select("uid", "member", (F.col("k") + 1).cast("int").alias("idx"), "y")


@query(f"""{MONTHLY}, w as (select uid, idx, avg(abs(y)) over (partition by uid order by idx rows between 35 preceding and current row) as level, count(*) over (partition by uid order by idx rows between 35 preceding and current row) as n,
 lead(y, 1) over (partition by uid order by idx) as t1, lead(y, 12) over (partition by uid order by idx) as t12 from s)
select uid, idx - 35 as first_idx, round(level, 4) as scale, round(t1 / level, 6) as target_first, round(t12 / level, 6) as target_last from w where n = 36 and t12 is not null""")
def sliding_windows(spark, sf_dir):
    """Lookback and target windows with their scale."""
    lookback, horizon = F.lit(36), F.lit(12)
    full = packed(spark, sf_dir, 0).select("uid", F.posexplode(transforms.windows("y_train", lookback, horizon)).alias("at", "w"))
    s = full.withColumn("scale", transforms.scale(F.col("w.x")))
    return s.select(
        "uid", (F.col("at") + 1).cast("int").alias("first_idx"), near(F.col("scale"), 4).alias("scale"),
        near(F.col("w.target")[0] / F.col("scale")).alias("target_first"), near(F.col("w.target")[11] / F.col("scale")).alias("target_last"),
    )


@query(f"{MONTHLY} select a.uid, a.idx - {_TRAIN} as step, b.y as forecast, a.y as actual from s a join s b on a.uid = b.uid and b.idx = {_TRAIN} - {M} + 1 + (a.idx - {_TRAIN} - 1) % {M} where a.idx > {_TRAIN}")
def seasonal_naive_forecast(spark, sf_dir):
    p = packed(spark, sf_dir).select("uid", "y_train", F.posexplode("y_test").alias("k", "actual"))
    return p.select("uid", (F.col("k") + 1).cast("int").alias("step"), F.get("y_train", F.col("k") % M + (_TRAIN - M)).alias("forecast"), "actual")


_SNAIVE = f"f as ({SQL['seasonal_naive_forecast'].removeprefix(MONTHLY)})"


@query(f"""{MONTHLY}, {_SNAIVE}, d as (select uid, avg(abs(y - p)) as scale from (select uid, idx, y, lag(y, {M}) over (partition by uid order by idx) as p from s where idx <= {_TRAIN}) group by uid)
select f.uid, round(avg(200 * abs(actual - forecast) / (abs(actual) + abs(forecast))), 6) as smape, round(avg(100 * abs((actual - forecast) / actual)), 6) as mape,
 round(avg(abs(actual - forecast)) / any_value(scale), 6) as mase, round(sqrt(avg((actual - forecast) * (actual - forecast))) / any_value(scale), 6) as scaled_rms from f join d on f.uid = d.uid group by f.uid""")
def smape_mape_mase(spark, sf_dir):
    f = seasonal_naive_forecast(spark, sf_dir)
    train = sources.monthly(spark, sf_dir).where(F.col("idx") <= _TRAIN).withColumn("d", metrics.seasonal_step("y", M))
    scale = train.groupBy("uid").agg(F.avg("d").alias("scale"))
    y, g = F.col("actual"), F.col("forecast")
    both = f.join(F.broadcast(scale), "uid")  # a row a series of this small family
    return both.groupBy("uid").agg(
        near(metrics.smape(y, g)).alias("smape"), near(metrics.mape(y, g)).alias("mape"), near(metrics.mae(y, g) / F.first("scale")).alias("mase"),
        near(metrics.rms(y, g) / F.first("scale")).alias("scaled_rms"),
    )


def _ensemble(spark, sf_dir) -> DataFrame:
    """Seasonal naive forecasts of all replicas: uid, member, step, value, actual."""
    rows = _replicas(spark, sf_dir).select("uid", "member", "y", F.posexplode("y_test").alias("k", "actual"))
    return rows.select("uid", "member", (F.col("k") + 1).cast("int").alias("step"), F.get("y", F.col("k") % M + (_TRAIN - M)).alias("value"), "actual")


_ENSEMBLE = f"""{_REPLICAS}, ens as (select r.uid, cast(r.member as integer) as member, a.idx - {_TRAIN} as step, r.y as value, a.y as actual
 from s a join rep r on a.uid = r.uid and r.idx = {_TRAIN} - {M} + 1 + (a.idx - {_TRAIN} - 1) % {M} where a.idx > {_TRAIN})"""


@query(f"""{_ENSEMBLE}, t as (select *, row_number() over (partition by uid, step order by value) as rn, count(*) over (partition by uid, step) as n from ens),
tm as (select uid, step, avg(value) as trimmed from t where rn > floor(0.1 * n) and rn <= n - floor(0.1 * n) group by all),
q as (select uid, step, median(value) as med, avg(value) as mean, min(value) as lo, max(value) as hi, quantile_cont(value, 0.1) as q10, quantile_cont(value, 0.9) as q90 from ens group by all)
select q.uid, q.step, round(med, 4) as median, round(mean, 4) as mean, round(trimmed, 4) as trimmed, lo as least, hi as most, round(q10, 4) as q_10, round(q90, 4) as q_90 from q join tm on q.uid = tm.uid and q.step = tm.step""")
def ensemble_aggregates(spark, sf_dir):
    e, by = _ensemble(spark, sf_dir), ["uid", "step"]
    plain = e.groupBy(*by).agg(F.median("value").alias("median"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))
    out = plain.join(aggregates.trimmed_mean(e, by).withColumnRenamed("value", "trimmed"), by).join(aggregates.quantiles(e, by, [0.1, 0.9]), by)
    return out.select(*by, *(near(F.col(c), 4).alias(c) for c in ("median", "mean", "trimmed")), "least", "most", *(near(F.col(c), 4).alias(c) for c in ("q_10", "q_90")))


def _errors(spark, sf_dir) -> DataFrame:
    return _ensemble(spark, sf_dir).groupBy("uid", "member").agg(near(metrics.smape(F.col("actual"), F.col("value")), 9).alias("err"))


_ERRORS = f"{_ENSEMBLE}, err as (select uid, member, round(avg(200 * abs(actual - value) / (abs(actual) + abs(value))), 9) as err from ens group by all)"


@query(f"""{_ERRORS}, r as (select *, row_number() over (partition by uid order by err, member) as rn, row_number() over (partition by uid order by (member * 7919 + 13) % 1009, member) as dice from err)
select uid, 'topk' as strategy, member from r where rn <= 8 union all select uid, 'first8', member from r where member < 8 union all select uid, 'random', member from r where dice <= 8""")
def select_members(spark, sf_dir):
    """Best, first and arithmetically random members."""
    e = _errors(spark, sf_dir)
    dice = F.row_number().over(Window.partitionBy("uid").orderBy((F.col("member") * 7919 + 13) % 1009, "member"))
    r = e.withColumns({"topk": ranks.ordinal_rank("err", "member", "uid") <= 8, "first8": F.col("member") < 8, "random": dice <= 8})
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(s), F.lit(s)) for s in ("topk", "first8", "random")])))
    return r.select("uid", named.alias("strategy"), "member")


@query(f"""{_ERRORS}, r as (select *, row_number() over (partition by uid order by err, member) as rn from err), k as (select uid, member from r where rn <= 8)
select e.uid, step, round(avg(value), 6) as point, round(max(abs(value - actual)), 4) as worst from ens e join k on e.uid = k.uid and e.member = k.member group by all""")
def selected_ensemble(spark, sf_dir):
    """Forecast of the best members: a semi-join, then the aggregate."""
    best = _errors(spark, sf_dir).withColumn("rn", ranks.ordinal_rank("err", "member", "uid")).where("rn <= 8").select("uid", "member")
    kept = _ensemble(spark, sf_dir).join(best, ["uid", "member"], "left_semi")
    return kept.groupBy("uid", "step").agg(near(F.avg("value")).alias("point"), near(F.max(F.abs(F.col("value") - F.col("actual"))), 4).alias("worst"))


@query("""with c as (select label, count(*) as size from embeddings group by label), q as (select label, size, sum(size) over () as pool from c),
b as (select *, size / pool * 100 as share, floor(size / pool * 100) as low from q),
r as (select *, row_number() over (order by share - low desc, label) as rn, 100 - sum(low) over () as spare from b)
select label, size, cast(greatest(1, round_even(share, 0)) as integer) as rounded, cast(least(size, greatest(1, low + case when rn <= spare then 1 else 0 end)) as integer) as largest_remainder from r""")
def allocations(spark, sf_dir):
    """Shares of 100 by cluster size: rounded half to even, and by largest remainders."""
    c = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.count("*").alias("size"))
    one = Window.partitionBy()  # a row a cluster
    b = c.withColumn("share", F.col("size") / F.sum("size").over(one) * 100).withColumn("low", F.floor("share"))
    r = b.withColumns({"rn": F.row_number().over(one.orderBy(F.desc(F.col("share") - F.col("low")), "label")), "spare": 100 - F.sum("low").over(one)})
    return r.select(
        "label", "size", F.greatest(F.lit(1), F.bround("share")).cast("int").alias("rounded"),
        F.least("size", F.greatest(F.lit(1), F.col("low") + (F.col("rn") <= F.col("spare")).cast("int"))).cast("int").alias("largest_remainder"),
    )


@query("""with e as (select vec_id, label, round(list_inner_product(cast(embedding as double[]), cast(embedding as double[])), 6) as err from embeddings),
r as (select *, row_number() over (partition by label order by err, vec_id) as rn from e) select label, vec_id, err, cast(rn as integer) as rn from r where rn <= 5""")
def best_within_cluster(spark, sf_dir):
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", near(norm).alias("err"))
    return e.withColumn("rn", ranks.ordinal_rank("err", "vec_id", "label")).where("rn <= 5").select("label", "vec_id", "err", "rn")


_L2 = "list_distance(cast(a.embedding as double[]), cast(b.embedding as double[]))"


#: Members of a cluster's pool, as the method has it.
POOL = 300


def _pairs(spark, sf_dir) -> DataFrame:
    """Distances between the ``POOL`` vectors of a label with the least error (here their length)."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"), near(norm).alias("err"))
    v = v.withColumn("rn", ranks.ordinal_rank("err", "vec_id", "label")).where(F.col("rn") <= POOL)
    a, b = v.select("label", F.col("vec_id").alias("i"), F.col("v").alias("a")), v.select("label", F.col("vec_id").alias("j"), F.col("v").alias("b"))
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, "label").where("i < j").select("label", "i", "j", F.sqrt(gap).alias("d"))


@query(f"""with e as (select *, row_number() over (partition by label order by round(list_inner_product(cast(embedding as double[]), cast(embedding as double[])), 6), vec_id) as rn from embeddings), p as (select * from e where rn <= {POOL})
select a.label, a.vec_id as i, b.vec_id as j, round({_L2}, 5) as d from p a join p b on a.label = b.label and a.vec_id < b.vec_id""")
def pairwise_l2(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("label", "i", "j", near(F.col("d"), 5).alias("d"))


def _widths(means: DataFrame) -> DataFrame:
    """Count and average width by label, from the mean distances of each point to each cluster."""
    inside, outside = F.max(F.when(F.col("own") == F.col("other"), F.col("mean"))), F.min(F.when(F.col("own") != F.col("other"), F.col("mean")))
    w = means.groupBy("i").agg(F.first("own").alias("label"), inside.alias("a"), outside.alias("b"))
    width = F.when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return w.groupBy("label").agg(F.count("*").alias("n"), near(F.avg(width), 5).alias("width"))


#: Vectors of a block (about, as they are dealt by hash); a task holds two.
_VECTORS = 4096


@query(f"""with e as (select * from embeddings), d as (select a.vec_id as i, a.label as own, b.label as other, {_L2} as d from e a join e b on a.vec_id <> b.vec_id),
m as (select i, own, other, avg(d) as mean from d group by all),
w as (select i, any_value(own) as label, max(case when own = other then mean end) as a, min(case when own <> other then mean end) as b from m group by i)
select label, count(*) as n, round(avg(case when a is null then 0 else (b - a) / greatest(a, b) end), 5) as width from w group by label""")
def silhouette_given_labels(spark, sf_dir):
    """Silhouette by label of the whole table: sums of distances by point and cluster, a pair of blocks at a time."""
    ship(spark)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").alias("v"))
    blocks = max(1, -(-v.count() // _VECTORS))
    v = v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = v.select("vec_id", "label", "v", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))

    def sums(key, frame):
        import numpy as np
        import pandas as pd

        sides = [frame[frame["block"] == k] for k in key]
        points = [np.array(side["v"].tolist(), float) for side in sides]
        out = []
        for one, two in ((0, 1), (1, 0)) if key[0] != key[1] else ((0, 1),):
            if not len(points[0]) or not len(points[1]):
                continue
            names, cluster = np.unique(sides[two]["label"], return_inverse=True)
            member = np.eye(len(names))[cluster]
            n = np.tile(member.sum(axis=0), (len(points[one]), 1))
            same = np.arange(len(n)) if key[0] == key[1] else np.full(len(n), -1)
            if key[0] == key[1]:
                n -= member
            total = clustering.distance_sums(points[one], points[two], member, same)
            i, k = np.nonzero(n)
            out.append(pd.DataFrame({"i": sides[one]["vec_id"].to_numpy()[i], "own": sides[one]["label"].to_numpy()[i], "other": names[k], "total": total[i, k], "n": n[i, k].astype(int)}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("i", "own", "other", "total", "n")})

    parts = dealt.groupBy("first", "second").applyInPandas(sums, "i long, own int, other int, total double, n long")
    return _widths(parts.groupBy("i", "own", "other").agg((F.sum("total") / F.sum("n")).alias("mean")))


_NT = 67


def _scores(spark, sf_dir) -> DataFrame:
    """Scores of four benchmark learners on the last 12 months of every nation's orders."""
    p = sources.nation_months(spark, sf_dir).groupBy("uid").agg(transforms.pack().alias("y"))
    s = sources.split(p.withColumn("n_train", F.lit(_NT)))
    mean = metrics.array_mean(F.col("y_train"))
    year = metrics.array_mean(F.slice("y_train", _NT - M + 1, M))
    points = {"naive": F.array_repeat(F.element_at("y_train", -1), M), "seasonal": F.slice("y_train", _NT - M + 1, M), "mean": F.array_repeat(mean, M), "year": F.array_repeat(year, M)}
    made = F.array(*[F.struct(F.lit(k).alias("strategy"), v.alias("f")) for k, v in points.items()])
    rows = s.select("uid", "y_train", "y_test", F.explode(made).alias("p")).select("uid", "y_train", "y_test", "p.strategy", "p.f")
    smape = metrics.array_mean(F.zip_with("y_test", "f", lambda y, f: F.when(y + f > 0, 200 * F.abs(y - f) / F.greatest(y + f, F.lit(1e-9))).otherwise(0.0)))
    return rows.select("uid", "strategy", near(smape).alias("smape"), near(metrics.array_mase("y_test", "f", "y_train", F.lit(M))).alias("mase"))


_SCORES = f"""with s as ({sources.NATIONS_SQL}), tr as (select uid, arg_max(y, idx) as last, avg(y) as mean, avg(y) filter (where idx > {_NT - M}) as year from s where idx <= {_NT} group by uid),
fc as (select a.uid, a.idx, a.y, st.strategy, case st.strategy when 'naive' then last when 'mean' then mean when 'year' then year else b.y end as f
 from s a join tr on a.uid = tr.uid join s b on a.uid = b.uid and b.idx = a.idx - {M} cross join (select unnest(['naive', 'seasonal', 'mean', 'year']) as strategy) st where a.idx > {_NT}),
sc as (select uid, avg(abs(y - p)) as scale from (select uid, idx, y, lag(y, {M}) over (partition by uid order by idx) as p from s where idx <= {_NT}) group by uid),
scores as (select fc.uid, strategy, round(avg(case when y + f > 0 then 200 * abs(y - f) / (y + f) else 0 end), 6) as smape, round(avg(abs(y - f)) / any_value(scale), 6) as mase from fc join sc on fc.uid = sc.uid group by fc.uid, strategy)"""


@query(f"{_SCORES} select * from scores")
def strategy_scores(spark, sf_dir):
    return _scores(spark, sf_dir)


_RANKED = ", rk as (select *, rank() over (partition by uid order by smape) + (count(*) over (partition by uid, smape) - 1) / 2.0 as rs, rank() over (partition by uid order by mase) + (count(*) over (partition by uid, mase) - 1) / 2.0 as rm from scores)"


@query(f"{_SCORES}{_RANKED} select strategy, round(avg(rs), 6) as rank_smape, round(avg(smape), 6) as mean_smape, round(median(smape), 6) as median_smape, round(avg(rm), 6) as rank_mase, round(avg(mase), 6) as mean_mase, round(median(mase), 6) as median_mase from rk group by strategy")
def average_rank_summary(spark, sf_dir):
    s = ranks.summary(_scores(spark, sf_dir))
    return s.select("strategy", *(near(F.col(c)).alias(c) for c in s.columns if c != "strategy"))


@query(f"""{_SCORES}{_RANKED}, t as (select sum(c * c * c - c) as ties from (select count(*) as c from rk group by uid, smape)), r as (select strategy, sum(rs) as total, count(*) as n from rk group by strategy),
p as (select max(n) as n, count(*) as k, sum(total * total) as sq from r)
select n, k, round((12.0 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) as statistic from p cross join t""")
def friedman_statistic(spark, sf_dir):
    return ranks.friedman_parts(_scores(spark, sf_dir), "smape").select("n", "k", near(F.col("statistic")).alias("statistic"))


@query(f"""{_SCORES}{_RANKED}, r as (select strategy, avg(rs) as mean_rank, count(*) as n from rk group by strategy)
select strategy, round(mean_rank, 6) as mean_rank, round((mean_rank - min(mean_rank) over ()) / sqrt(count(*) over () * (count(*) over () + 1) / (6.0 * n)), 6) as z from r""")
def rank_z(spark, sf_dir):
    z = ranks.rank_z(_scores(spark, sf_dir), "smape")
    return z.select("strategy", near(F.col("mean_rank")).alias("mean_rank"), near(F.col("z")).alias("z"))


@query("""with p as (select n_name as name, (n_nationkey * 37 % 101 + 1) / 2000.0 as p_raw from nation), o as (select *, row_number() over (order by p_raw desc) as k from p)
select name, round(p_raw, 6) as p_raw, round(least(1.0, min(p_raw * k) over (order by p_raw desc rows between unbounded preceding and current row)), 6) as p_hochberg from o""")
def hochberg_adjust(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") * 37 % 101 + 1) / 2000.0).alias("p_raw"))
    return ranks.adjust(p).select("name", near(F.col("p_raw")).alias("p_raw"), near(F.col("p_hochberg")).alias("p_hochberg"))


_WIDE = ", w as (select uid, max(smape) filter (where strategy = 'naive') as a, max(smape) filter (where strategy = 'seasonal') as b, max(smape) filter (where strategy = 'year') as c from scores group by uid)"


def _wide(spark, sf_dir) -> DataFrame:
    wide = _scores(spark, sf_dir).groupBy("uid").pivot("strategy", ["naive", "seasonal", "year"]).agg(F.max("smape"))
    return wide.select("uid", F.col("naive").alias("a"), F.col("seasonal").alias("b"), F.col("year").alias("c"))


@query(f"""{_SCORES}{_WIDE}, d as (select round(a - b, 9) as d from w where a <> b), r as (select d, rank() over (order by abs(d)) + (count(*) over (partition by abs(d)) - 1) / 2.0 as r from d)
select count(*) as n, round(coalesce(sum(r) filter (where d > 0), 0), 2) as w_plus, round(coalesce(sum(r) filter (where d < 0), 0), 2) as w_minus, round(least(coalesce(sum(r) filter (where d > 0), 0), coalesce(sum(r) filter (where d < 0), 0)), 2) as w from r""")
def wilcoxon_w(spark, sf_dir):
    w = _wide(spark, sf_dir).select(F.round(F.col("a") - F.col("b"), 9).alias("a"), F.lit(0.0).alias("b"))
    p = ranks.wilcoxon_parts(w, "a", "b")
    return p.select("n", *(F.round(c, 2).alias(c) for c in ("w_plus", "w_minus", "w")))


@query(f"""{_SCORES}{_WIDE}, r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb from w)
select round(corr(ra, rb), 6) as rho, count(*) as n from r""")
def spearman_rho(spark, sf_dir):
    return ranks.spearman(_wide(spark, sf_dir), "a", "b").select(near(F.col("rho")).alias("rho"), "n")


@query(f"{_SCORES}{_WIDE} select count(*) as n, round(avg(case when b < a then 1.0 else 0.0 end), 6) as win_rate, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b from w")
def win_rate(spark, sf_dir):
    w = experiment.win_rate(_scores(spark, sf_dir), "naive", "seasonal")
    return w.select("n", *(near(F.col(c)).alias(c) for c in ("win_rate", "mean_a", "mean_b")))


@query(f"""{_SCORES}{_WIDE}, r as (select uid, a, b, c, row_number() over (order by a, uid) as r, count(*) over () as n from w)
select cast(greatest(1, ceil((r - 1) * 4 / (n - 1))) as integer) as q, count(*) as n, round(avg(a), 6) as a, round(avg(b), 6) as b, round(avg(c), 6) as c from r group by 1""")
def quartile_table(spark, sf_dir):
    q = experiment.quartiles(_wide(spark, sf_dir), "a", ["b", "c"])
    return q.select("q", "n", *(near(F.col(c)).alias(c) for c in "abc"))


@query(f"""{_SCORES}, g as (select uid, strategy, smape, row_number() over (partition by strategy order by uid) % 2 as half from scores)
select strategy, round(avg(smape) filter (where half = 0), 6) as even, round(avg(smape) filter (where half = 1), 6) as odd, round(avg(smape) filter (where half = 0) - avg(smape) filter (where half = 1), 6) as gap, round(stddev_samp(smape), 6) as sd from g group by strategy""")
def arm_pivot(spark, sf_dir):
    """Arms side by side, their difference and spread, as in the ablation."""
    g = _scores(spark, sf_dir).withColumn("arm", F.when(F.row_number().over(Window.partitionBy("strategy").orderBy("uid")) % 2 == 0, "even").otherwise("odd"))
    wide = g.groupBy("strategy").pivot("arm", ["even", "odd"]).agg(F.avg("smape"))
    sd = g.groupBy("strategy").agg(F.stddev_samp("smape").alias("sd"))
    return wide.join(sd, "strategy").select("strategy", near(F.col("even")).alias("even"), near(F.col("odd")).alias("odd"), near(F.col("even") - F.col("odd")).alias("gap"), near(F.col("sd")).alias("sd"))


_FAMILIES = """with f as (select s_nationkey as uid, s_suppkey as family, round(100 + abs(s_acctbal) / 500, 4) as aicc, s_acctbal as value from supplier)"""


def _families(spark, sf_dir) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.select(F.col("s_nationkey").alias("uid"), F.col("s_suppkey").alias("family"), F.round(100 + F.abs("s_acctbal") / 500, 4).alias("aicc"), F.col("s_acctbal").alias("value"))


@query(f"""{_FAMILIES}, w as (select *, exp(-0.5 * (aicc - min(aicc) over (partition by uid))) as raw from f), p as (select *, raw / sum(raw) over (partition by uid) as weight from w)
select uid, count(*) as n_families, round(max(weight), 6) as w_best, round(-sum(case when weight > 0 then weight * ln(weight) else 0 end), 6) + 0.0 as aicc_entropy, round(sum(weight * value), 4) as weighted from p group by uid""")
def aicc_weights(spark, sf_dir):
    p = aggregates.with_weights(_families(spark, sf_dir), ["uid"])
    return p.groupBy("uid").agg(F.count("*").alias("n_families"), near(F.max("weight")).alias("w_best"), (near(aggregates.entropy("weight")) + 0.0).alias("aicc_entropy"), near(F.sum(F.col("weight") * F.col("value")), 4).alias("weighted"))


@query(f"""{_FAMILIES}, t as (select uid, row_number() over (partition by uid order by aicc, family) as j, avg(value) over (partition by uid order by aicc, family rows between unbounded preceding and current row) as top from f)
select uid, cast(j as integer) as j, round(top, 4) as top from t where j <= 15""")
def top_prefix_means(spark, sf_dir):
    """Means over the best 1, 2, ... forms in one pass."""
    ordered = _families(spark, sf_dir).withColumn("o", F.struct("aicc", "family"))
    return aggregates.prefix_means(ordered, ["uid"], "o").where("j <= 15").select("uid", "j", near(F.col("top"), 4).alias("top"))


@query("""with c as (select user_id as uid, event_type as method, count(*) as c from events group by all), p as (select *, c / sum(c) over (partition by uid) as p from c)
select uid, cast(sum(c) as bigint) as n_members_refit, count(*) as n_families, round(-sum(p * ln(p)), 6) + 0.0 as family_entropy, round(max(p), 6) as modal_share, arg_max(method, (c, method)) as modal_family, round(exp(-sum(p * ln(p))), 6) as n_eff_families from p group by uid""")
def family_entropy(spark, sf_dir):
    """How mixed the methods of a group are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("uid"), F.col("event_type").alias("method"))
    f = experiment.family_entropy(e)
    return f.select("uid", "n_members_refit", "n_families", (near(F.col("family_entropy")) + 0.0).alias("family_entropy"), near(F.col("modal_share")).alias("modal_share"), "modal_family", near(F.col("n_eff_families")).alias("n_eff_families"))


@query(f"""{_ENSEMBLE}, m as (select uid, member, step, value from ens)
select a.uid, a.member as i, b.member as j, round(sqrt(avg((a.value - b.value) * (a.value - b.value))), 4) as rms from m a join m b on a.uid = b.uid and a.step = b.step and a.member < b.member group by all""")
def pair_rms(spark, sf_dir):
    """Differences between all pairs of members of a series."""
    return _pair_rms(_ensemble(spark, sf_dir))


def _pair_rms(m: DataFrame) -> DataFrame:
    a, b = m.select("uid", "step", F.col("member").alias("i"), F.col("value").alias("a")), m.select("uid", "step", F.col("member").alias("j"), F.col("value").alias("b"))
    return a.join(b, ["uid", "step"]).where("i < j").groupBy("uid", "i", "j").agg(near(metrics.rms(F.col("a"), F.col("b")), 4).alias("rms"))


@query("select c_custkey as uid from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderpriority = '1-URGENT')")
def unfinished_series(spark, sf_dir):
    """Wanted series without a finished artifact: an anti-join."""
    from ensemblecast.sources.store import missing

    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uid"))
    done = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("uid"))
    return missing(wanted, done)


# What SQL can't express: kernels, compared with published values in tests/.


@query()
def stl_components(spark, sf_dir):
    ship(spark)

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for uid, m, y in zip(frame["uid"], frame["m"], frame["y_train"]):
                trend, seasonal, rest = decompose.decompose(np.log(np.asarray(y)), int(m))
                yield pd.DataFrame({"uid": uid, "idx": range(1, len(y) + 1), "trend": trend, "seasonal": seasonal, "remainder": rest})

    return packed(spark, sf_dir).select("uid", "m", "y_train").mapInPandas(run, "uid string, idx int, trend double, seasonal double, remainder double")


@query()
def lowess_trend(spark, sf_dir):
    ship(spark)

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for uid, y in zip(frame["uid"], frame["y_train"]):
                yield pd.DataFrame({"uid": uid, "idx": range(1, len(y) + 1), "trend": decompose.decompose(np.asarray(y), 1)[0]})

    return packed(spark, sf_dir).select("uid", "y_train").mapInPandas(run, "uid string, idx int, trend double")


@query()
def guerrero_exponent(spark, sf_dir):
    ship(spark)

    def run(frames):
        import numpy as np

        for frame in frames:
            yield frame[["uid"]].assign(lam=[boxcox.guerrero_lambda(np.asarray(y), M) for y in frame["y_train"]])

    return packed(spark, sf_dir).select("uid", "y_train").mapInPandas(run, "uid string, lam double")


@query()
def bootstrap_members(spark, sf_dir):
    return experiment.pool(packed(spark, sf_dir), MEMBERS).select("uid", "member", "lam", "n_clipped", F.aggregate("y", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query()
def ets_forecast(spark, sf_dir):
    s = packed(spark, sf_dir).select("uid", "m", "h", F.lit(0).alias("h_val"), F.lit(0).alias("member"), F.col("y_train").alias("y"))
    out = experiment.forecasts(s, "ets", validate=False)
    return out.select("uid", "method", "fallback", F.posexplode("fc").alias("step", "value"))


@query()
def family_averaging(spark, sf_dir):
    s = packed(spark, sf_dir)
    return experiment.family_scores(cut(experiment.family_table(s)), s).select("uid", "strategy", "smape", "mase", "n_members")


@query()
def pam_labels(spark, sf_dir):
    """Members of each series' pool by cluster."""
    ship(spark)

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            for uid, y in zip(frame["uid"], frame["y_train"]):
                members = bootstrap.bootstrap_pool(np.asarray(y), 60, M, bootstrap.series_rng(1, uid)).series
                k, labels = clustering.best_k(clustering.distances(members), 2, 10)
                yield pd.DataFrame({"uid": uid, "member": range(len(labels)), "k": k, "label": labels})

    return packed(spark, sf_dir).select("uid", "y_train").mapInPandas(run, "uid string, member int, k int, label int")


def _selected(spark, sf_dir, strategies: list[str]) -> DataFrame:
    s = packed(spark, sf_dir)
    artifacts = cut(experiment.stage_a(s, MEMBERS, engine="snaive"))
    return experiment.stage_b(artifacts, s, strategies, 8).select("uid", "strategy", "smape", "mase", "n_members")


@query()
def greedy_selection(spark, sf_dir):
    return _selected(spark, sf_dir, ["greedy", "greedy:trimmed", "greedy:mean"])


@query()
def portfolio_selection(spark, sf_dir):
    return _selected(spark, sf_dir, ["portfolio", "portfolio:mean"])


@query()
def strategy_sweep(spark, sf_dir):
    """Every strategy over one stage A."""
    return _selected(spark, sf_dir, ["original", "none", "none10:trimmed", "topk", "random", "greedy", "portfolio", "cluster-k3", "cluster-auto", "paper-k3"])


@query()
def bagged_pipeline(spark, sf_dir):
    """Bootstrap, validate and fit smoothing models, select by cluster, combine, score."""
    s = packed(spark, sf_dir)
    artifacts = cut(experiment.stage_a(s, MEMBERS, engine="ets"))
    return experiment.stage_b(artifacts, s, ["original", "none:trimmed", "topk", "cluster-k3"], 10).select("uid", "strategy", "smape", "mase", "n_members", "k_chosen")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagged_pipeline(spark, sf_dir)


# Comparisons and choices of series.


@query(f"""{_SCORES}, e as (select uid, strategy as engine, smape, mase from scores), k as (select uid from e group by uid having count(distinct engine) = (select count(distinct engine) from e))
select engine, round(avg(smape), 6) as mean_smape, round(median(smape), 6) as median_smape, round(avg(mase), 6) as mean_mase, round(median(mase), 6) as median_mase from e where uid in (select uid from k) group by engine""")
def engine_summary(spark, sf_dir):
    """All engines compared on the series that all of them have."""
    return _engines(_scores(spark, sf_dir))


def _engines(scores: DataFrame) -> DataFrame:
    s = reports.engine_summary(scores.withColumnRenamed("strategy", "engine"))
    return s.select("engine", *(near(F.col(c)).alias(c) for c in s.columns if c != "engine"))


@query(f"{_SCORES} select count(*) as n, round(avg(smape), 6) as mean_smape, round(median(smape), 6) as median_smape, round(avg(mase), 6) as mean_mase, round(avg(smape) - 14.135, 6) as delta, abs(avg(smape) - 14.135) <= 0.5 as passed from scores where strategy = 'seasonal'")
def calibration_gate(spark, sf_dir):
    c = reports.calibration(_scores(spark, sf_dir).where("strategy = 'seasonal'"), 14.135, 0.5)
    return c.select("n", *(near(F.col(k)).alias(k) for k in ("mean_smape", "median_smape", "mean_mase", "delta")), "passed")


@query("""with m as (select c_custkey as uid, cast(c_nationkey as bigint) as n_train from customer), o as (select uid, n_train, row_number() over (order by n_train, uid) - 1 as pos, count(*) over () as total from m)
select uid, n_train from o where pos in (select cast(round_even(i * (total - 1) / 6.0, 0) as bigint) from (select unnest(range(0, 7)) as i) s)""")
def pick_diverse(spark, sf_dir):
    """Seven series spread over the lengths."""
    m = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uid"), F.col("c_nationkey").cast("long").alias("n_train"))
    return sources.pick_diverse(m, 7).select("uid", "n_train")


@query("with o as (select c_custkey as uid, row_number() over (order by c_custkey) - 1 as pos, count(*) over () as total from customer) select uid from o where pos in (select cast(floor(i * total / 9.0) as bigint) from (select unnest(range(0, 9)) as i) s)")
def systematic_sample(spark, sf_dir):
    """Nine series at even steps."""
    from ensemblecast.sources.store import every_nth

    return every_nth(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("uid")), 9)


@query("select distinct o_custkey as uid from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O' intersect select c_custkey from customer where c_acctbal > 0")
def matched_arms(spark, sf_dir):
    """Series that every arm has."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    arm = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("uid"))
    rich = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("uid"))
    return arm("F").intersect(arm("O")).intersect(rich)


@query(f"""{MONTHLY}, d as (select uid, idx, y, lag(y, {M}) over (partition by uid order by idx) as p, lag(y) over (partition by uid order by idx) as q from s)
select a.uid, round(avg(abs(a.q - a.p)) / avg(abs(a.y - a.p)), 6) as scaled_distance from d a where p is not null group by a.uid""")
def scaled_distance(spark, sf_dir):
    """Mean distance of two forecasts (last value, last season) in units of the mean seasonal step."""
    w = Window.partitionBy("uid").orderBy("idx")
    d = sources.monthly(spark, sf_dir).withColumns({"p": F.lag("y", M).over(w), "q": F.lag("y").over(w)}).where("p is not null")
    return d.groupBy("uid").agg(near(F.avg(F.abs(F.col("q") - F.col("p"))) / F.avg(F.abs(F.col("y") - F.col("p")))).alias("scaled_distance"))


@query(f"{_ENSEMBLE} select uid, step, round(avg(value), 4) as mean, median(value) as median, min(value) as low, max(value) as high, round(avg(value) - any_value(actual), 4) as error from ens group by all")
def published_forecast_table(spark, sf_dir):
    """Mean, median and range of the members, as the method's first publication reports them."""
    return _ensemble(spark, sf_dir).groupBy("uid", "step").agg(
        near(F.avg("value"), 4).alias("mean"), F.median("value").alias("median"), F.min("value").alias("low"), F.max("value").alias("high"), near(F.avg("value") - F.first("actual"), 4).alias("error")
    )


@query()
def member0_ablation(spark, sf_dir):
    """What the original series adds to an ensemble, by size and aggregator."""
    s = packed(spark, sf_dir)
    return experiment.ablation_pivot(experiment.ablation(cut(experiment.stage_a(s, MEMBERS, engine="snaive")), s, [5, 10], 10))


@query()
def family_diagnostics(spark, sf_dir):
    return experiment.family_diagnostics(cut(experiment.family_table(packed(spark, sf_dir))))


# Lengths, cases and comparisons with an outside run.

#: Invented lengths, seasons and horizons of the customers' series.
_SHAPES = "shapes as (select c_custkey as uid, cast(5 + c_custkey % 120 as integer) as n, cast([1, 4, 12][1 + c_nationkey % 3] as integer) as m, cast(6 + c_custkey % 13 as integer) as h from customer)"


def _shapes(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    season = F.array(F.lit(1), F.lit(4), F.lit(12))[(F.col("c_nationkey") % 3).cast("int")]
    return c.select(F.col("c_custkey").alias("uid"), (5 + F.col("c_custkey") % 120).cast("int").alias("n"), season.alias("m"), (6 + F.col("c_custkey") % 13).cast("int").alias("h"))


@query(f"""with {_SHAPES}, t as (select *, cast(least(case when m > 1 then 2 * m else 10 end, floor((n - 1) / 2.0)) as integer) as h_val, least(3 * h, n - h - 7) as back, round_even(n / 4.0, 0) as r from shapes)
select uid, h_val, h_val >= greatest(4, m) as validated, cast(case when back >= h then back end as integer) as lookback, cast(r + case when r % 2 = 0 then 1 else 0 end as integer) as span from t""")
def tail_lengths(spark, sf_dir):
    """Held-out tails, whether they are long enough to validate on, lookbacks and odd spans."""
    s = _shapes(spark, sf_dir).withColumn("h_val", transforms.default_tail(F.col("n"), F.col("m")))
    return s.select("uid", "h_val", (F.col("h_val") >= transforms.least_tail(F.col("m"))).alias("validated"), transforms.lookback(F.col("n"), F.col("h")).cast("int").alias("lookback"), transforms.next_odd(F.col("n") / 4.0).alias("span"))


@query(f"""with {_SHAPES}, k as (select *, case when m > 1 then 2 * m else 10 end as tail from shapes where n - case when m > 1 then 2 * m else 10 end > case when m > 1 then 2 * m else 10 end)
select uid, m, h, 'k5' as variant from k union all select uid, m, h, 'auto' from k where uid in (60, 75)""")
def runnable_cases(spark, sf_dir):
    """Series that are long enough for a comparison with an outside run, by variant."""
    return reports.runnable_cases(_shapes(spark, sf_dir).withColumnRenamed("n", "n_train"), (60, 75))


@query(f"{MONTHLY} select uid, round(greatest(avg(abs(y)), 1e-8), 6) as scale from s where idx > {N - H - 24} and idx <= {N - H} group by uid")
def window_scales(spark, sf_dir):
    """What a network divides a lookback by: its mean absolute value."""
    p = packed(spark, sf_dir)
    return p.select("uid", near(transforms.scale(F.slice("y_train", F.size("y_train") - 23, 24))).alias("scale"))


@query("""with c as (select l_quantity as value, count(*) as n, sum(l_discount) as discount from lineitem group by all)
select value, n, round(discount, 2) as discount, sum(n) over (order by value) - (n - 1) / 2.0 as rank from c""")
def quantity_ranks(spark, sf_dir):
    """Average ranks in a whole table, range by range."""
    found = ranks.value_ranks(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", discount=F.sum("l_discount"))
    return found.select("value", "n", F.round("discount", 2).alias("discount"), "rank")


@query(f"""{_SCORES}, a as (select uid, smape as a from scores where strategy = 'naive'), b as (select uid, smape as b from scores where strategy = 'seasonal' and mase < 1)
select count(*) as n, round(avg(case when b < a then 1.0 else 0.0 end), 6) as win_rate, round(avg(a), 6) as mean_a, round(avg(b), 6) as mean_b from a left join b on a.uid = b.uid""")
def paired_arms(spark, sf_dir):
    """Two arms on the series of the first; where the second lacks one it doesn't win."""
    w = experiment.win_rate(_scores(spark, sf_dir).where("strategy != 'seasonal' or mase < 1"), "naive", "seasonal")
    return w.select("n", *(near(F.col(c)).alias(c) for c in ("win_rate", "mean_a", "mean_b")))


_BAND = f"""{_ERRORS}, ref as (select uid, err as smape_r, err - (select avg(err) from err x where x.uid = err.uid) as engine_delta from err where member = 0),
ours as (select uid, avg(err) as mean_smape, stddev_samp(err) as sd_smape, min(err) as low, max(err) as high, count(*) as seeds from err where member > 0 group by uid),
r as (select uid, avg(rms) as rms_to_reference from (select a.uid, a.member, sqrt(avg((a.value - b.value) * (a.value - b.value))) as rms from ens a join ens b on a.uid = b.uid and a.step = b.step and b.member = 0 where a.member > 0 group by a.uid, a.member) group by uid),
p as (select uid, median(rms) as rms_between_seeds from (select a.uid, sqrt(avg((a.value - b.value) * (a.value - b.value))) as rms from ens a join ens b on a.uid = b.uid and a.step = b.step and a.member < b.member where a.member > 0 group by a.uid, a.member, b.member) group by uid),
band as (select ours.*, smape_r, engine_delta, rms_to_reference, rms_between_seeds, smape_r between low and high as in_band, mean_smape - smape_r as delta, abs(engine_delta) <= 0.5 as counts from ours join ref using (uid) join r using (uid) join p using (uid))"""


def _band(spark, sf_dir) -> DataFrame:
    """Members as seeds, and member 0 as the outside run."""
    points = _ensemble(spark, sf_dir).groupBy("uid", "member").agg(transforms.pack("value", "step").alias("point")).join(_errors(spark, sf_dir), ["uid", "member"])
    mean = points.groupBy("uid").agg(F.avg("err").alias("mean"))
    reference = points.where("member = 0").join(mean, "uid").select(F.col("uid").alias("case"), "point", F.col("err").alias("smape"), (F.col("err") - F.col("mean")).alias("engine_delta"))
    return reports.seed_band(points.where("member > 0").select(F.col("uid").alias("case"), F.col("member").alias("seed"), "point", F.col("err").alias("smape")), reference)


@query(f"{_BAND} select uid, seeds, round(mean_smape, 5) as mean_smape, round(sd_smape, 5) as sd_smape, round(rms_to_reference, 4) as rms_to_reference, round(rms_between_seeds, 4) as rms_between_seeds, in_band, round(delta, 5) as delta, counts from band")
def seed_band(spark, sf_dir):
    """Our seeds against one outside run, by case."""
    digits = {"mean_smape": 5, "sd_smape": 5, "rms_to_reference": 4, "rms_between_seeds": 4, "delta": 5}
    return _band(spark, sf_dir).select(F.col("case").alias("uid"), "seeds", "in_band", "counts", *(near(F.col(c), d).alias(c) for c, d in digits.items()))


@query(f"""{_BAND}, g as (select count(*) as n, count(*) filter (where counts) as n_counting, count(*) filter (where counts and not in_band) as out_of_band, avg(delta) filter (where counts) as mean_delta,
 coalesce(bool_and(abs(delta) <= greatest(1.5, 3 * sd_smape)) filter (where counts), true) as near, coalesce(bool_and(abs(delta) <= abs(engine_delta) + 1.5) filter (where not counts), true) as attributed from band)
select n, n_counting, out_of_band, round(mean_delta, 5) as mean_delta, attributed, out_of_band <= 1 as g1, coalesce(near and abs(mean_delta) <= 0.5, false) as g2, out_of_band <= 1 and coalesce(near and abs(mean_delta) <= 0.5, false) and attributed as passed from g""")
def outside_gates(spark, sf_dir):
    """Whether the whole method agrees with the outside run."""
    return reports.gates(_band(spark, sf_dir)).withColumn("mean_delta", near(F.col("mean_delta"), 5))


# Tests of many groups at once, choices that are judged elsewhere, agreement of labellings.

_STEPS = 1000


def _integral(f: str, upto: str) -> str:
    """Simpson's rule for a function of ``u`` from 0 on, in SQL: another way to a tail than the series of the library."""
    at = lambda shift: f.replace("u", f"({upto} * (i + {shift}) / {_STEPS})")
    return f"{upto} / {6 * _STEPS}.0 * list_sum(list_transform(range(0, {_STEPS}), lambda i: {at(0)} + 4 * {at(0.5)} + {at(1)}))"


#: Sign patterns of n ranks by their sum.
_PATTERNS = """ways as (select 0 as k, 0 as s, 1.0::double as c union all
 select k + 1, s + d * (k + 1), sum(c) from ways cross join (select unnest([0, 1]) as d) x where k < 50 group by k, s + d * (k + 1)),
upto as (select k, s, sum(c) over (partition by k order by s) as c from ways)"""


def _signed_rank_sql(pairs: str, by: str) -> str:
    """Common tables that end in ``tested(by, n, w, p)`` for ``pairs(by, d)``."""
    z = "(abs(w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0))"
    return f"""sized as (select {by}, d, rank() over (partition by {by} order by abs(d)) + (count(*) over (partition by {by}, abs(d)) - 1) / 2.0 as r, count(*) over (partition by {by}, abs(d)) as t from {pairs} where d <> 0),
summed as (select g.{by}, count(d) as n, coalesce(sum(r) filter (where d > 0), 0) as plus, coalesce(sum(r) filter (where d < 0), 0) as minus, coalesce(sum(t * t - 1.0), 0) as ties
 from (select distinct {by} from {pairs}) g left join sized on g.{by} = sized.{by} group by g.{by}),
least_ as (select *, least(plus, minus) as w from summed), {_PATTERNS},
tested as (select {by}, n, plus, minus, w, case when n = 0 then 1.0 when n <= 50 and ties = 0 then least(1.0, 2 * c / pow(2, n)) else 1 - sqrt(2 / pi()) * {_integral("exp(-u * u / 2)", z)} end as p
 from least_ l left join upto on upto.k = l.n and upto.s = floor(w))"""


_HALVES = """h as (select c_nationkey as nation, c_custkey, count(*) filter (where o_orderstatus = 'F') as a, count(*) filter (where o_orderstatus = 'O') as b,
 cast(round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'F'), 0) * 100) as bigint) as x, cast(round(coalesce(sum(o_totalprice) filter (where o_orderstatus = 'O'), 0) * 100) as bigint) as y
 from customer join orders on o_custkey = c_custkey group by all),
pairs as (select 'orders ' || nation as unit, a - b as d from h union all select 'cents ' || nation, x - y from h)"""


@query(f"""with recursive {_HALVES}, {_signed_rank_sql("pairs", "unit")} select unit, n, round(plus, 2) as w_plus, round(minus, 2) as w_minus, round(w, 2) as w, round(p, 6) as p from tested""")
def signed_rank_groups(spark, sf_dir):
    """Signed-rank tests of all nations in one pass: open against finished orders of each customer, by number and by value."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    status = lambda s, c, f: F.coalesce(f(F.when(F.col("o_orderstatus") == s, c)), F.lit(0))
    cents = lambda s: F.round(status(s, F.col("o_totalprice"), F.sum) * 100).cast("long")
    h = read("customer").join(read("orders"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_custkey").agg(
        status("F", F.lit(1), F.count).alias("a"), status("O", F.lit(1), F.count).alias("b"), cents("F").alias("x"), cents("O").alias("y")
    )
    unit = lambda name, a, b: F.struct(F.concat(F.lit(f"{name} "), F.col("c_nationkey").cast("string")).alias("unit"), F.col(a).alias("a"), F.col(b).alias("b"))
    pairs = h.select(F.explode(F.array(unit("orders", "a", "b"), unit("cents", "x", "y"))).alias("p")).select("p.*")
    found = ranks.signed_rank(pairs, "a", "b", ("unit",))
    return found.select("unit", "n", *(F.round(c, 2).alias(c) for c in ("w_plus", "w_minus", "w")), near(F.col("p")).alias("p"))


@query(f"""with c as (select c_nationkey as nation, c_acctbal as x, count(o_orderkey) as y from customer left join orders on o_custkey = c_custkey group by c_nationkey, c_custkey, c_acctbal),
r as (select nation, rank() over (partition by nation order by x) + (count(*) over (partition by nation, x) - 1) / 2.0 as rx, rank() over (partition by nation order by y) + (count(*) over (partition by nation, y) - 1) / 2.0 as ry from c),
k as (select nation, case when stddev_pop(rx) * stddev_pop(ry) > 0 then corr(rx, ry) end as rho, count(*) as n from r group by nation),
t as (select *, n < 3 or rho is null as none, abs(rho) >= 1 - 1e-15 as sure, case when n >= 3 and abs(rho) < 1 - 1e-15 then abs(rho) * sqrt((n - 2) / (1 - rho * rho)) else 0 end as t, greatest(1, n - 2.0) as v from k)
select nation, n, round(rho, 6) as rho, case when none then 1 when sure then 0 else round(1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * {_integral("pow(1 + u * u / v, -(v + 1) / 2)", "t")}, 6) end as p from t""")
def spearman_groups(spark, sf_dir):
    """Rank correlation of a customer's balance and orders in every nation, tails included."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    placed = read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("y"))
    c = read("customer").join(placed, "c_custkey", "left").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return ranks.spearman(c, "x", "y", ("nation",)).select("nation", "n", near(F.col("rho")).alias("rho"), near(F.col("p")).alias("p"))


_SEASONS = 5


def _by_seasons(spark, sf_dir) -> DataFrame:
    """Scores of means of the same month over the last 1 to 5 years, on the last year of every nation's orders."""
    p = sources.nation_months(spark, sf_dir).groupBy("uid").agg(transforms.pack().alias("y"))
    s = sources.split(p.withColumn("n_train", F.lit(_NT)))
    made = lambda k: F.transform(F.sequence(F.lit(0), F.lit(M - 1)), lambda t: sum(F.get("y_train", F.lit(_NT - M * j) + t) for j in range(1, k + 1)) / float(k))
    arms = F.array(*[F.struct(F.lit(f"k{k}").alias("strategy"), made(k).alias("f")) for k in range(1, _SEASONS + 1)])
    rows = s.select("uid", "y_test", F.explode(arms).alias("p")).select("uid", "y_test", "p.strategy", "p.f")
    smape = metrics.array_mean(F.zip_with("y_test", "f", lambda y, f: F.when(y + f > 0, 200 * F.abs(y - f) / F.greatest(y + f, F.lit(1e-9))).otherwise(0.0)))
    return rows.select("uid", "strategy", near(smape, 4).alias("smape"))


_BY_SEASONS = f"""s as ({sources.NATIONS_SQL}), f as (select a.uid, a.idx, a.y, k, avg(b.y) as f from s a cross join (select unnest(range(1, {_SEASONS + 1})) as k) x join s b on a.uid = b.uid and (a.idx - b.idx) % {M} = 0 and a.idx > b.idx and a.idx - b.idx <= {M} * k where a.idx > {_NT} group by all),
scores as (select uid, 'k' || k as strategy, round(avg(case when y + f > 0 then 200 * abs(y - f) / (y + f) else 0 end), 4) as smape from f group by uid, k),
base as (select uid, smape as a from scores where strategy = 'k1'), ab as (select strategy, uid, a, smape as b, smape - a as d from scores join base using (uid) where strategy <> 'k1')"""


@query(f"""with recursive {_BY_SEASONS}, {_signed_rank_sql("ab", "strategy")},
hard as (select uid, ceil(row_number() over (order by a, uid) * 10 / count(*) over ()) = 10 as hardest from base),
told as (select strategy, count(*) as n, avg(d) as mean_difference, avg(case when b < a then 1.0 else 0.0 end) as win_rate, avg(d) filter (where hardest) as hardest_difference, avg(d) filter (where not hardest) as other_difference from ab join hard using (uid) group by strategy)
select strategy, told.n, round(mean_difference, 6) as mean_difference, round(win_rate, 6) as win_rate, round(hardest_difference, 6) as hardest_difference, round(other_difference, 6) as other_difference, round(w, 2) as w, round(p, 6) as p from told join tested using (strategy)""")
def paired_by_k(spark, sf_dir):
    """Averages of k years against one year: paired tests for every k, and differences on the hardest tenth of the series."""
    t = experiment.paired_tests(_by_seasons(spark, sf_dir), "k1")
    return t.select("strategy", "n", *(near(F.col(c)).alias(c) for c in ("mean_difference", "win_rate", "hardest_difference", "other_difference")), F.round("w", 2).alias("w"), near(F.col("p")).alias("p"))


@query(f"""with recursive {_BY_SEASONS}, halved as (select *, cast(cast('0x' || md5('7:' || uid)[1:8] as bigint) % 2 as varchar) as half from ab),
chosen as (select half, min(row(error, strategy)) as best from (select half, strategy, avg(b) as error from halved group by all) group by half),
scored as (select h.half, h.strategy, h.d from halved h join chosen c on c.half <> h.half and h.strategy = c.best[2]),
parts as (select half, strategy, d from scored union all select 'both', strategy, d from scored), {_signed_rank_sql("parts", "half")},
told as (select half, string_agg(distinct strategy, ',' order by strategy) as strategy, count(*) as n, avg(d) as mean_difference from parts group by half)
select half, strategy, told.n, round(mean_difference, 6) as mean_difference, round(w, 2) as w, round(p, 6) as p from told join tested using (half)""")
def split_half_k(spark, sf_dir):
    """The number of years chosen on one half of the series and judged on the other."""
    found = experiment.split_half(_by_seasons(spark, sf_dir), [f"k{k}" for k in range(2, _SEASONS + 1)], "k1", seed=7)
    return found.select("half", "strategy", "n", near(F.col("mean_difference")).alias("mean_difference"), F.round("w", 2).alias("w"), near(F.col("p")).alias("p"))


@query("""with c as (select c_mktsegment as segment, c_nationkey as cluster, count(*) as size from customer group by all), q as (select c.*, n, sum(size) over (partition by segment, n) as pool from c cross join (select unnest([10, 100, 280]) as n) x),
b as (select *, size / pool * n as share, floor(size / pool * n) as low from q),
w as (select *, cast(least(size, greatest(1, low + case when row_number() over (partition by segment, n order by low - share, cluster) <= n - sum(low) over (partition by segment, n) then 1 else 0 end)) as bigint) as wanted from b),
units as (select segment, n, cluster, row_number() over (partition by segment, n order by h desc, cluster) as rn, over_ from (select segment, n, cluster, unnest(range(0, wanted)) as h, over_ from (select *, sum(wanted) over (partition by segment, n) - n as over_ from w))),
lost as (select segment, n, cluster, count(*) as lost from units where rn <= over_ group by all),
v as (select w.*, wanted - coalesce(lost, 0) as kept from w left join lost using (segment, n, cluster)),
rooms as (select segment, n, cluster, row_number() over (partition by segment, n order by h desc, cluster) as rn, under from (select segment, n, cluster, unnest(range(0, size - kept)) as h, under from (select *, n - sum(kept) over (partition by segment, n) as under from v))),
more as (select segment, n, cluster, count(*) as more from rooms where rn <= under group by all)
select segment, cast(n as integer) as n, cluster, size, cast(kept + coalesce(more, 0) as bigint) as take from v left join more using (segment, n, cluster)""")
def exact_allocations(spark, sf_dir):
    """Members a cluster gives, many pools at once: fewer members than clusters, some, and nearly all of the pool."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("size"))
    pools = c.withColumn("n", F.explode(F.array(*map(F.lit, (10, 100, 280)))))
    return aggregates.allocate(pools, ["segment", "n"], F.col("n")).select("segment", "n", "cluster", "size", "take")


@query("""with v as (select l_returnflag as flag, l_extendedprice as v, count(*) filter (where l_discount < 0.05) as a, count(*) filter (where l_discount >= 0.05) as b from lineitem group by all),
r as (select flag, sum(a) over (partition by flag order by v) as ra, sum(b) over (partition by flag order by v) as rb, sum(a) over (partition by flag) as n, sum(b) over (partition by flag) as m from v),
g as (select flag, any_value(n) as n, any_value(m) as m, max(abs(ra / n - rb / m)) as gap from r group by flag), z as (select *, gap * sqrt(n * m / (n + m)) as z from g)
select flag, cast(n as bigint) as n, cast(m as bigint) as m, round(gap, 8) as gap, round(case when z < 0.2 then 1 else greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda k: case when k % 2 = 1 then 2 else -2 end * exp(-2 * k * k * z * z))))) end, 6) as p from z""")
def price_samples(spark, sf_dir):
    """Do prices of what is sold cheaper follow those of the rest? Two-sample tests by return flag over the whole table."""
    found = ranks.two_samples(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_extendedprice", F.col("l_discount") >= 0.05, ("l_returnflag",))
    return found.select(F.col("l_returnflag").alias("flag"), "n", "m", F.round("gap", 8).alias("gap"), near(F.col("p")).alias("p"))


@query("""with l as (select c_mktsegment as segment, c_nationkey as a, c_nationkey % 5 as b from customer), c as (select segment, a, b, count(*) as c from l group by all),
x as (select segment, sum(c * (c - 1) / 2.0) as same, sum(c) as n from c group by segment), ra as (select segment, sum(c * (c - 1) / 2.0) as p from (select segment, a, sum(c) as c from c group by all) group by segment),
rb as (select segment, sum(c * (c - 1) / 2.0) as p from (select segment, b, sum(c) as c from c group by all) group by segment)
select segment, cast(n as bigint) as n, round((same - ra.p * rb.p / (n * (n - 1) / 2.0)) / ((ra.p + rb.p) / 2 - ra.p * rb.p / (n * (n - 1) / 2.0)), 8) as ari from x join ra using (segment) join rb using (segment)""")
def rand_index(spark, sf_dir):
    """Agreement of two labellings of the customers, by market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("a"), (F.col("c_nationkey") % 5).alias("b"))
    return ranks.adjusted_rand(c, "a", "b", ("segment",)).select("segment", "n", F.round("ari", 8).alias("ari"))


@query(f"""{_REPLICAS}, fits as (select a.uid, a.member, a.idx, b.y as fitted from rep a join rep b on a.uid = b.uid and a.member = b.member and b.idx = a.idx - {M}),
chosen as (select member, 'first10' as strategy from mem where member < 10 union all select member, 'odd' from mem where member % 2 = 1)
select fits.uid, strategy, cast(fits.idx as integer) as idx, round(avg(fitted), 4) as fitted, round(any_value(s.y) - avg(fitted), 4) as residual, count(*) as n
from fits join chosen using (member) join s on s.uid = fits.uid and s.idx = fits.idx group by fits.uid, strategy, fits.idx""")
def insample_fits(spark, sf_dir):
    """What two ensembles of seasonal learners would have said one step ahead, and their residuals."""
    members = _replicas(spark, sf_dir)
    made = experiment.forecasts(members.select("uid", F.lit(M).alias("m"), F.lit(H).alias("h"), F.lit(0).alias("h_val"), F.col("member").cast("int").alias("member"), "y"), "snaive", validate=False, fitted=True)
    chosen = lambda name, rows: rows.select("uid", "member", F.lit(name).alias("strategy"), F.lit(0).alias("seed"))
    selected = chosen("first10", members.where("member < 10")).unionByName(chosen("odd", members.where("member % 2 = 1")))
    found = reports.fitted_ensemble(made, selected, packed(spark, sf_dir))
    return found.select("uid", "strategy", F.col("idx").cast("int").alias("idx"), near(F.col("fitted"), 4).alias("fitted"), near(F.col("residual"), 4).alias("residual"), "n")


@query(f"""{_SCORES}{_RANKED}, t as (select sum(c * c * c - c) as ties from (select count(*) as c from rk group by uid, smape)), g as (select strategy, sum(rs) as total, avg(rs) as mean_rank, count(*) as n from rk group by strategy),
p as (select max(n) as n, count(*) as k, sum(total * total) as sq, min(row(mean_rank, strategy)) as base from g),
x as (select k, base[1] as least, base[2] as control, sqrt(k * (k + 1) / (6.0 * n)) as scale, (12.0 / (n * k * (k + 1)) * sq - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) as chi from p cross join t),
z as (select strategy, mean_rank, (mean_rank - least) / scale as z, control, chi from g cross join x where strategy <> control),
w as (select *, 1 - sqrt(2 / pi()) * {_integral("exp(-u * u / 2)", "z")} as p_raw from z),
h as (select *, row_number() over (order by p_raw desc) as place from w)
select strategy, round(mean_rank, 6) as mean_rank, round(z, 6) as z, round(p_raw, 6) as p_raw, round(least(1.0, min(p_raw * place) over (order by place)), 6) as p_hochberg, control,
 round(1 - sqrt(2 / pi()) * {_integral("exp(-u * u / 2)", "sqrt(chi)")} + sqrt(2 * chi / pi()) * exp(-chi / 2), 6) as friedman_p from h""")
def strategy_tests(spark, sf_dir):
    """Friedman's test (four strategies, so three degrees of freedom) and Hochberg's comparisons with the best learner, tails included."""
    found = experiment.compare(_scores(spark, sf_dir))
    table = spark.createDataFrame(found["table"]).select("strategy", *(near(F.col(c)).alias(c) for c in ("mean_rank", "z", "p_raw", "p_hochberg")))
    return table.withColumns({"control": F.lit(found["control"]), "friedman_p": near(F.lit(found["friedman_pvalue"]))})
