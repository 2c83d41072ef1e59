"""Evaluation of predictions: regression metrics, cross-sectional correlations, quantile spreads, conformal bounds.

Division and correlation never raise: groups without variance give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded


def finite(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def pearson(x: str, y: str) -> Column:
    """Aggregate; null without variance."""
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def average_rank(x: str, partition: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*partition)
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, x)) - 1) / 2


def basic(df: DataFrame, by: list[str] = (), y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """n, mae, rmse, hit_rate (targets of about 0 left out), pearson, q99_abs."""
    d = df.filter(finite(y, p))
    e = F.col(p) - F.col(y)
    hit = F.when(F.abs(y) > 1e-8, (F.signum(y) == F.signum(p)).cast("double"))
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(hit).alias("hit_rate"), pearson(y, p).alias("pearson"), F.percentile(F.abs(e), F.lit(0.99)).alias("q99_abs"))


def extended(df: DataFrame, deadzone: float = 0.0, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """basic, and medae, r2, hit_rate_deadzone, auc (Mann-Whitney of the sign, ties at half)."""
    d = df.filter(finite(y, p))
    e = F.col(p) - F.col(y)
    hit = F.when(F.abs(y) > deadzone, (F.signum(y) == F.signum(p)).cast("double"))
    more = d.agg(F.percentile(F.abs(e), F.lit(0.5)).alias("medae"), (1 - ratio(F.sum(e * e), F.var_pop(y) * F.count(F.lit(1)))).alias("r2"), F.avg(hit).alias("hit_rate_deadzone"))
    return basic(d, (), y, p).crossJoin(more).crossJoin(auc(d, y, p))


def auc(df: DataFrame, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """One value: how often a positive target's prediction is above another one's. Counts of equal predictions are summed in order, range by range."""
    counts = df.groupBy(p).agg(F.sum((F.col(y) > 0).cast("long")).alias("pos"), F.sum((F.col(y) <= 0).cast("long")).alias("neg"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = counts.repartitionByRange(n, p).withColumn("__p", F.spark_partition_id())
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("__p").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = dealt.withColumn("below", inside).groupBy("__p").agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = F.coalesce(F.sum("neg").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.withColumn("before", before).agg(ratio(F.sum(F.col("won") + F.col("pos") * F.col("before")), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def daily_ic(df: DataFrame, time: str = "timestamp", y: str = "y_true", p: str = "y_pred", least: int = 2) -> DataFrame:
    """time, n, ic, rank_ic of each cross-section of at least `least` finite rows."""
    d = df.filter(finite(y, p)).select(time, F.col(y).alias("__y"), F.col(p).alias("__p"), average_rank(y, [time]).alias("__ry"), average_rank(p, [time]).alias("__rp"))
    out = d.groupBy(time).agg(F.count(F.lit(1)).alias("n"), pearson("__y", "__p").alias("ic"), pearson("__ry", "__rp").alias("rank_ic"))
    return out.filter(F.col("n") >= least)


def summary(df: DataFrame, x: str) -> DataFrame:
    """n, mean, std (ddof 1), t-statistic, share above 0, of the finite values. An empty table gives n 0 and nulls."""
    d = df.filter(finite(x))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), ratio(F.avg(x) * F.sqrt(F.count(F.lit(1))), F.stddev_samp(x)).alias("tstat"), F.avg((F.col(x) > 0).cast("double")).alias("frac_positive"))


def quantile_spread(df: DataFrame, q: float = 0.1, least: int = 20, time: str = "timestamp", y: str = "y_true", p: str = "y_pred", tie: str = "symbol", at_least_one: bool = False) -> DataFrame:
    """time, n, k, top, bottom, spread: mean target of the k best less that of the k worst, k = floor(n q)."""
    d = df.filter(finite(y, p))
    w = Window.partitionBy(time)
    n = F.count(F.lit(1)).over(w)
    k = F.greatest(F.lit(1), F.floor(n * q)) if at_least_one else F.floor(n * q)
    ranked = d.select(time, F.col(y).alias("__y"), n.alias("n"), k.alias("k"), F.row_number().over(w.orderBy(F.col(p).asc(), F.col(tie).asc())).alias("__i")).filter((F.col("n") >= least) & (F.col("k") >= 1))
    top, bottom = F.avg(F.when(F.col("__i") > F.col("n") - F.col("k"), F.col("__y"))), F.avg(F.when(F.col("__i") <= F.col("k"), F.col("__y")))
    return ranked.groupBy(time, "n", "k").agg(top.alias("top"), bottom.alias("bottom"), (top - bottom).alias("spread"))


def sharpe(df: DataFrame, x: str = "spread", periods: int = 252) -> DataFrame:
    return df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), (ratio(F.avg(x), F.stddev_samp(x)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def conformal(cal: DataFrame, test: DataFrame, alpha: float = 0.1, y: str = "y_true", p: str = "y_pred", interpolate: bool = False) -> DataFrame:
    """Split-conformal: the k-th smallest absolute residual of the calibration rows, k = ceil((n + 1)(1 - alpha)) at most n (or the interpolated quantile); coverage and width on the test rows."""
    r = cal.filter(finite(y, p)).select(F.abs(F.col(y) - F.col(p)).alias("r"))
    n = r.count()
    if not n:
        raise ValueError("no calibration rows")
    import math

    k = min(n, math.ceil((n + 1) * (1 - alpha) - 1e-12))
    share = 1 - alpha if interpolate else (k - 1) / max(1, n - 1)
    qhat = r.agg(F.percentile("r", F.lit(share)).alias("qhat"))
    inside = (F.abs(F.col(y) - F.col(p)) <= F.col("qhat") + 1e-12).cast("double")
    return test.filter(finite(y, p)).crossJoin(F.broadcast(qhat)).agg(F.first("qhat").alias("qhat"), F.avg(inside).alias("coverage"), (2 * F.first("qhat")).alias("width"), F.count(F.lit(1)).alias("n"))


def buckets(df: DataFrame, n: int = 10, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Mean of target and prediction in buckets between exact quantiles of the prediction, equal edges merged: bucket, n, mean_true, mean_pred."""
    edges = df.agg(F.array_distinct(F.percentile(p, F.array(*[F.lit(i / n) for i in range(n + 1)]))).alias("edges"))
    # The first bucket holds its lower edge; others do not.
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col(p)))).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_true"), F.avg(p).alias("mean_pred"))


def rank_cross_section(df: DataFrame, q: float = 0.1, by: list[str] = ("timestamp", "horizon"), p: str = "y_pred", tie: str = "symbol", digits: int | None = None) -> DataFrame:
    """rank (1 best, ties by `tie`), rank_pct, bucket: long if rank_pct <= q, short if >= 1 - q, else neutral. With `digits`, predictions that are equal once rounded tie."""
    w = Window.partitionBy(*by)
    key = F.col(p) if digits is None else rounded(F.col(p), digits)
    out = df.withColumn("rank", F.row_number().over(w.orderBy(key.desc(), F.col(tie).asc()))).withColumn("rank_pct", F.col("rank") / F.count(F.lit(1)).over(w))
    return out.withColumn("bucket", F.when(F.col("rank_pct") <= q, "long").when(F.col("rank_pct") >= 1 - q, "short").otherwise("neutral"))


def ensemble(df: DataFrame, models: dict[str, float], q: float = 0.1, require: int = 1, model: str = "model", keys: list[str] = ("timestamp", "symbol")) -> DataFrame:
    """Weighted mean of the models' rank_pct over those that are there, disagreement (population deviation), votes, bucket, signal 0.5 - rank."""
    weight = F.create_map(*[x for m, w in models.items() for x in (F.lit(m), F.lit(float(w)))])[F.col(model)]
    d = df.filter(F.col(model).isin(list(models))).withColumn("__w", weight)
    out = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_models"), ratio(F.sum(F.col("rank_pct") * F.col("__w")), F.sum("__w")).alias("ensemble_rank"), F.stddev_pop("rank_pct").alias("disagreement"), F.sum((F.col("bucket") == "long").cast("int")).alias("long_votes"), F.sum((F.col("bucket") == "short").cast("int")).alias("short_votes"))
    return out.filter(F.col("n_models") >= require).withColumn("bucket", F.when(F.col("ensemble_rank") <= q, "long").when(F.col("ensemble_rank") >= 1 - q, "short").otherwise("neutral")).withColumn("signal", 0.5 - F.col("ensemble_rank"))


def deadzone(horizon: int, k: float = 0.15, daily: float = 0.012) -> float:
    """A target this small is no direction: k times a typical daily move, by the root of the horizon."""
    return k * daily * horizon**0.5
