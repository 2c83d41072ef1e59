"""A long/short book on predictions: equal weights in the k best and k worst of each day, turnover, costs, equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .metrics import finite, ratio


def weights(df: DataFrame, q: float = 0.1, least: int = 20, time: str = "timestamp", p: str = "y_pred", y: str = "y_true", tie: str = "symbol") -> DataFrame:
    """time, symbol, w, y_true: +1/k for the k best and -1/k for the k worst, k = max(1, floor(n q)); days under `least` are not traded."""
    w = Window.partitionBy(time)
    n = F.count(F.lit(1)).over(w)
    i = F.row_number().over(w.orderBy(F.col(p).asc(), F.col(tie).asc()))
    d = df.filter(finite(y, p)).select(time, tie, F.col(y).alias("y_true"), n.alias("n"), i.alias("i")).filter(F.col("n") >= least).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("n") * q)))
    side = F.when(F.col("i") > F.col("n") - F.col("k"), 1.0).otherwise(0.0) - F.when(F.col("i") <= F.col("k"), 1.0).otherwise(0.0)
    return d.select(time, tie, (side / F.col("k")).alias("w"), "y_true").filter("w <> 0")


def daily_returns(book: DataFrame, cost_bps: float = 0.0, time: str = "timestamp", tie: str = "symbol") -> DataFrame:
    """time, gross, turnover, net. Turnover is half the summed change of weights since the day traded before; a first day's is from an empty book."""
    days = book.select(time).distinct().withColumn("next", F.lead(time).over(Window.orderBy(time)))
    now = book.select(time, tie, "w", F.lit(0.0).alias("before"))
    # A day's weights are what the next traded day changes from.
    held = book.join(F.broadcast(days), time).filter("next IS NOT NULL").select(F.col("next").alias(time), tie, F.lit(0.0).alias("w"), F.col("w").alias("before"))
    change = now.unionByName(held).groupBy(time, tie).agg((F.sum("w") - F.sum("before")).alias("d")).groupBy(time).agg((F.sum(F.abs("d")) / 2).alias("turnover"))
    gross = book.groupBy(time).agg(F.sum(F.col("w") * F.col("y_true")).alias("gross"))
    return gross.join(change, time).withColumn("net", F.col("gross") - F.col("turnover") * cost_bps / 1e4)


def equity(returns: DataFrame, time: str = "timestamp", r: str = "net") -> DataFrame:
    """returns with equity (product of 1 + r), peak and drawdown; the peak starts at the first equity. One row a day: small enough for one sort."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    e = F.exp(F.sum(F.ln(F.greatest(1 + F.col(r), F.lit(1e-12)))).over(w))
    out = returns.withColumn("equity", e)
    return out.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def report(curve: DataFrame, periods: int = 252, r: str = "net", time: str = "timestamp") -> DataFrame:
    """One row: n_days, mean, sharpe, hit_rate, mean_turnover, max_drawdown, total_return."""
    return curve.agg(
        F.count(F.lit(1)).alias("n_days"),
        F.avg(r).alias("mean"),
        (ratio(F.avg(r), F.stddev_samp(r)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.avg((F.col(r) > 0).cast("double")).alias("hit_rate"),
        F.avg("turnover").alias("mean_turnover"),
        F.min("drawdown").alias("max_drawdown"),
        (F.max_by("equity", time) - 1).alias("total_return"),
    )
