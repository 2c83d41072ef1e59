"""Panels for supervised learning: lags, forward targets, inference rows, sequences, scaling, alignment."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(symbol: str = "symbol", time: str = "timestamp"):
    return Window.partitionBy(symbol).orderBy(time)


def lag_spec(features: list[str], spec: dict | None, default: int | list | None) -> dict[str, list[int]]:
    """Lags of each feature. A negative number leaves the feature out, 0 is today alone, n is 0 .. n - 1 (1 too is today), a list is itself; what is not named gets the default."""
    out = {}
    for f in features:
        v = (spec or {}).get(f, default)
        if v is None:
            raise ValueError(f"no lags for {f}")
        lags = sorted(set(map(int, v))) if isinstance(v, (list, tuple)) else ([] if v < 0 else list(range(max(1, v))))
        if any(x < 0 for x in lags):
            raise ValueError("lags look back")
        if lags:
            out[f] = lags
    return out


def lag_columns(spec: dict[str, list[int]], symbol: str = "symbol", time: str = "timestamp") -> list[Column]:
    """All lags over one window, lag by lag: one sort whatever their number."""
    names = [(f, k) for k in sorted({k for v in spec.values() for k in v}) for f in spec if k in spec[f]]
    return [(F.lag(f"`{f}`", k).over(_w(symbol, time)) if k else F.col(f"`{f}`")).alias(f"{f}_lag{k}") for f, k in names]


def log_return(horizon: int, price: str = "close", symbol: str = "symbol", time: str = "timestamp") -> Column:
    """ln of the price `horizon` rows ahead over today's; null where either is not positive."""
    ahead = F.lead(price, horizon).over(_w(symbol, time))
    return F.when((ahead > 0) & (F.col(price) > 0), F.ln(ahead / F.col(price)))


def supervised(bars: DataFrame, features: list[str], lookback: int, horizon: int, spec: dict | None = None, price: str = "close", symbol: str = "symbol", time: str = "timestamp") -> DataFrame:
    """symbol, timestamp, target_timestamp, lags, y: rows with any null left out."""
    lags = lag_columns(lag_spec(features, spec, lookback), symbol, time)
    return bars.select(symbol, time, F.lead(time, horizon).over(_w(symbol, time)).alias("target_timestamp"), *lags, log_return(horizon, price, symbol, time).alias("y")).dropna()


def multi_horizon(bars: DataFrame, features: list[str], lookback: int, horizons: list[int], price: str = "close") -> DataFrame:
    """One row for each key with a target for every horizon: y_h, target_timestamp_h, and the latest target time."""
    leads = [c for h in horizons for c in (log_return(h, price).alias(f"y_{h}"), F.lead("timestamp", h).over(_w()).alias(f"target_timestamp_{h}"))]
    rows = bars.select("symbol", "timestamp", *lag_columns(lag_spec(features, None, lookback)), *leads).dropna()
    return rows.withColumn("target_timestamp_max", F.greatest(*[F.col(f"target_timestamp_{h}") for h in horizons]) if len(horizons) > 1 else F.col(f"target_timestamp_{horizons[0]}"))


def latest(df: DataFrame, n: int, symbol: str = "symbol", time: str = "timestamp") -> DataFrame:
    """The last n rows of each symbol (a group limit, which Spark applies before the shuffle)."""
    w = Window.partitionBy(symbol).orderBy(F.col(time).desc())
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def inference(bars: DataFrame, features: list[str], lookback: int, select: str = "latest", tail_n: int = 1, spec: dict | None = None) -> DataFrame:
    """Lags for prediction: the latest row of each symbol, its last tail_n rows, or all. Only the tail that lags need is lagged."""
    if select not in ("latest", "tail", "all"):
        raise ValueError(select)
    lags = lag_spec(features, spec, lookback)
    n = 1 if select == "latest" else tail_n
    reach = max((k for v in lags.values() for k in v), default=0)
    rows = bars if select == "all" else latest(bars, n + reach)
    out = rows.select("symbol", "timestamp", *lag_columns(lags)).dropna()
    return out if select == "all" else latest(out, n)


def sequences(bars: DataFrame, features: list[str], lookback: int, oldest_first: bool = True) -> DataFrame:
    """symbol, timestamp, x: for each feature an array of its last `lookback` values; rows without full history left out."""
    w = _w()
    span = range(lookback - 1, -1, -1) if oldest_first else range(lookback)
    x = F.array(*[F.array(*[F.lag(f"`{f}`", k).over(w) if k else F.col(f"`{f}`") for k in span]) for f in features])
    full = (F.row_number().over(w) >= lookback).alias("full")
    return bars.select("symbol", "timestamp", x.alias("x"), full).filter("full").drop("full")


def flat_window(bars: DataFrame, features: list[str], lookback: int) -> DataFrame:
    """The latest window of each symbol as one vector: feature by feature, lag 0 first."""
    return latest(sequences(bars, features, lookback, oldest_first=False), 1).select("symbol", "timestamp", F.flatten("x").alias("x"))


def parse_lag_name(name: str) -> tuple[str, int] | None:
    """Feature and lag of a column name: f_lag3, f_lag_3, f.lag3, f_t-3."""
    m = re.fullmatch(r"(.+?)(?:_lag_?|\.lag|_t-)(\d+)", name)
    return (m[1], int(m[2])) if m else None


def fit_scale(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation of each feature (deviation 1 where it is 0)."""
    return train.agg(*[c for f in features for c in (F.avg(f).alias(f"{f}__mean"), F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias(f"{f}__dev"))])


def apply_scale(df: DataFrame, scale: DataFrame, features: list[str]) -> DataFrame:
    """(x - mean) / deviation. The scale is a single row."""
    rest = [c for c in df.columns if c not in features]
    return df.crossJoin(F.broadcast(scale)).select(*rest, *[((F.col(f) - F.col(f"{f}__mean")) / F.col(f"{f}__dev")).alias(f) for f in features])


def align(df: DataFrame, names: list[str], strict: bool = True, fill: float = 0.0) -> DataFrame:
    """Keys and the model's features in its order: missing ones raise, or are filled; extra ones go."""
    missing = [n for n in names if n not in df.columns]
    if strict and missing:
        raise ValueError(f"missing features: {missing}")
    keys = [c for c in ("symbol", "timestamp") if c in df.columns]
    return df.select(*keys, *[F.coalesce(F.nanvl(F.col(f"`{n}`").cast("double"), F.lit(None).cast("double")), F.lit(fill)).alias(n) if n in df.columns else F.lit(fill).alias(n) for n in names])


def pivot_last(long: DataFrame, keys: list[str], name: str, value: str, values: list[str], prefix: str = "") -> DataFrame:
    """Long to wide for the names given, which keeps the plan's columns fixed. A key has one value for each name."""
    return long.filter(F.col(name).isin(values)).groupBy(*keys).agg(*[F.max(F.when(F.col(name) == v, F.col(value))).alias(f"{prefix}{v}") for v in values])


def panel(bars: DataFrame, indicators: DataFrame | None = None, macro: DataFrame | None = None, facts: DataFrame | None = None, macro_columns: list[str] = (), fact_columns: list[str] = ()) -> DataFrame:
    """Bars with indicators of the same key, the latest macro values, and the symbol's latest facts."""
    from .asof import asof_backward, asof_keyless

    out = bars
    if indicators is not None:
        out = out.join(indicators.drop("timeframe"), ["symbol", "timestamp"], "left")
    if macro is not None:
        out = asof_keyless(out, macro, "timestamp", "date", list(macro_columns))
    if facts is not None:
        out = asof_backward(out, facts, "timestamp", "asof_date", "symbol", list(fact_columns)).drop("asof_date")
    return out
