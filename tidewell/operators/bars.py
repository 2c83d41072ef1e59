"""Bars: the panel's unit of data, made from ticks or coarser from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(ticks: DataFrame, symbol: str, time: str, price: str, unit: str = "day", timeframe: str = "1Day") -> DataFrame:
    """symbol, timestamp, timeframe, open, high, low, close, volume, trade_count, vwap from ticks; a single aggregate with map-side combine.

    volume is the sum of whole prices (test ticks carry no size). Ticks of one symbol at one instant are told apart by price.
    """
    order = F.struct(time, price)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("timestamp"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.sum(F.floor(price)).cast("long").alias("volume"),
            F.count(F.lit(1)).alias("trade_count"),
            F.avg(price).alias("vwap"),
        )
        .select("symbol", "timestamp", F.lit(timeframe).alias("timeframe"), "open", "high", "low", "close", "volume", "trade_count", "vwap")
    )


def select_bars(bars: DataFrame, symbols: list | None, timeframe: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the symbols and timeframe, from start to end inclusive, in (symbol, timestamp) order. Filters reach the scan."""
    keep: Column = F.col("timeframe") == timeframe
    if symbols is not None:
        keep = keep & F.col("symbol").isin(symbols)
    if start is not None:
        keep = keep & (F.col("timestamp") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        keep = keep & (F.col("timestamp") <= F.lit(end).cast("timestamp_ntz"))
    return bars.filter(keep).orderBy("symbol", "timestamp")


def project(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Keys and columns whose names may hold dots or blanks."""
    return df.select(*[F.col(f"`{n}`") for n in [*keys, *names]])


def backfill_plan(bars: DataFrame, days: int = 35) -> DataFrame:
    """For each symbol the span of `days` before its first bar, which a backfill asks for."""
    first = bars.groupBy("symbol").agg(F.min("timestamp").alias("first_bar"))
    return first.select("symbol", (F.col("first_bar") - F.expr(f"INTERVAL {days} DAYS")).alias("request_start"), F.col("first_bar").alias("request_end"))


def recent_window(bars: DataFrame, now: str, days: int = 4, delay_minutes: int = 40) -> DataFrame:
    """Bars of the last days, up to the delay that a feed imposes."""
    at = F.lit(now).cast("timestamp_ntz")
    return bars.filter((F.col("timestamp") >= at - F.expr(f"INTERVAL {days} DAYS")) & (F.col("timestamp") <= at - F.expr(f"INTERVAL {delay_minutes} MINUTES")))
