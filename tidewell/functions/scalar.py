"""Scalar expressions: lenient numbers, epochs, business days, costs, row normalisation."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def to_number(c: Column) -> Column:
    """Double, or null for blanks, null tokens and what does not parse."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("", "null", "none", "nan"), None).when(t == "true", 1.0).when(t == "false", 0.0).otherwise(c.try_cast("double"))


def rounded(c: Column, digits: int) -> Column:
    """A double scaled by a power of ten, rounded half away from zero, scaled back: the C library's way. Spark's own rounds the shortest decimal, so that halves may go the other way."""
    x = c.cast("double")
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**digits).otherwise(x)


def ln(c: Column) -> Column:
    """The C library's natural logarithm, null unless above 0. Spark's own (that of StrictMath) differs in the last place of some, and ranks of logarithms turn on it."""

    def log(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None or v <= 0 else math.log(v) for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(log, "double")(c)


def epoch(c: Column) -> Column:
    """Seconds since 1970 as double, of a timestamp without zone."""
    return F.unix_timestamp(c.cast("timestamp")).cast("double")


def order_key(*times: Column) -> Column:
    """The first time that is there as epoch seconds, else 0."""
    return F.coalesce(*[epoch(t) for t in times], F.lit(0.0))


def add_business_days(day: Column, n: int) -> Column:
    """The n-th weekday after a date (n >= 1): whole weeks, then the rest around the weekend. A weekend day counts as the Friday before it."""
    w = F.weekday(day)
    base = F.date_sub(day, F.greatest(F.lit(0), w - 4))
    at = F.least(w, F.lit(4)) + n
    return F.date_add(base, (F.floor(at / 5) * 7 + at % 5 - F.least(w, F.lit(4))).cast("int"))


def target_time(time: Column, timeframe: str, horizon: int) -> Column:
    """When a horizon of bars ends: weekdays for day bars, plain durations for hour and minute bars."""
    import re

    m = re.fullmatch(r"(\d+)(Day|Hour|Min)", timeframe)
    if not m:
        raise ValueError(timeframe)
    n, unit = int(m[1]) * horizon, m[2]
    if unit == "Day":
        return add_business_days(F.to_date(time), n).cast("timestamp_ntz") + (time - F.date_trunc("day", time).cast("timestamp_ntz"))
    return time + F.expr(f"INTERVAL {n} {'HOURS' if unit == 'Hour' else 'MINUTES'}")


def token_cost(tokens_in: Column, tokens_out: Column, per_1k_in: float = 0.00005, per_1k_out: float = 0.0004) -> Column:
    return tokens_in / 1000 * per_1k_in + tokens_out / 1000 * per_1k_out


def min_max(c: str, partition: list[str], limits: tuple[float, float] | None = None, clip: bool = True, invert: bool = False) -> Column:
    """(x - min) / (max - min) over the partition or fixed limits; null without a span."""
    w = Window.partitionBy(*partition)
    low, high = (F.lit(limits[0]), F.lit(limits[1])) if limits else (F.min(c).over(w), F.max(c).over(w))
    x = F.try_divide(F.col(c) - low, F.nullif(high - low, F.lit(0.0)))
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) if clip else x
    return 1 - x if invert else x


def bucket(rank_pct: Column, q: float) -> Column:
    return F.when(rank_pct <= q, "long").when(rank_pct >= 1 - q, "short").otherwise("neutral")
