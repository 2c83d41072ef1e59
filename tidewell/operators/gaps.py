"""Gaps in a series of bars: where bars are missing, how many a trading calendar expects, and windows to ask for again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(c: str | Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_timestamp(c.cast("timestamp"))


def find_gaps(bars: DataFrame, step_seconds: int, keys: list[str] | None = None, time: str = "timestamp") -> DataFrame:
    """Pairs of neighbouring bars further apart than a step: keys, gap_start, gap_end, gap_seconds."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy(time)
    g = bars.select(*keys, F.lag(time).over(w).alias("gap_start"), F.col(time).alias("gap_end"))
    return g.withColumn("gap_seconds", seconds("gap_end") - seconds("gap_start")).filter(F.col("gap_seconds") > step_seconds)


def sessions_utc(calendar: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Sessions of a calendar (date, open, close as local HH:MM) in UTC: date, opens, closes."""
    at = lambda c: F.to_utc_timestamp(F.concat_ws(" ", F.col("date").cast("string"), F.concat(F.col(c), F.lit(":00"))).cast("timestamp"), zone).cast("timestamp_ntz")
    return calendar.select("date", at("open").alias("opens"), at("close").alias("closes"))


def expected_in_gaps(gaps: DataFrame, sessions: DataFrame, step_seconds: int) -> DataFrame:
    """gaps with expected_bars: bar starts of the sessions strictly inside each gap, the last start a step before the close.

    Sessions shorter than a step have none. Starts are counted by arithmetic, not listed. Gaps and sessions meet by day, so the
    range join has an equality to shuffle on; the calendar has a row a day and is no side to broadcast unchecked.
    """
    days = gaps.withColumn("__day", F.explode(F.sequence(F.to_date("gap_start"), F.to_date("gap_end")))).withColumn("__id", F.struct(*gaps.columns))
    s = sessions.select(F.to_date("opens").alias("__day"), seconds("opens").alias("__o"), seconds("closes").alias("__c")).filter(F.col("__c") - F.col("__o") >= step_seconds)
    first = F.greatest(F.lit(0), F.floor((seconds("gap_start") - F.col("__o")) / step_seconds) + 1)
    last = F.least(F.floor((F.col("__c") - step_seconds - F.col("__o")) / step_seconds), F.ceil((seconds("gap_end") - F.col("__o")) / step_seconds) - 1)
    counted = days.join(s, "__day").withColumn("__n", F.greatest(F.lit(0), last - first + 1)).groupBy(*gaps.columns).agg(F.sum("__n").cast("long").alias("expected_bars"))
    return gaps.join(counted, gaps.columns, "left").withColumn("expected_bars", F.coalesce("expected_bars", F.lit(0).cast("long")))


def merge_gaps(gaps: DataFrame, keys: list[str], within_seconds: int, most: int | None = None) -> DataFrame:
    """Gaps joined into windows while the next one starts within `within_seconds` of the greatest end so far; the first `most` windows of each key."""
    w = Window.partitionBy(*keys).orderBy("gap_start", "gap_end")
    ended = F.max("gap_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = gaps.withColumn("__new", F.when(ended.isNull() | (seconds("gap_start") - seconds(ended) > within_seconds), 1).otherwise(0))
    windows = flagged.withColumn("window", F.sum("__new").over(w)).groupBy(*keys, "window").agg(F.min("gap_start").alias("window_start"), F.max("gap_end").alias("window_end"), F.count(F.lit(1)).alias("n_gaps"))
    return windows.filter(F.col("window") <= most) if most else windows
