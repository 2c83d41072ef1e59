"""How queries are registered, and the tables they share: bars, predictions, annotations made from the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import ln, rounded
from ..operators.bars import bars_from_ticks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL for the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(c: str, name: str | None = None) -> Column:
    """A time as text, alike in every engine."""
    return F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias(name or c)


def rnd(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded, as aggregation orders differ; the sum with 0 makes -0 into 0."""
    return (rounded(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(name or c)


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broad panel: a bar a day for each user of the events."""
    return bars_from_ticks(table(spark, sf_dir, "events"), "user_id", "ts", "value")


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long panel: a bar a week for each brand. The parts are few for the lines; Spark broadcasts them where their size allows."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    brands = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return bars_from_ticks(lines.join(brands, "l_partkey"), "p_brand", "l_shipdate", "l_extendedprice", "week", "1Week")


def predictions(bars: DataFrame, horizon: int = 1) -> DataFrame:
    """symbol, timestamp, target_timestamp, horizon, y_true (forward log return), y_pred (momentum of the same span)."""
    w = Window.partitionBy("symbol").orderBy("timestamp")
    ahead, back = F.lead("close", horizon).over(w), F.lag("close", horizon).over(w)
    safe = lambda a, b: ln(F.when((a > 0) & (b > 0), a / b))
    out = bars.select("symbol", "timestamp", F.lead("timestamp", horizon).over(w).alias("target_timestamp"), F.lit(horizon).alias("horizon"), safe(ahead, F.col("close")).alias("y_true"), safe(F.col("close"), back).alias("y_pred"))
    return out.filter("y_true IS NOT NULL AND y_pred IS NOT NULL")


def _bars_sql(source: str, symbol: str, time: str, price: str, unit: str, timeframe: str) -> str:
    return f"""bars AS (SELECT {symbol} AS symbol, CAST(date_trunc('{unit}', {time}) AS TIMESTAMP) AS timestamp, '{timeframe}' AS timeframe,
  first({price} ORDER BY {time}, {price}) AS open, max({price}) AS high, min({price}) AS low, last({price} ORDER BY {time}, {price}) AS close,
  CAST(sum(floor({price})) AS BIGINT) AS volume, count(*) AS trade_count, avg({price}) AS vwap FROM {source} GROUP BY 1, 2)"""


DAILY = _bars_sql("events", "user_id", "ts", "value", "day", "1Day")
WEEKLY = _bars_sql("lineitem JOIN part ON l_partkey = p_partkey", "p_brand", "l_shipdate", "l_extendedprice", "week", "1Week")


def pred_sql(horizon: int = 1, name: str = "pred") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT symbol, timestamp, lead(timestamp, {horizon}) OVER w AS target_timestamp, {horizon} AS horizon,
  CASE WHEN lead(close, {horizon}) OVER w > 0 AND close > 0 THEN ln(lead(close, {horizon}) OVER w / close) END AS y_true,
  CASE WHEN lag(close, {horizon}) OVER w > 0 AND close > 0 THEN ln(close / lag(close, {horizon}) OVER w) END AS y_pred
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) WHERE y_true IS NOT NULL AND y_pred IS NOT NULL)"""


def sql_stamp(c: str, name: str | None = None) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {name or c.split('.')[-1]}"


def sql_rnd(c: str, name: str | None = None, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0.0 AS {name or c}"
