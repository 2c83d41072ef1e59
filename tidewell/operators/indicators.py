"""Technical indicators over bars, one sort by (symbol, timestamp) for all framed ones.

Conventions (published ones; the averages' seeds are a choice): a simple average starts with the n-th bar; an exponential average is seeded
with the simple average of its first n values and smoothed with 2 / (n + 1); Wilder smoothing is recursive with 1 / n from the
first value. A group too short for an indicator (n bars or fewer) has null there. Bollinger bands use the population deviation.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["symbol", "timestamp"]


def _w(symbol: str = "symbol", time: str = "timestamp"):
    return Window.partitionBy(symbol).orderBy(time)


def _full(value: Column, n: int, symbol: str = "symbol") -> Column:
    """value where the window is full, in groups longer than n."""
    return F.when((F.row_number().over(_w(symbol)) >= n) & (F.count(F.lit(1)).over(Window.partitionBy(symbol)) > n), value)


def sma(price: str = "close", n: int = 20) -> Column:
    return _full(F.avg(price).over(_w().rowsBetween(1 - n, 0)), n)


def bollinger(price: str = "close", n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Lower, mid, upper band, bandwidth in percent, place within the bands."""
    w = _w().rowsBetween(1 - n, 0)
    mid, dev = F.avg(price).over(w), F.stddev_pop(price).over(w)
    low, up = mid - k * dev, mid + k * dev
    named = {"BBL": low, "BBM": mid, "BBU": up, "BBB": F.try_divide(100 * (up - low), F.nullif(mid, F.lit(0.0))), "BBP": F.try_divide(F.col(price) - low, F.nullif(up - low, F.lit(0.0)))}
    return {f"{name}_{n}_{k}": _full(c, n) for name, c in named.items()}


def true_range() -> Column:
    before = F.lag("close").over(_w())
    return F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


#: Steps of a recursion that are made by one matrix.
STEPS = 128


def ewm(x: np.ndarray, alpha: float, seed: int = 1) -> np.ndarray:
    """Recursive average of x; nan before `seed` values, seeded with their mean, and from a nan on.

    The steps inside a stretch are one product with a triangle of powers; only the last value of each stretch is carried on.
    """
    out = np.full(len(x), np.nan)
    if len(x) < seed:
        return out
    out[seed - 1] = np.mean(x[:seed])
    rest = x[seed:]
    bad = np.flatnonzero(~np.isfinite(rest))
    n = int(bad[0]) if len(bad) else len(rest)
    if n:
        k = np.arange(STEPS)
        triangle = alpha * np.tril((1 - alpha) ** np.maximum(k[:, None] - k, 0))
        fade = (1 - alpha) ** (k + 1.0)
        stretches = np.append(rest[:n], np.zeros(-n % STEPS)).reshape(-1, STEPS) @ triangle.T
        last = out[seed - 1]
        for row in stretches:
            row += fade * last
            last = row[-1]
        out[seed : seed + n] = stretches.ravel()[:n]
    return out


def recursive(close: np.ndarray, high: np.ndarray, low: np.ndarray) -> dict[str, np.ndarray]:
    """The indicators that depend on their own last value."""
    n = len(close)
    none = np.full(n, np.nan)
    ema = lambda x, k: ewm(x, 2 / (k + 1), k)
    out = {"EMA_50": ema(close, 50) if n > 50 else none}
    if n > 14:
        d = np.diff(close)
        up, down = ewm(np.maximum(d, 0), 1 / 14), ewm(np.maximum(-d, 0), 1 / 14)
        with np.errstate(invalid="ignore", divide="ignore"):
            rsi = np.where(up + down == 0, np.nan, 100 * up / (up + down))
        rsi[:13] = np.nan
        out["RSI_14"] = np.append(np.nan, rsi)
        before = np.append(np.nan, close[:-1])
        tr = np.fmax(high - low, np.fmax(np.abs(high - before), np.abs(low - before)))
        atr = ewm(tr, 1 / 14)
        atr[:13] = np.nan
        out["ATRr_14"] = atr
    else:
        out["RSI_14"] = out["ATRr_14"] = none
    if n > 35:
        line = ema(close, 12) - ema(close, 26)
        signal = np.concatenate([none[:25], ema(line[25:], 9)])
        out |= {"MACD_12_26_9": line, "MACDh_12_26_9": line - signal, "MACDs_12_26_9": signal}
    else:
        out |= {k: none for k in ("MACD_12_26_9", "MACDh_12_26_9", "MACDs_12_26_9")}
    return out


RECURSIVE = ("EMA_50", "RSI_14", "ATRr_14", "MACD_12_26_9", "MACDh_12_26_9", "MACDs_12_26_9")


def add_recursive(bars: DataFrame) -> DataFrame:
    """symbol, timestamp and the recursive indicators: a symbol's series goes to one Arrow call, in time order."""
    rows = bars.select("symbol", "timestamp", "close", "high", "low")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("timestamp")
        got = recursive(*[table.column(c).to_numpy() for c in ("close", "high", "low")])
        for k in RECURSIVE:
            table = table.append_column(k, pa.array(got[k], pa.float64(), mask=np.isnan(got[k])))
        return table.select(["symbol", "timestamp", *RECURSIVE])

    return rows.groupBy("symbol").applyInArrow(run, f"symbol {kinds['symbol']}, timestamp {kinds['timestamp']}, " + ", ".join(f"{k} double" for k in RECURSIVE))


def indicators(bars: DataFrame, drop_incomplete: bool = True) -> DataFrame:
    """Keys and all indicators; rows with any null left out before and after, as a whole-table rebuild does."""
    clean = complete(bars)
    framed = clean.select(*KEYS, "timeframe", sma().alias("SMA_20"), *[c.alias(k) for k, c in bollinger().items()])
    out = framed.join(add_recursive(clean), KEYS)
    return complete(out) if drop_incomplete else out


def complete(df: DataFrame) -> DataFrame:
    """Rows without a null, whatever the columns' names hold."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in df.columns]))


def rolling_sharpe(value: str, partition: list[str], order: str, n: int, periods: int = 252) -> Column:
    """Annualised mean over deviation of the last n rows; null until there are n, or without deviation."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(w) == n, F.try_divide(F.avg(value).over(w), F.nullif(F.stddev_samp(value).over(w), F.lit(0.0))) * F.sqrt(F.lit(float(periods))))


