"""As-of joins: to each left row the latest right row that is not later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, key: str, columns: list[str]) -> DataFrame:
    """By key, exact matches allowed. Both sides are united and the last right row before each left row is carried on:
    one shuffle and one sort by (key, time), no pairs of rows. Right rows of one instant: the one with greatest columns counts.
    """
    r = right.filter(F.col(right_time).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__k"), F.col(right_time).alias("__t")).agg(F.max(F.struct(F.col(right_time).alias("__rt"), *columns)).alias("__r"))
    a = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"))
    b = r.select("__k", "__t", F.lit(0).alias("__side"), "__r")
    w = Window.partitionBy("__k").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).filter("__side = 1")
    return both.select("__l.*", F.col("__r.__rt").alias(right_time) if right_time not in left.columns else F.col("__r.__rt").alias(f"{right_time}_right"), *[F.col(f"__r.{c}").alias(c) for c in columns])


def asof_keyless(left: DataFrame, right: DataFrame, left_time: str, right_time: str, columns: list[str], most_rows: int = 200_000) -> DataFrame:
    """Without a key, for a right side of few rows (a macro series): they become intervals up to the next row, joined by range.

    The right side is broadcast only if it has at most most_rows rows; beyond that both sides are dealt out by month,
    each month's right rows with the last one before it. Either way, of right rows of one instant the one with greatest columns
    counts, and right rows without time count for nothing.
    """
    right = right.filter(F.col(right_time).isNotNull()).groupBy(F.col(right_time).alias("__t")).agg(F.max(F.struct(*columns)).alias("__r")).select(F.col("__t").alias(right_time), *[F.col(f"__r.{c}").alias(c) for c in columns])
    n = right.count()
    if n <= most_rows:
        spans = right.select(F.col(right_time).alias("__from"), *columns).withColumn("__to", F.lead("__from").over(Window.orderBy("__from")))
        on = (F.col(left_time) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(left_time) < F.col("__to")))
        return left.join(F.broadcast(spans), on, "left").drop("__from", "__to")
    month = lambda c: F.date_trunc("month", F.col(c))
    own = right.withColumn("__m", month(right_time))
    months = left.select(month(left_time).alias("__m")).unionByName(own.select("__m")).distinct()
    last = own.groupBy("__m").agg(F.max(F.struct(F.col(right_time).alias("__rt"), *columns)).alias("__last"))
    carried = months.join(last, "__m", "left").withColumn("__before", F.last("__last", ignorenulls=True).over(Window.orderBy("__m").rowsBetween(Window.unboundedPreceding, -1)))
    before = carried.filter("__before IS NOT NULL").select("__m", F.col("__before.__rt").alias(right_time), *[F.col(f"__before.{c}").alias(c) for c in columns])
    return asof_backward(left.withColumn("__m", month(left_time)), own.select("__m", right_time, *columns).unionByName(before), left_time, right_time, "__m", columns).drop("__m", right_time)
