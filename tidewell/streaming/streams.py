"""Incremental forms of the batch operators with Structured Streaming."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema, per_batch: int = 10) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """First-write-wins while the watermark allows: state is dropped behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def bars(stream: DataFrame, symbol: str, time: str, price: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Bars by tumbling windows; late ticks change their bar until the watermark passes it."""
    order = F.struct(time, price)
    return (
        stream.withWatermark(time, late)
        .groupBy(F.col(symbol).alias("symbol"), F.window(time, width).alias("w"))
        .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("trade_count"))
        .select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "trade_count")
    )


GUARDED = "key string, seq long, volume long, trade_count long"
Arrival = tuple[int, int | None, int | None]


def _standing(rows: list[Arrival]) -> list[Arrival]:
    """Of a key's rows in order of seq those that can still count, whatever rows come in between later.

    The kept row only grows. So a row below an earlier one (in one guard, and not above it in the other) is never taken; of rows alike, the first
    stands in others' way and the last is the result; a row with a null guard counts only as the first of all, which nothing replaces.
    """
    ends: dict[tuple, list[Arrival]] = {}
    front: list[tuple[int, int]] = []  # pairs of guards none of which is below another: volumes rise, trade counts fall
    for r in rows:
        pair = r[1:]
        if None in pair:
            continue
        i = bisect_left(front, (pair[0],))
        if i < len(front) and front[i] == pair:
            ends[pair][1:] = [r]
        elif i == len(front) or front[i][1] < pair[1]:
            end = i + (i < len(front) and front[i][0] == pair[0])
            while i and front[i - 1][1] <= pair[1]:
                i -= 1
            front[i:end] = [pair]
            ends[pair] = [r]
    return [*[r for r in rows[:1] if None in r], *sorted((r for own in ends.values() for r in own), key=lambda r: r[0])]


def _guard(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held: list[Arrival] = list(zip(*state.get)) if state.exists else []
    for rows in batches:
        guards = [[x if there else None for x, there in zip(rows[c].tolist(), rows[f"has_{c}"].tolist())] for c in ("volume", "trade_count")]
        held.extend(zip(rows["seq"].tolist(), *guards))
        held.sort(key=lambda r: (r[0], *[(x is not None, x or 0) for x in r[1:]]))
        held = _standing(held)
    if held:
        state.update(tuple(list(c) for c in zip(*held)))
        kept = held[0]
        for new in held[1:]:
            if all(x is not None and y is not None and y >= x for x, y in zip(kept[1:], new[1:])):
                kept = new
        yield pd.DataFrame([(key[0], *kept)], columns=["key", "seq", "volume", "trade_count"])


def guarded_upserts(stream: DataFrame) -> DataFrame:
    """The guarded upsert over a stream of (key, seq, volume, trade_count): the row kept for each key that a batch touched. A null guard replaces nothing.

    Rows are folded in the order of seq (never null), in whatever order and batches they come. A key's state, for good, is the rows that may
    still count: a few for guards that vary freely, at most two for each pair of guards.
    """
    flagged = stream.select("key", "seq", *[x for c in ("volume", "trade_count") for x in (F.coalesce(c, F.lit(0)).alias(c), F.col(c).isNotNull().alias(f"has_{c}"))])
    return flagged.groupBy("key").applyInPandasWithState(_guard, GUARDED, "seq array<long>, volume array<long>, trade_count array<long>", "update", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """All that is there, batch by batch, to a folder; every row with its batch, so that the last state of a key can be told."""

    def put(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{path}/batch={k}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def last_state(table: DataFrame, keys: list[str]) -> DataFrame:
    """The latest row of each key."""
    rest = [c for c in table.columns if c not in keys]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest if c != "batch"])
