"""Upserts as set operations: a table of old rows and one of new rows make the table after the write."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(old: str, new: str, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{old}.{k}") == F.col(f"{new}.{k}"))
    return out


def guarded_fold(arrivals: DataFrame, keys: list[str], order: list[str], guards: list[str], payload: list[str]) -> DataFrame:
    """Rows of a key in arrival order, each replacing the one kept so far only if all its guards are as large; a null guard on either side replaces nothing.

    That rule is no total order (neither of two rows may dominate), so it is folded, not sorted or aggregated: a key's rows stream past
    in order and one of them is held, however many a key has.
    """
    names = list(dict.fromkeys([*keys, *order, *guards, *payload]))
    rows = arrivals.select(*names)
    dealt = rows.repartition(*keys).sortWithinPartitions(*dict.fromkeys([*keys, *order, *guards, *payload]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            if not t.num_rows:
                continue
            key = list(zip(*[t.column(k).to_pylist() for k in keys]))
            guard = list(zip(*[t.column(g).to_pylist() for g in guards]))
            done, kept = [], 0
            for i in range(1, len(key)):
                if key[i] != key[kept]:
                    done.append(kept)
                    kept = i
                elif all(x is not None and y is not None and y >= x for x, y in zip(guard[kept], guard[i])):
                    kept = i
            yield from t.take(pa.array(done, pa.int64())).to_batches()
            held = t.slice(kept, 1).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    return dealt.mapInArrow(fold, rows.schema)


def guarded_upsert(old: DataFrame, new: DataFrame, keys: list[str], guards: list[str]) -> DataFrame:
    """One new row at most for each key: it replaces the old one only if all its guards are as large. A comparison with null is not true, so the old row stays; a key that old lacks enters whatever its guards are."""
    rest = [c for c in old.columns if c not in keys]
    both = old.withColumn("__old", F.lit(True)).alias("o").join(new.withColumn("__new", F.lit(True)).alias("n"), keys, "full")
    wins = F.lit(True)
    for g in guards:
        wins = wins & (F.col(f"n.{g}") >= F.col(f"o.{g}"))
    take_new = F.col("__new").isNotNull() & (F.col("__old").isNull() | F.coalesce(wins, F.lit(False)))
    return both.select(*keys, *[F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest])


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given (which must be total)."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Old rows stay; of the new rows of a key that old lacks the first one enters."""
    return old.unionByName(first_per_key(new.join(old.select(*keys), keys, "left_anti"), keys, order))


def insert_or_replace(old: DataFrame, new: DataFrame, keys: list[str], latest_first: list[Column]) -> DataFrame:
    """The last new row of a key replaces what old has."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(first_per_key(new, keys, latest_first))


def upsert_touch(old: DataFrame, new: DataFrame, keys: list[str], touched: str, at: Column) -> DataFrame:
    """New rows (unique by key) replace old ones; the column `touched` of what is written becomes `at`."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.withColumn(touched, at), allowMissingColumns=True)


def advance_checkpoint(checkpoints: DataFrame, batch: DataFrame, target: str, pk: str, time: str) -> DataFrame:
    """The checkpoint table (target_table, last_pk, last_time) after a batch: the batch's greatest (time, pk). An empty batch changes nothing."""
    top = batch.agg(F.max(F.struct(F.col(time).alias("t"), F.col(pk).alias("p"))).alias("m")).filter(F.col("m").isNotNull())
    new = top.select(F.lit(target).alias("target_table"), F.col("m.p").cast("string").alias("last_pk"), F.col("m.t").alias("last_time"))
    return checkpoints.join(new.select("target_table"), "target_table", "left_anti").unionByName(new)
