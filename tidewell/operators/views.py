"""Documents with their annotations: enriched views, missing work, threads, keyset pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_predictions(docs: DataFrame, predictions: DataFrame, source: str, pk: str) -> DataFrame:
    """Every document with each of its predictions (one row for each model and version), or nulls."""
    own = predictions.filter(F.col("source") == source).drop("source")
    return docs.join(own, docs[pk] == own["pred_id"], "left").drop("pred_id")


def enriched(raw: DataFrame, processed: DataFrame, pk: str) -> DataFrame:
    """Raw documents with what preprocessing made of them, or nulls."""
    return raw.join(processed, pk, "left")


def unprocessed(raw: DataFrame, processed: DataFrame, pk: str) -> DataFrame:
    """Documents that preprocessing has not seen, late ones included."""
    return raw.join(processed.select(pk), pk, "left_anti")


def unscored(processed: DataFrame, predictions: DataFrame, source: str, pk: str, model: str, version: str) -> DataFrame:
    """Preprocessed documents that this model and version has not scored."""
    done = predictions.filter((F.col("source") == source) & (F.col("model") == model) & (F.col("schema_version") == version)).select(F.col("pred_id").alias(pk))
    return processed.join(done, pk, "left_anti")


def threads(posts: DataFrame, comments: DataFrame, pk: str, score: str, created: str, comment_id: str, top: int = 5, most_chars: int = 600) -> DataFrame:
    """pk, thread: each post's text with its `top` best comments (score, then age, then id), shortened. One set operation for all posts."""
    w = Window.partitionBy(pk).orderBy(F.col(score).desc(), F.col(created).asc(), F.col(comment_id).asc())
    best = comments.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= top)
    short = F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars), F.lit("..."))).otherwise(F.col("text"))
    lists = best.groupBy(pk).agg(F.array_sort(F.collect_list(F.struct("__n", short.alias("t")))).alias("c"))
    body = F.concat_ws("\n", F.col("text"), F.transform(F.coalesce("c", F.array().cast("array<struct<__n:int,t:string>>")), lambda x: F.concat(F.lit("- "), x["t"])))
    return posts.join(lists, pk, "left").select(pk, body.alias("thread"), F.coalesce(F.size("c"), F.lit(0)).alias("n_comments"))


def union_views(views: dict[str, DataFrame]) -> DataFrame:
    """All views one under another with a source tag; columns that a view lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [v.withColumn("source", F.lit(k)) for k, v in views.items()])


def keyset_page(df: DataFrame, time: str, pk: str, after: tuple | None, size: int) -> DataFrame:
    """The next rows after (time, pk) in that order."""
    if after is not None:
        t, p = F.lit(after[0]).cast("timestamp_ntz"), F.lit(after[1])
        df = df.filter((F.col(time) > t) | ((F.col(time) == t) & (F.col(pk) > p)))
    return df.orderBy(time, pk).limit(size)


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition).orderBy(*order))).filter(F.col("place") <= n)


def common_days(df: DataFrame, member: str, day: str) -> DataFrame:
    """Days that every member has."""
    n = df.agg(F.count_distinct(member).alias("n_all"))
    return df.groupBy(day).agg(F.count_distinct(member).alias("n")).crossJoin(F.broadcast(n)).filter("n = n_all").select(day)


def profile(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column, as rows."""
    values = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("v")).select(*by, "v.column", "v.x")
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)]))
    return values.groupBy(*by, "column").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), q.alias("__q"), F.max("x").alias("max")).select(*by, "column", "n", "mean", "std", "min", *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(("q25", "q50", "q75"))], "max")
