"""Reading and writing tables. Writers go through Spark's commit protocol, so readers never see half a table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_query(spark: SparkSession, sql: str, **args) -> DataFrame:
    """A query with bound parameters (`:name`)."""
    return spark.sql(sql, args=args)


def overwrite(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """The table as df is, whatever was there."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], n: int, sort: list[str]) -> None:
    """A table laid out by key, so that joins and windows on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(n, *keys).sortBy(*sort).saveAsTable(name)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """A small document (configuration, metrics) as a one-row text table on any store that Spark writes."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV file for each partition, with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def replace_whole(df: DataFrame, path: str) -> None:
    """The table at path becomes df in one rename: until then readers see all of the old one, and df may be made from it."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    there = fs.exists(at(path))
    if there:
        fs.rename(at(path), at(old))
    if not fs.rename(at(new), at(path)):
        if there:
            fs.rename(at(old), at(path))
        raise OSError(f"{path} could not be replaced")
    if there:
        fs.delete(at(old), True)


def append_log(lines: DataFrame, path: str, source: str = "source", message: str = "message", at: str = "at") -> None:
    """Lines `[time] [source] message` added to a folder of text files, after what is there."""
    stamp = F.date_format(F.col(at).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    lines.select(F.concat(F.lit("["), stamp, F.lit("] ["), F.col(source), F.lit("] "), F.col(message)).alias("value")).write.mode("append").text(path)


PAGE = "symbol string, token string, next_page_token string, bars array<struct<t:string,c:double>>"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Rows of token-linked JSON pages on any store that Spark reads. Pages are read side by side; those that no other page of their symbol names are left out, unless they are first."""
    pages = spark.read.schema(schema).json(path)
    named = pages.filter("next_page_token IS NOT NULL").select("symbol", F.col("next_page_token").alias("token")).unionByName(pages.select("symbol").distinct().withColumn("token", F.lit("first")))
    return pages.join(named.distinct(), ["symbol", "token"], "left_semi").select("symbol", F.explode("bars").alias("bar")).select("symbol", "bar.*")
