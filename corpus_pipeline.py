"""Documents made ready for training: five stages, each of one corpus operator, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
The first three stages drop rows, the fourth masks secrets in the text, the last gives the digests of the encoded texts.
Cases are those of the operators: see their modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, decontaminate, minhash, quality, secrets
from tidewell.llm.common import released, table, written
from tidewell.llm.queries import vocabulary


def beside(found: DataFrame, docs: DataFrame, *outputs: str) -> DataFrame:
    """An operator's result that carries all columns of docs (id and text first, then the rest): those as c0, c1 .. in the order of docs, its last columns as `outputs`."""
    order = ["doc_id", "text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    return found.toDF(*[f"c{docs.columns.index(c)}" for c in order], *outputs)


def named(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """c0, c1 .. of `beside` under their own names, whatever these are."""
    return rows.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    outputs = [x.split(" ")[0] for x in quality.SCHEMA.split(", ")]
    return named(beside(quality.quality_rules(docs, carry=tuple(docs.columns)), docs, *outputs).filter("kept"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    gone = minhash.near_duplicates(docs).filter(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return named(beside(found, docs, *decontaminate.OUTPUTS).filter(~F.col("contaminated")), docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; n_chars follows the text."""
    found = beside(secrets.secret_scan(docs, outputs=("spans", "masked"), carry=tuple(docs.columns)), docs, "spans", "masked")
    changed = F.col("spans") != ""
    own = {c: F.col(f"c{k}") for k, c in enumerate(docs.columns)}
    new = {"text": F.col("masked"), "n_chars": F.length("masked").cast(docs.schema["n_chars"].dataType) if "n_chars" in own else None}
    return found.select(*[F.when(changed, new[c]).otherwise(x) if c in new else x for c, x in own.items()]).toDF(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document."""
    return bpe.bpe_round_trip(docs, vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality rules", good_quality),
    ("near-duplicates", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("encoding", encoded),
]

#: SQL has no zstandard, no MinHash and no BPE: the pipeline is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k}")
        released(before)
    return STAGES[-1][1](spark, docs, sf_dir)
