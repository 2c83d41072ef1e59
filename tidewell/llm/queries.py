"""The thin queries of the corpus operators: each applies its operator to whole tables and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, language, licenses, minhash, oracles, quality, repeats, secrets, token_files, toxicity
from .common import crc_mod, shared_dir, table


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public tokenizer's file: a parameter of the operators, given here for the queries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = toxicity.labelled_rows(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    scored = toxicity.score(docs, toxicity.fit(learn))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "n_matches", "matched")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"), outputs=("n_assign", "n_access", "n_hex", "base_sha256", "spans"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), vocabulary(), path, end_id=2)
    return token_files.read_tokens(spark, path, with_ids=False)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = crc_mod(F.col("doc_id"), 4)
    found = language.language_id(table(spark, sf_dir, "documents"), learn=rest != 2, held_out=rest == 2)
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_secret_scan, op3_license_scan, op4_near_duplicates, op5_repeated_passages, op6_token_files, op7_bpe_round_trip, op8_decontaminate, op9_quality_rules, op10_language_id)}

ORACLE_SQL: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op4_near_duplicates": oracles.NEAR_DUPLICATES,
    "op5_repeated_passages": oracles.REPEATS,
    "op8_decontaminate": oracles.CONTAMINATION,
}
