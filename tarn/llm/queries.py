"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import (
    decontamination, hidden_markov, language_id, pii_surrogates, quality_rules, sentencepiece_viterbi, simhash, token_counts, token_files, warc_packages,
)
from tarn.llm.common import table

WORD_BPE, PIECES = "word_bpe_49k.json", "piece_bpe_32k.model"
#: The key of the query's surrogates; real runs pass their own.
PII_KEY = "a key for tests"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_viterbi.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_packages.round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=2)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replace(docs, PII_KEY)


def op9_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_simhash, op3_sentencepiece, op4_warc, op5_token_counts, op6_token_files, op7_quality_rules, op8_pii, op9_hidden_markov, op10_language_id,
    )
}
#: The other operators aren't SQL: they are tested against brute force, the tokenizers' libraries, or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op4_warc": warc_packages.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
}
