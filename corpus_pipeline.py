"""A training corpus from raw documents: five stages, each a table of documents (the last one of token ids).

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes each stage's rows as Parquet in the shared
folder and reads them back as the next one's docs. Rows with nulls, empty tables and repeated rows follow the rules that the stages' operators state.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tarn.llm import decontamination, language_id, pii_surrogates, sentencepiece_viterbi, simhash
from tarn.llm.common import materialize, table
from tarn.llm.queries import PII_KEY, PIECES


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject, with that language in place of the given one. It learns from the given ones."""
    model = language_id.fit(docs)
    tag = "__language"
    while tag in docs.columns:
        tag += "_"
    judged = language_id.identify(docs, model, out_col=tag).where(~F.col(tag)["rejected"])
    return judged.withColumn("lang", F.col(tag)["lang"]).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return simhash.survivors(docs).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    tag = "__scan"
    while tag in docs.columns:
        tag += "_"
    scanned = decontamination.scan_benchmark(docs, table(spark, sf_dir, "benchmark"), out_col=tag)
    return scanned.where(~decontamination.is_contaminated(F.col(tag)["n_words"], F.col(tag)["n_hit"])).select(*docs.columns)


def with_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the new text. The key is the session's spark.tarn.pii.key; the one that is in the
    source, and so is no secret, serves where that isn't set, as in tests."""
    return pii_surrogates.replace(docs, spark.conf.get("spark.tarn.pii.key", PII_KEY)).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def as_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trip (the ids decode to the text) of every document."""
    return sentencepiece_viterbi.round_trip(docs, public_tokenizers.path(PIECES), carry=("lang", "source"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("pii", with_surrogates),
    ("sentencepiece", as_pieces),
]

#: None of it is SQL: see tests/llm for the comparison with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
