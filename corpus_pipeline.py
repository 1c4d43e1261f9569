"""The corpus pipeline: documents through quality rules, near-dedup, suffix dedup, mixing and encoding.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last one token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecover.llm.byte_bpe import byte_bpe, vocabulary
from filecover.llm.common import written
from filecover.llm.mixing import mixed_rows
from filecover.llm.near_dedup import one_of_each
from filecover.llm.repetition import keep_good
from filecover.llm.suffix_dedup import without_repeats
from filecover.session import BATCH_BYTES, SETTINGS


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the word, line and repetition rules go."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return one_of_each(docs, width=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that also start earlier are cut out, to whole characters."""
    return _measured(without_repeats(docs, 100))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and cut to their target weights."""
    return _measured(mixed_rows(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids (little-endian unsigned 32-bit), and digests of ids and of the bytes they decode to."""
    encoded = byte_bpe(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _bounded(stage: Callable) -> Callable:
    """The stage with Arrow batches bounded by bytes: workers outlive a stage, and what batches took stays with them."""

    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(BATCH_BYTES, SETTINGS[BATCH_BYTES])
        return stage(spark, docs, sf_dir)

    return bounded


STAGES = [
    ("quality rules", _bounded(quality)),
    ("MinHash near-dedup", _bounded(near_dedup)),
    ("suffix-array dedup", _bounded(suffix_dedup)),
    ("mixing to target weights", _bounded(mixing)),
    ("byte-level BPE", _bounded(encoding)),
]
#: SQL can express neither suffix removal to whole characters nor the merges; a brute-force version tests the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other over the documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
