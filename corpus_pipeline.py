"""From raw documents to token ids that decode to the text: stages over the whole corpus."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorpool.llm import bpe, contamination, exact, near, quality
from motorpool.llm.common import table
from motorpool.session import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels are one of its labellers."""
    return quality.drop_rejected(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8 or more) stays."""
    return near.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item (0.8 of its five-word shingles or more) go."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the text that the ids decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    # Smaller chunks than for the encoder alone: the workers still hold what earlier stages left.
    encoded = bpe.encode(docs, path, pattern, chunk_tokens=2_000_000)
    sized = encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("ids").alias("again"))
    decoded = bpe.decode(sized, path, pattern, ids="again", name="text")
    return decoded.withColumn("text", F.decode("text", "utf-8"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_level_bpe),
]

#: The classifier's fit and the merges of the encoder are not SQL; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one feeding the next through a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
