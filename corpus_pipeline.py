"""Training-corpus pipeline: five stages over ``documents``.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet in the shared folder and read again as the next stage's input.  All
but the last return the columns of ``documents``.

1. toxicity: documents that score at least the threshold go;
2. line dedup: later repeated runs of lines are cut out of the texts, and a
   document that loses all its words goes;
3. MinHash near-dedup: one document of each group (the least id) stays;
4. benchmark decontamination: benchmark passages are cut out of the texts;
5. packing: the remaining texts become sequences (one row per piece).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import decontaminate, line_dedup, minhash, packing, toxicity
from veilspark.llm.common import held_out, materialize, table
from veilspark.llm.queries import TOKENIZER

#: Near duplicates share this share of five-word shingles.
SHINGLE = 5


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, fitted on the labelled rows, rejects."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.reject_toxic(docs, labels, training=lambda doc_id: ~held_out(doc_id, 3))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later repeated runs of lines."""
    return line_dedup.deduplicate(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    return minhash.deduplicate(docs, shingle=SHINGLE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the remaining texts into sequences."""
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_deduplication),
    ("minhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", sequence_packing),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
