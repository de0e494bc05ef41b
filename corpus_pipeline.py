"""The corpus pipeline: language ID, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and all rows that the one before it kept; all but the
last return the columns of documents. Models are fitted on labelled rows of the table that
`sf_dir` holds, so a stage's decision on a text doesn't depend on what earlier stages dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import langid, packing, pii, simhash, toxicity
from saltmarsh.llm.common import remove, shared_dir, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.fit(table(spark, sf_dir, "documents")))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.resolve(docs, pii.session_key(spark)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", packing_stage),
]

#: Fitted models and fingerprint links can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet and read again. A step's files are removed
    when the next one is written; those of the last one are what is returned and belong to the caller."""
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs
