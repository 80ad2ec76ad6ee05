"""From raw documents to tokens: each stage works on all that the one before kept.

The stages, in order: documents without a clear language go; of each group of
near-duplicates one document stays; documents that hold benchmark passages go;
secrets in the texts are masked; what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from walkweave.llm import bpe, decontaminate, langid, secrets, shingles
from walkweave.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose five-word shingles are alike to 0.8 or more are one group: SimHash and bands find them, an exact check follows."""
    return shingles.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of characters follows the masked text."""
    return secrets.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language identification", language),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secret),
    ("byte-level BPE", tokens),
]

#: SQL has no Viterbi search, no XXH64 with a seed, no decoding of keys and no BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage before returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
