"""A training corpus from documents: rules, classifier, near-duplicates, mixture, token ids.

STAGES lists the stages in order. Each takes (spark, docs, sf_dir); run() writes the result
of each as Parquet to the shared folder and gives it, reread, to the next.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from envtally.llm import byte_bpe, co_training, mixing, quality_rules, simhash
from envtally.llm.storage import checkpoint_folder

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
RESULTS = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps.

    It learns from all labelled documents of ``sf_dir``, also those that earlier stages took
    out: what is left has hardly a label of low quality. A folder with labels and no
    documents, which run() cannot read, has only ``docs`` to learn from.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    try:
        learned = spark.read.parquet(f"{sf_dir}/documents.parquet")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        learned = docs
    return co_training.keep(docs, labels, learned)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it: not at all, once or twice."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of each document but its text, its token ids, and their digests.

    A column that has the name of one of these is left out.
    """
    keys = [c for c in docs.columns if c.lower() not in ("text", *RESULTS)]
    encoded = byte_bpe.encode(docs, keys, RANKS, public_tokenizers.PATTERN)
    return byte_bpe.digests(encoded, [*keys, "ids"])


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mixture),
    ("byte_bpe", tokens),
]

#: The classifier and the solver of the mixture iterate, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the documents of ``sf_dir``."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
