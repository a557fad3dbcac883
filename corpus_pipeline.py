"""Corpus pipeline: documents to token ids in five stages, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tlake.llm import byte_bpe, decontam, jaccard, langid, nbsvm
from tlake.llm.common import checkpoint_folder, small_batches, table
from tlake.llm.queries import BYTE_RANKS


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, by a model fitted on the labelled ones among them."""
    small_batches(spark)
    model = nbsvm.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(nbsvm.score(F.col("text"), model) >= 0.3)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the model does not reject."""
    small_batches(spark)
    model = langid.train(docs)
    return docs.filter(~langid.language(F.col("text"), model)["rejected"])


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id, once, also where rows or ids repeat or ids are null."""
    small_batches(spark)
    checkpoint_folder(spark)
    return jaccard.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    small_batches(spark)
    items = table(spark, sf_dir, "benchmark")
    found = decontam.matches(F.col("text"), decontam.item_blocks(items), id_type=items.schema["item_id"].dataType.simpleString(), whole_texts=True)
    return docs.filter(F.size(found) == 0)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document that is left."""
    small_batches(spark)
    return byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, BYTE_RANKS), BYTE_RANKS))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: SQL cannot express the trained stages; tests/llm compares the pipeline with a plain version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Each result is a table under the checkpoint folder, so a lost executor
    costs at most the stage at work."""
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
