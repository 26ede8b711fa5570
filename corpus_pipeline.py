"""A corpus pipeline of five stages, each on all that its predecessor kept: documents that the quality classifier rejects go,
one document of each near-duplicate group stays, passages that repeat across documents are cut out, secrets are masked,
and the texts are packed into training sequences.

Each stage but the last takes and gives the columns of documents, in which n_chars follows the text.

Defined results: null and empty texts are scored like any text, are near duplicates of each other, and pack as one end token;
of repeated rows one stays; rows without doc_id are kept like others where they are the only ones of their group; without
labels, or with labels of one class, the classifier knows only how frequent label 1 is and keeps all or nothing by that; an
empty table packs to nothing. Further columns go through all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewell.llm import packing, quality, secrets, simhash, suffix_dedup
from tablewell.llm.common import read_table, shared_folder

FOLDER = "pipeline"


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, as the text now has it."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word similarity of 0.8 or more: that with the smallest doc_id."""
    return simhash.one_of_each_similar(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that occur in a document of smaller doc_id."""
    return _counted(suffix_dedup.without_repeats(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """With each secret replaced by a label."""
    return _counted(secrets.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]

# SQL can't express the network or the packing; tests compare stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again as the next one's documents.

    Of the folders only the last stage's documents are left when this returns, because its result is lazy; they have a name
    of their own under `FOLDER`, so a later job can remove them.
    """
    folder = f"{shared_folder(spark)}/{FOLDER}/{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
