"""The corpus pipeline: quality filter, exact and near deduplication, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``. Between
stages the rows are written as Parquet in the shared folder and read again.

Defined results: rows are told apart by where they lie, not by ``doc_id``, so of copies exactly one row stays whether ids are
null, repeated or unique; of repeated rows, which tie in everything, any one. Null and blank texts are copies of each other
to the exact stage; what stays of them is linked with nothing, holds no benchmark item, and packs as a document without
tokens. Texts of any length go through whole. An empty table goes through all stages as an empty one. Further columns stay,
whatever their names, until the last stage, whose columns are its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meadowline.llm import decontaminate as _decontaminate
from meadowline.llm import exact_dedup as _exact
from meadowline.llm import near_dedup as _near
from meadowline.llm import packing as _packing
from meadowline.llm import quality as _quality
from meadowline.llm.common import materialize, ship, tokenizer_path

#: A document goes when its score is below this.
MIN_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = _quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _quality.accepted(docs, model, MIN_QUALITY)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    return _exact.stay(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity 0.8."""
    return _near.stay(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the benchmark's passages; those that consist of them for the most part go."""
    return _decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document with its bin."""
    return _packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.tiktoken"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can express neither the classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
