"""From raw documents to packed sequences: each stage is written as Parquet and read again as the next one's documents.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents. Kept: documents that the quality classifier
accepts, one of each group of equal texts (largest doc_id), one of each near-duplicate group
(smallest doc_id), and of those what the mix of sources takes, repeats included; these are packed.
Rows with null or empty texts pass through the stages as the operators define it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from parcelscope.llm import exact_dedup, jaccard, mixing, packing, quality
from parcelscope.llm.base import documents, held_out, settle, table
from pyspark.sql import DataFrame, SparkSession


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(), threshold=0.7)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs, largest=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_near(docs, size=5, threshold=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, eos=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

ORACLE_SQL = None  # a trained classifier, MinHash and a tokenizer decide; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
