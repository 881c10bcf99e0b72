"""Queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bitplanes, exact_dedup, jaccard, merkle, mixing, packing, pii, quality, repair, rules, secrets, sharding, toxicity
from .base import documents, held_out, table


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, eos=1)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(), threshold=0.7)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), largest=True)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = secrets.fit_net(secrets.labelled_findings(docs))
    return secrets.digests(secrets.find_secrets(docs, net))


def op5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trees = rules.fit_trees(docs, table(spark, sf_dir, "labels"), "quality", ~held_out())
    return rules.judge_documents(docs, trees)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_links(documents(spark, sf_dir), size=5, threshold=0.8)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=8).drop("source")


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chain = pii.fit_chain(pii.labelled_lines(docs))
    return pii.digests(pii.find_personal(docs, chain))


def op10_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = bitplanes.write_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), eos=2)
    return bitplanes.read_ids(spark, folder)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(documents(spark, sf_dir), merkle.tampering())


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(0, 5)
    scored = toxicity.toxic_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "toxic", ~out)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


_ALL = (op1_pack, op2_quality, op3_exact_dedup, op4_secrets, op5_rules, op6_jaccard, op7_mix, op8_shard, op9_personal, op10_ids, op11_repair, op12_manifest, op13_toxicity)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
