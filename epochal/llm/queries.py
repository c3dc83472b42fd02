"""The queries over the operators of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_anchors, bpe_codec, mixing, ordinal, parity_join, permutation_index, prefix_free, rules, sharding, surrogates
from .common import table


_RANDOM_KEY = secrets.token_bytes(32)


def surrogate_key(spark: SparkSession) -> bytes:
    """The secret in ``spark.epochal.surrogates.key`` (hexadecimal); without one, a random key of this process."""
    configured = spark.conf.get("spark.epochal.surrogates.key", None)
    return bytes.fromhex(configured) if configured else _RANDOM_KEY


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ordinal.graded(table(spark, sf_dir, "labels")))
    return ordinal.score_documents(docs, model)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op3_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_free.repeated_bytes(table(spark, sf_dir, "documents"))


def op4_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current policy with each of its rules left out in turn, from the stored ledger alone."""
    return rules.ablation(rules.stored(rules.ledger(table(spark, sf_dir, "documents"))))


def op5_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_anchors.repeated_words(table(spark, sf_dir, "documents"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op7_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ordinal_quality, op2_surrogates, op3_prefix_free_parsing, op4_rule_ledger, op5_block_anchors, op6_permutation_index, op7_label_propagation, op8_byte_bpe, op9_mixing, op10_parity_join, rule_ablation)}
ORACLES = {"op3_prefix_free_parsing": prefix_free.ORACLE, "op4_rule_ledger": rules.ORACLE, "op5_block_anchors": block_anchors.ORACLE, "op9_mixing": mixing.ORACLE, "op10_parity_join": parity_join.ORACLE, "rule_ablation": rules.ABLATION_ORACLE}
