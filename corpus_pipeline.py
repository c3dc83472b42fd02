"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run``
writes a stage's rows as Parquet into the shared folder and reads them again as
the next stage's documents. All stages but the last return the columns of their
input. Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochal.llm import bpe_codec, mixing, parity_join, rules, surrogates
from epochal.llm.common import saved, table, unused
from epochal.llm.queries import surrogate_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; they are judged in place, so null or repeated ids don't matter."""
    row = unused(docs, "__row")
    packed = docs.select(F.struct(*docs.columns).alias(row), F.col("text"))
    judged = rules.apply_policy(rules.ledger(packed, id_col=row))
    return judged.filter("kept").select(f"{row}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least id, of each group linked by a similarity of 0.8 in five-word shingles.

    Rows are told apart by a number, as ids may be null (they come last) or
    repeat. Texts without words form no groups; of them, rows that repeat id and
    text count once.
    """
    row = unused(docs, "__row")
    rows = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = parity_join.near_duplicates(rows, id_col=row, num=80, den=100, shingle=5)
    groups = rows.select(row, "doc_id", F.xxhash64("text").alias("digest"), F.col("text").isNull().alias("none")).join(found, row)
    repeats = F.col("n_shingles").eqNullSafe(0) & F.col("doc_id").isNotNull()
    group = F.struct(F.when(~repeats, F.col("component_id")).alias("c"), F.when(repeats, F.struct("doc_id", "digest", "none")).alias("r"))
    groups = saved(groups.select(group.alias("group"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", F.col(row).alias("row")).alias("place")), "groups")
    # Written, so that the join can split a hot group.
    kept = saved(groups.groupBy("group").agg(F.min("place").alias("best"), F.count("*").alias("n")).filter("n > 1").select("group", "best"), "kept")
    dropped = saved(groups.join(kept, "group").filter(~F.col("place").eqNullSafe(F.col("best"))).select(F.col("place.row").alias(row)), "dropped")
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates, and their new number of characters."""
    out = surrogates.replace_entities(docs, surrogate_key(spark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    row = unused(docs, "__row")
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias(row))
    plan = mixing.mix_plan(packed, keep=(row,))
    return plan.filter("passes > 0").select(F.explode(F.array_repeat(row, F.col("passes").cast("int"))).alias(row)).select(f"{row}.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe_codec.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("encode", encode)]

#: Component search, keyed surrogates and encoding have no SQL form; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
