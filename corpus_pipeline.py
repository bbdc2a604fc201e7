"""From documents to a mixed, encoded training corpus: stages that each apply one operator to all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of documents; the last one returns the encoded rows.
Null doc_ids, texts, languages and sources pass through as the operators' docstrings say; extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm.common import cut
from wayfold.llm.lang_id import UNKNOWN, identify, learn
from wayfold.llm.line_dedup import line_dedup
from wayfold.llm.minhash import near_duplicates
from wayfold.llm.mixing import mix
from wayfold.llm.sp_codec import encode_decode

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least share of probability that a document's best language must have.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or of which no language is likely, go; a missing lang is filled in."""
    docs = docs.select(*COLUMNS)
    found = identify(docs, learn(docs)).where((F.col("_lang") != UNKNOWN) & (F.col("_score") >= LEAST_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "_lang")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document of which nothing visible is left was a repetition as a whole and goes."""
    out = line_dedup(docs.select(*COLUMNS))
    left = (F.col("_n_removed") == 0) | F.col("text").rlike(r"\S")
    return out.where(left).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) one document stays, that of least doc_id (then of least text hash), once.

    Documents that share a doc_id but not their text are told apart; texts without words and rows without a doc_id are no copies of any other and stay.
    """
    docs = docs.select(*COLUMNS)
    found = near_duplicates(docs)
    one = found.where("_kept and _group is not null").groupBy("_group").agg(F.min(F.struct("_id", "_key")).alias("_m")).select(F.col("_m._id").alias("doc_id"), F.col("_m._key").alias("_key"))
    wordless = found.where("_id is not null and _group is null").select(F.col("_id").alias("doc_id"), "_key").distinct()
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    copies = F.row_number().over(Window.partitionBy("doc_id", "_key").orderBy("lang", "source", "n_chars"))
    kept = keyed.where("doc_id is not null").join(one.union(wordless), ["doc_id", "_key"], "left_semi").withColumn("_r", copies).where("_r = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document is there as often as the mix takes it, in shuffled shards."""
    return mix(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), and digests of ids and decoded text, for each row; a null text is the empty text."""
    return encode_decode(docs, keep_ids=True).withColumnRenamed("_id", "doc_id")


STAGES = [("language", language), ("line_dedup", dedup_lines), ("near_dedup", dedup_near), ("mixing", mix_sources), ("sentencepiece", encode)]

#: SQL can't express the language model, the banding or the tokenizer; tests/llm/test_pipeline.py compares each stage after the first with brute force on the rows
#: that the stage before it kept, and checks which documents the first one keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
