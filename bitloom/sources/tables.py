"""Fingerprint tables derived from the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as B


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fp_id, label, words: signs of the 64 components, one word; the scan reads three columns."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("fp_id"), "label", F.array(B.sign_word("embedding")).alias("words"))


def bit_of(token) -> F.Column:
    """0 .. 63 for a token, by its md5."""
    return (F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long") % 64).cast("int")


def fold_bits(rows: DataFrame, keys: list[str], bit: str) -> DataFrame:
    """keys, words: one word per group with the given bits set; a mergeable OR."""
    word = F.bit_or(F.expr(f"shiftleft(1L, 63 - {bit})"))
    return rows.groupBy(*keys).agg(F.array(word).alias("words"))


def document_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fp_id (doc_id), lang, words: hashed lower-case tokens of each text.

    Built within the row, so documents are never exploded into tokens across a shuffle.
    """
    tokens = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""))
    word = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), 63 - bit_of(t))))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("fp_id"), "lang", F.array(word).alias("words"))


def basket_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fp_id (supplier), words: which of 64 classes of parts a supplier delivers."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 64).cast("int").alias("bit"))
    return fold_bits(rows, ["l_suppkey"], "bit").select(F.col("l_suppkey").alias("fp_id"), "words")


def event_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fp_id (user), words: hours of the day with any event."""
    rows = table(spark, sf_dir, "events").select("user_id", F.hour("ts").alias("bit"))
    return fold_bits(rows, ["user_id"], "bit").select(F.col("user_id").alias("fp_id"), "words")
