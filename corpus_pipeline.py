"""A corpus pipeline out of the training-data operators (part of bitloom.llm).

Each stage takes (spark, docs, sf_dir), docs being all that the stage before it kept, and returns a
DataFrame.  The stages' decisions take effect: rejected, duplicate and contaminated documents go,
the mix repeats or leaves out documents, and the last stage writes the token files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bitloom.llm import decontaminate, mixing, quality, simhash, token_files
from bitloom.llm.common import new_path, table

#: Columns that every stage but the last returns.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps: each row goes by its own text, empty ones stay."""
    return quality.filter_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): that of the smallest id, null being the smallest.

    Of several texts under that id the one of the smallest hash stays, of equal rows one.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item overlaps; null and empty texts stay, rows of one id go by their own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, at most three times; texts without words never; equal rows share."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's place in the token files: doc_id, start, n_tokens, ids_crc32.

    Workers hold what earlier stages left in them too, so fewer pieces are kept than in a job of its own, and lots are smaller.
    Null ids come first, repeated ones by the hash of their texts; every row is encoded.
    """
    return token_files.encode_documents(docs, *token_files.default_tokenizer(), cache=400_000, lot_chars=1 << 20)


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", distinct_documents),
    ("benchmark decontamination", clean_of_benchmark),
    ("source mixing", mixed_sources),
    ("token files", token_ids),
]

#: Perplexities, components and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{i + 1}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
