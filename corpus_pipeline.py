"""Corpus preparation: each stage takes (spark, docs, sf_dir) and returns the documents it keeps; the last packs them.

Defined results: a null or empty text is no toxic one, loses no line, has no near
duplicate and is packed as its end id; rows that repeat an id and text are one
document to line dedup and near-dedup and rows of their own to mixing and packing;
rows without an id take part as their operators say; very long texts are handled
whole; a table of no rows gives no rows; extra columns of documents do not pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligo.llm import common, line_dedup, minhash, mixing, packing, queries, toxicity

#: None: kernel scores, alignment and tokenisation can't be written in SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject."""
    model = queries.toxicity_model(spark, docs, sf_dir)
    return toxicity.drop_toxic(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one holds; one that has no text of its own left goes. n_chars follows the text.

    A near copy keeps the lines in which it differs: they stand nowhere else.
    """
    cut = line_dedup.line_dedup(docs.select(*COLUMNS))
    left = cut.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, a likeness of 0.8 or more."""
    return minhash.drop_near_duplicates(docs.select(*COLUMNS), words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh as the square roots of their sizes, in a global random order."""
    return mixing.poisson_mix(docs.select(*COLUMNS), exponent=0.5, seed=17).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences of 2048."""
    return packing.pack_documents(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", filter_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, f"stage{k}")
    return docs
