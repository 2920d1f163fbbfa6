"""Training-data pipeline over documents: toxicity, line dedup, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import DOCUMENT_COLUMNS, crc_mod, read_table, written
from logloom.llm.line_dedup import apply_bitmaps, keep_bitmaps
from logloom.llm.mixing import mixed
from logloom.llm.ngram_join import representatives
from logloom.llm.packing import pack
from logloom.llm.queries import tokenizer_path
from logloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model rejects go; it learns as op5 does, from the labelled rows of the input table."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    return without_toxic(docs, read_table(spark, sf_dir, "documents"), labels).select(*DOCUMENT_COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the one of largest id only; documents stay, if empty."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return apply_bitmaps(docs, keep_bitmaps(docs)).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of 0.8 or more."""
    return representatives(docs, n=5, percent=80).select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: documents are taken up to three times, or not."""
    return mixed(docs.select(*DOCUMENT_COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096; a document taken twice is packed twice."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: A trained model and a tokenizer can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), ()
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, before)
        before = (docs,)  # goes once the next stage's table stands
    return STAGES[-1][1](spark, docs, sf_dir)
