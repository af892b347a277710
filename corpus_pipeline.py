"""The training-corpus pipeline: five stages from documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows the stage before kept, and returns a
DataFrame that is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from hourloom.llm.common import stored, table

#: No SQL: the toxicity model, BagMinHash and BPE are not expressible in it.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, `n_chars` brought in line with the text."""
    return df.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the model learns from labels of documents
    that are not held out, and from the characters of all documents."""
    model = toxicity.learned(spark, docs, sf_dir)
    judged = toxicity.toxicity(docs, model)
    return judged.filter("predicted = 0").select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that occur on many sites, but for their first place."""
    return _documents(line_dedup.line_dedup(docs).select("row.*"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, in the order of its schedule."""
    return _documents(mixing.mix(docs).select("row.*"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    encoded = bpe.encode_table(docs, bpe.default_path())
    return encoded.select("row.doc_id", "row.source", "row.lang", "n_tokens", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
