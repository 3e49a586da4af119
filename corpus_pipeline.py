"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``. ``sf_dir`` gives the labels that the first
stage learns from; nothing else is read from it.

An empty table passes through as an empty table; null texts are clean of toxicity and fail the quality rules; rows
that repeat a document are one group for the near-copy stage, which keeps one of them. Further columns of ``docs`` go
through the first four stages unchanged, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm.common import table
from pulsegrid.llm.mixing import mix_texts
from pulsegrid.llm.packing import digest_pieces, pack
from pulsegrid.llm.quality import keep_good
from pulsegrid.llm.simhash import drop_near_copies
from pulsegrid.llm.toxicity import drop_toxic
from pulsegrid.session import scratch_path


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return keep_good(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of four words, four bits at most."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the proportions of the target weights, with repeats and cut blocks as the mix asks for."""
    return mix_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of 1024 tokens."""
    return digest_pieces(pack(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("quality", apply_quality_rules),
    ("near_copies", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# A learned model, fingerprints and a linear program: no SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
