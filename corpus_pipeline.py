"""The corpus pipeline: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns of `documents`:
rejected documents are gone, secrets are masked in the text, and a document that the mixture repeats is there as often.

Odd rows: null and empty texts go through every stage as texts without words; rows without doc_id stay in the first three; rows that repeat a doc_id and its text become one in the near-copies stage; empty tables give empty ones;
extra columns come through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm import mixing, packing, paragraphs, secrets, simhash, toxicity
from foliograph.llm.common import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the grammar is fitted on the labelled ones among docs."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies.

    SimHash groups first. At 3 bits they leave many copies with an edit or two, so groups by exact similarity of 0.8 or more of five-word shingles follow among what stayed.
    """
    return paragraphs.keep_first_copies(written(simhash.keep_first(docs), "simhash_kept"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the sources' target weights, in shuffled order."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack(docs, packing.vocabulary_path())


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]
#: The learned grammar and the patterns' packing have no SQL form. Tests run the stages on small and odd tables and look for clean documents, edited copies and columns; the operators have brute-force tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
